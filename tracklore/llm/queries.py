"""The queries of the operators in this folder, by their contracts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, lm, media, mixing, neardup, oracles, quality, secrets, substrings, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fitted(spark, docs, sf_dir))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_components(_read(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    folder, manifest = tokens.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_back(spark, folder, manifest, docs.schema["doc_id"])


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(_read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    base = [r.name for r in secrets.RULES if r.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(text(of(*base)).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_lm": op2_lm,
    "op3_html": op3_html,
    "op4_neardup": op4_neardup,
    "op5_tokens": op5_tokens,
    "op6_media": op6_media,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = oracles.ORACLES
