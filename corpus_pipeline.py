"""A training corpus from documents: quality, near duplicates, benchmark passages, mixture, token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklore.llm import decontaminate, mixing, neardup, quality, tokens
from tracklore.llm.common import cut, scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fitted(spark, docs, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target shares of tokens."""
    return mixing.keep_sample(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token files, read back from them."""
    folder, manifest = tokens.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_back(spark, folder, manifest, docs.schema["doc_id"])


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", clean), ("mix", mixed), ("tokens", tokenized)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return keep(docs)
