"""Cost of a run and what it has learned, artefacts and their inputs, terms and samples of a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import COMMON_WORDS, SPOKEN_CPS, STAGES


def stage_table(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(u).alias("unit"), F.lit(r).alias("rate"), F.lit(z).alias("startup_s")) for s, (u, r, z) in STAGES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rates(defaults: DataFrame, learned: DataFrame) -> DataFrame:
    """Defaults, replaced by learned positive rates."""
    return defaults.join(learned.where("learned > 0"), "stage", "left").withColumn("rate", F.coalesce("learned", "rate")).drop("learned")


def ema(observed: DataFrame, share: float = 0.6, *keys: str) -> DataFrame:
    """Rate after all observations (ord, value) of a key: the first one, then (1 - share) of the next each time.
    In closed form: weights fall by `share` with every later observation."""
    rows = observed.where("value > 0")
    back = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    rows = rows.withColumn("_k", F.row_number().over(back) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    weight = F.when(F.col("_k") == F.col("_n") - 1, F.pow(F.lit(share), F.col("_k"))).otherwise(F.lit(1 - share) * F.pow(F.lit(share), F.col("_k")))
    return rows.groupBy(*keys).agg(F.sum(F.col("value") * weight).alias("rate"), F.count("*").alias("observations"))


def plans(cues: DataFrame) -> DataFrame:
    """Cues and seconds of each track; speech is spoken length, a little over the window at most."""
    said = F.char_length("text") / F.lit(SPOKEN_CPS)
    window = F.col("end_s") - F.col("start_s")
    speech = F.when(window > 0, F.least(said, window * 1.25)).otherwise(said)
    return cues.groupBy("track_id").agg(F.max("end_s").alias("video_s"), F.sum(speech).alias("speech_s"), F.count("*").alias("cues"))


def cost(plan: DataFrame, table: DataFrame, stages: list[str]) -> DataFrame:
    """Seconds of each stage of each track."""
    units = F.when(F.col("unit") == "cues", F.col("cues").cast("double")).when(F.col("unit") == "speech", F.col("speech_s")).otherwise(F.col("video_s"))
    return plan.withColumn("stage", F.explode(F.array(*map(F.lit, stages)))).join(table, "stage").withColumn("seconds", units * F.col("rate") + F.col("startup_s"))


def artefact_key(inputs: dict[str, Column]) -> Column:
    """Sixteen digits of the SHA-1 of named inputs, in the order of their names."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("missing"))) for k, v in sorted(inputs.items())]).cast("binary")), 1, 16)


def clip_key(engine: str, voice: Column, speed: Column, text: Column) -> Column:
    """Name of a spoken line in the cache."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(engine), voice, F.format_string("%.4f", speed), text).cast("binary")), 1, 20)


def stale(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artefacts whose key is not the one in the manifest, or that are not in it."""
    return current.join(manifest.select("artefact", "key"), ["artefact", "key"], "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


MANIFEST = "artefact string, key string, inputs map<string,string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """artefact, key and inputs of the last written manifest; no rows where there is none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(f"{MANIFEST}, version long").json(path)
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).drop("version")


def merged_manifest(old: DataFrame, new: DataFrame, gone: list[str] | None = None) -> DataFrame:
    """The old entries, those of the new ones in their place, without the artefacts that are gone."""
    kept = old.join(new.select("artefact"), "artefact", "left_anti").unionByName(new)
    return kept.where(~F.col("artefact").isin(gone)) if gone else kept


def write_manifest(rows: DataFrame, path: str) -> None:
    """A new version beside the old ones, so that a manifest can be read while the next is written from it."""
    spark = rows.sparkSession
    last = spark.read.schema("version long").json(path).agg(F.max("version")).first()[0] if _exists(spark, path) else None
    rows.select("artefact", "key", "inputs", F.lit((last or 0) + 1).alias("version")).write.mode("append").json(path)


def learned_rates(old: DataFrame, observed: DataFrame, share: float = 0.6) -> DataFrame:
    """stage and learned: the old rates with what was observed (stage, seconds, units) of known stages; the old rate counts
    `share` where it is one."""
    seen = observed.where(F.col("stage").isin(*STAGES) & (F.col("units") > 0) & (F.col("seconds") > 0)).select("stage", (F.col("seconds") / F.col("units")).alias("_new"))
    both = old.join(seen, "stage", "full")
    mixed = F.when(F.col("learned") > 0, F.col("learned") * share + F.col("_new") * (1 - share)).otherwise(F.col("_new"))
    return both.select("stage", F.coalesce(mixed, F.col("learned")).alias("learned")).where("learned > 0")


def check_options(cast: bool, diarize: bool, clone: bool = False, stem: bool = True) -> None:
    """Options that contradict each other are an error before a run begins."""
    if cast and not diarize:
        raise ValueError("a cast sheet and no diarization ask for different voices: leave one of them out")
    if clone and not stem:
        raise ValueError("voices are cut from the vocal stem: separate it, or choose a preset voice")


def check_cues(cues: DataFrame) -> DataFrame:
    """cues, with an error for tracks of which none is left; tracks are named by a left join, so give all of them."""
    empty = cues.groupBy("track_id").agg(F.count("text").alias("n")).where("n = 0").select("track_id").limit(5).collect()
    if empty:
        raise ValueError(f"no lines to speak in track {', '.join(str(r.track_id) for r in empty)}")
    return cues


def term_candidates(lines: DataFrame, top: int = 120, least: int = 2) -> DataFrame:
    """Capitalised words within sentences, by number: the `top` most frequent of each track, then those that occur
    `least` times. lines(track_id, seq, text)"""
    # sentence by sentence: what begins one is no term
    sentence = lines.select("track_id", "seq", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("s", "sentence"))
    words = sentence.select("track_id", "seq", "s", F.posexplode(F.regexp_extract_all("sentence", F.lit(r"(?:^|[^A-Za-z'’\-])([A-Z][a-zA-Z'’\-]{2,})"), F.lit(1))).alias("w", "term"), F.regexp_extract("sentence", r"^([A-Z][a-zA-Z'’\-]{2,})", 1).alias("first"))
    words = words.where(~((F.col("w") == 0) & (F.col("first") != "")) & ~F.col("term").isin(*COMMON_WORDS) & (F.col("term") != F.upper("term")))
    by = words.groupBy("track_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("seq", "s", "w")).alias("at"))
    ranked = by.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("n"), "at")))
    return ranked.where((F.col("rank") <= top) & (F.col("n") >= least)).select("track_id", "term", "n", "rank")


def even_sample(cues: DataFrame, n: int = 60, longer: int = 15) -> DataFrame:
    """Lines spread over each track: every count/n-th, of those the long ones, n at most."""
    w = Window.partitionBy("track_id").orderBy("idx")
    rows = cues.withColumn("_i", F.row_number().over(w) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("track_id")) / n)))
    rows = rows.where((F.pmod(F.col("_i"), F.col("_step")) == 0) & (F.char_length("text") > longer)).withColumn("pick", F.row_number().over(w))
    return rows.where(F.col("pick") <= n).drop("_i", "_step")


def wrong_language(lines: DataFrame) -> DataFrame:
    """Lines of a Ukrainian translation that read as Russian."""
    return lines.where(F.col("text").rlike(X.rx(X.RUSSIAN, True)))
