"""Editing sheets and records in and out: TSV and JSON.

Sheets are keyed by the start, written with two decimals as Python writes them; the reader takes it back to whole
milliseconds. Of rows with the same key the later one holds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEAKER = r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,23}$"


@F.pandas_udf(T.StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """Seconds with two decimals, halves as the binary value falls."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.2f}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return rows.withColumns({"row": F.monotonically_increasing_id(), "file": F.input_file_name()})


def _last(rows: DataFrame) -> DataFrame:
    """Of each file's rows with the same key the later one; a folder may hold sheets of many tracks."""
    values = [c for c in rows.columns if c not in ("file", "start_ms", "row")]
    one = rows.groupBy("file", "start_ms").agg(F.max_by(F.struct(*values), "row").alias("v"))
    return one.select("start_ms", *[F.col(f"v.{c}").alias(c) for c in values], F.col("file"))


def _key(strict: bool):
    start = "cast(start as double)" if strict else "try_cast(start as double)"
    return F.expr(f"cast(round({start} * 1000) as bigint)").alias("start_ms")


def read_texts(spark: SparkSession, path: str, column: str) -> DataFrame:
    """start_ms, new_text and file of sheets of translations or rewrites; blank cells are left out, a bad start is an error."""
    return _last(_read(spark, path).where(F.trim(F.col(column)) != "").select(_key(True), F.trim(F.col(column)).alias("new_text"), "row", "file"))


def read_cast(spark: SparkSession, path: str) -> DataFrame:
    """start_ms, new_speaker, new_voice, file; rows with a bad start are left out, a bad speaker label is an error."""
    rows = _read(spark, path).where("try_cast(start as double) is not null")
    speaker = F.trim(F.coalesce("speaker", F.lit("")))
    checked = F.when((speaker == "") | speaker.rlike(SPEAKER), speaker).otherwise(F.raise_error(F.concat(F.lit("bad speaker label: "), speaker)))
    return _last(rows.select(_key(False), checked.alias("new_speaker"), F.trim(F.coalesce("voice", F.lit(""))).alias("new_voice"), "row", "file"))


def for_cues(sheet: DataFrame, cues: DataFrame) -> DataFrame:
    """Rows of a sheet with the start_ms of the cues that they are for. A sheet has starts with two decimals, so a cue is
    met by its start as the sheet writes it, whatever its milliseconds."""
    key = F.round(two_decimals(F.col("start_s")).cast("double") * 1000).cast("long")
    return sheet.join(cues.select(key.alias("_sheet_ms"), F.col("start_ms").alias("_cue_ms")).distinct(), F.col("start_ms") == F.col("_sheet_ms")).withColumn("start_ms", F.col("_cue_ms")).drop("_sheet_ms", "_cue_ms")


def write_sheet(rows: DataFrame, path: str, *columns: str) -> None:
    """A sheet of one file, for people to edit. The rows are computed by as many tasks as before and gathered after."""
    out = rows.select(*[two_decimals(F.col("start_s")).alias("start") if c == "start" else F.col(c) for c in columns])
    out.repartition(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')


def write_records(rows: DataFrame, path: str) -> None:
    """Records as one JSON array a track, a file for each, without the audio column; start and end go by these names."""
    named = rows.drop("audio").withColumnsRenamed({"start_s": "start", "end_s": "end"})
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*[c for c in named.columns if c != "track_id"]).alias("row")))), lambda x: x["row"]))
    named.groupBy("track_id").agg(body.alias("value")).repartition("track_id").write.mode("overwrite").partitionBy("track_id").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_previous(spark: SparkSession, path: str) -> DataFrame:
    """key and new_text of an earlier run's records (and the track, where the folder is one of write_records()); key: the
    start with two decimals, as records are matched. A file is an array or has a record a line; rows without start or
    text are left out; a missing or broken file has none. Of equal keys the later row holds."""
    record = "struct<start:double,start_s:double,text:string>"
    empty = spark.createDataFrame([], "key string, new_text string")
    if not _exists(spark, path):
        return empty
    files = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    lines = F.transform(F.split("value", "\n"), lambda x: F.from_json(x, record))
    rows = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{record}>")).otherwise(lines)
    by = ["track_id"] if "track_id" in files.columns else []
    got = files.select(*by, F.posexplode(rows).alias("row", "r")).select(*by, "row", F.coalesce("r.start", "r.start_s").alias("start_s"), F.col("r.text").alias("new_text"))
    got = got.where("start_s is not null and new_text <> ''").withColumn("key", two_decimals(F.col("start_s")))
    return got.groupBy(*by, "key").agg(F.max_by("new_text", "row").alias("new_text"))


def apply_previous(cues: DataFrame, previous: DataFrame) -> DataFrame:
    """cues with the texts of an earlier run, matched by start with two decimals; matched, and changed where it differs."""
    by = [c for c in ("track_id", "key") if c in previous.columns]
    rows = cues.withColumn("key", two_decimals(F.col("start_s"))).join(previous, by, "left")
    return rows.withColumn("matched", F.col("new_text").isNotNull()).withColumn("changed", F.coalesce(F.col("new_text") != F.col("text"), F.lit(False))).withColumn("text", F.coalesce("new_text", "text")).drop("new_text", "key")
