"""Subtitle files as tables of events: SubRip and Advanced SubStation, a file to a track.

Files are read whole, as one row each, by Spark's text source; blocks are parsed by column expressions. Times become whole
milliseconds, then seconds. Comments and styles other than dialogue are left out, as are lines without text or length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rx import rx

_SRT_TIME = r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
_ASS_TIME = r"(\d+):(\d{1,2}):(\d{1,2})[.](\d{1,2})"


def _ms(c: Column, pattern: str, prefix: str = "", digits: int = 3) -> Column:
    part = lambda k: F.regexp_extract(c, prefix + pattern, k)
    return (part(1).cast("long") * 60 + part(2).cast("long")) * 60000 + part(3).cast("long") * 1000 + F.rpad(part(4), digits, "0").cast("long") * (1 if digits == 3 else 10)


def _finish(rows: DataFrame, keep_newlines: bool) -> DataFrame:
    text = F.trim(F.regexp_replace("text", rx(r"\s+"), " ")) if not keep_newlines else F.trim(F.regexp_replace("text", r"[ \t]+", " "))
    rows = rows.withColumn("text", text).where("end_ms > start_ms and text <> ''")
    order = Window.partitionBy("file").orderBy("start_ms", "block")
    return rows.select("file", F.xxhash64("file").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n").alias("value"))


def read_srt(spark: SparkSession, path: str, keep_newlines: bool = False) -> DataFrame:
    """file, track_id, seq, start_s, end_s, text of SubRip files."""
    blocks = _files(spark, path).select("file", F.posexplode(F.split("value", r"\n\s*\n")).alias("block", "b"))
    head = rf"(?s)^\s*(?:\d+\s*\n)?\s*{_SRT_TIME}\s*-->\s*{_SRT_TIME}[^\n]*\n?"
    rows = blocks.where(F.col("b").rlike(head))
    second = F.regexp_extract("b", rf"-->\s*({_SRT_TIME})", 1)
    first = F.regexp_extract("b", rf"({_SRT_TIME})\s*-->", 1)
    return _finish(rows.select("file", "block", _ms(first, _SRT_TIME).alias("start_ms"), _ms(second, _SRT_TIME).alias("end_ms"), F.regexp_replace("b", head, "").alias("text")), keep_newlines)


def read_ass(spark: SparkSession, path: str, keep_newlines: bool = False) -> DataFrame:
    """The same of SubStation files: dialogue lines with the usual ten fields; override blocks are dropped."""
    lines = _files(spark, path).select("file", F.posexplode(F.split("value", "\n")).alias("block", "b")).where(F.col("b").rlike(r"^Dialogue:"))
    f = F.split(F.regexp_replace("b", r"^Dialogue:\s*", ""), ",", 10)
    text = F.regexp_replace(F.regexp_replace(F.try_element_at(f, F.lit(10)), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    rows = lines.select("file", "block", _ms(F.trim(f[1]), _ASS_TIME, digits=2).alias("start_ms"), _ms(F.trim(f[2]), _ASS_TIME, digits=2).alias("end_ms"), F.regexp_replace(text, r"\\h", " ").alias("text"))
    return _finish(rows, keep_newlines)


def pick_track(tracks: DataFrame, lang: str) -> DataFrame:
    """Of each source's subtitle tracks (source, code, auto) the one for a language: the code itself, else the first code
    of the same base; made by hand before automatic."""
    base = F.split("code", "-")[0]
    fits = tracks.where(base == lang.split("-")[0]).withColumn("_o", F.struct(F.col("auto"), F.col("code") != lang, F.col("code")))
    return fits.groupBy("source").agg(F.min_by(F.struct("code", "auto"), "_o").alias("t")).select("source", "t.code", "t.auto")


def worth_ranging(duration: Column, start: Column, length: Column) -> Column:
    """Whether only a part of a long source is fetched."""
    return (duration > 600) & (start + length < duration * 0.9) & (length < duration / 3)


def openly_licensed(license: Column) -> Column:
    return license.isin("creativeCommons", "cc-by")


def preview_range(duration: Column, seconds: float = 60.0) -> Column:
    """A part from just before the middle; null where the whole is hardly longer."""
    return F.when(duration > seconds * 1.5, F.struct(F.greatest(F.lit(0.0), duration * 0.45).alias("start_s"), F.lit(seconds).alias("seconds")))
