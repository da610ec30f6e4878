"""Voices for speakers, and references cut from their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

F0_SPLIT = 158.0


def speaker_lines(cues: DataFrame) -> DataFrame:
    """Lines of each speaker and their rank by number, of equal numbers the one that speaks first."""
    by = cues.where("speaker is not null and speaker <> ''").groupBy("track_id", "speaker").agg(F.count("*").alias("lines"), F.min("idx").alias("first_idx"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("lines"), "first_idx")))


def assign_voices(speakers: DataFrame, voices: DataFrame, default: str) -> DataFrame:
    """speakers: speaker_lines() with speaker_f0 (null: unknown); voices(gender, name, ord). Speakers of unknown pitch are
    female and male by turns; each takes the next voice of its pool, those beyond the pool its first."""
    by = Window.partitionBy("track_id").orderBy("rank")
    known = F.when(F.col("speaker_f0") >= F0_SPLIT, "F").when(F.col("speaker_f0") < F0_SPLIT, "M")
    turn = F.sum(F.col("speaker_f0").isNull().cast("int")).over(by) - 1
    rows = speakers.withColumn("gender", F.coalesce(known, F.when(F.pmod(turn, F.lit(2)) == 0, "F").otherwise("M")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("track_id", "gender").orderBy("rank")))
    pools = voices.groupBy("gender").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda v: v["name"]).alias("pool"))
    pick = F.when(F.col("_n") <= F.size("pool"), F.try_element_at("pool", F.col("_n"))).otherwise(F.try_element_at("pool", F.lit(1)))
    return rows.join(pools, "gender", "left").withColumn("voice", F.coalesce(pick, F.lit(default))).drop("_n", "pool")


def lead_voice(cues: DataFrame) -> DataFrame:
    """The speaker of most lines of each track."""
    return speaker_lines(cues).where("rank = 1").select("track_id", F.col("speaker").alias("lead"), "lines")


def common_voice(cues: DataFrame) -> DataFrame:
    """The voice of most lines of each speaker, and how many voices it has."""
    by = cues.groupBy("track_id", "speaker", "voice").agg(F.count("*").alias("n"), F.min("idx").alias("i"))
    return by.groupBy("track_id", "speaker").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), "voice"))["voice"].alias("voice"), F.count("voice").alias("voices"))


def pick_references(cues: DataFrame, seconds: float = 12.0, shortest: float = 1.0, floor: float = 1e-4, least: float = 4.0) -> DataFrame:
    """The best lines of each speaker (rms * min(dur, 6)) until they last `seconds`; the one that crosses counts. Lines
    that are short or silent don't, nor do speakers whose lines last less than `least` together."""
    score = F.col("rms") * F.least(F.col("dur_s"), F.lit(6.0))
    w = Window.partitionBy("track_id", "speaker").orderBy(F.desc("score"), "idx")
    good = cues.where((F.col("speaker") != "") & (F.col("dur_s") >= shortest) & (F.col("rms") >= floor))
    rows = good.withColumn("score", score).withColumn("rank", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum("dur_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(F.col("_before") < seconds * 1000)
    return rows.withColumn("_all", F.sum("dur_ms").over(Window.partitionBy("track_id", "speaker"))).where(F.col("_all") >= least * 1000).drop("_before", "_all")


def transcripts(references: DataFrame) -> DataFrame:
    """Text of each speaker's reference, in the order in which its lines are joined: by rank. The original text where a
    line has one."""
    said = F.coalesce(F.nullif(F.col("source_text"), F.lit("")), F.col("text")) if "source_text" in references.columns else F.col("text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))), lambda x: x["said"])
    return references.groupBy("track_id", "speaker").agg(F.trim(F.array_join(F.filter(lines, lambda x: x != ""), " ")).alias("transcript"))


def reference_for(cues: DataFrame, references: DataFrame) -> DataFrame:
    """cues with the reference of their speaker; of the lead, the speaker of most lines among those with a reference, where
    theirs has none. references(track_id, speaker, reference)"""
    ref = references.select("track_id", "speaker", "reference")
    lead = speaker_lines(cues.join(ref, ["track_id", "speaker"], "left_semi")).where("rank = 1").select("track_id", "speaker").join(ref, ["track_id", "speaker"]).select("track_id", F.col("reference").alias("_lead"))
    return cues.join(ref, ["track_id", "speaker"], "left").join(lead, "track_id", "left").withColumn("reference", F.coalesce("reference", "_lead")).drop("_lead")


def voiced_fraction(frames: DataFrame, *keys: str) -> DataFrame:
    """Share of frames with a pitch that is likely, and whether a reference is usable."""
    share = F.avg((F.col("f0").isNotNull() & (F.col("prob") > 0.5)).cast("int"))
    return frames.groupBy(*keys).agg(share.alias("voiced")).withColumn("usable", F.col("voiced") >= 0.004)
