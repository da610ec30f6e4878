"""Edited tables joined back to cues by their start, and what the edits need.

The key is the start in whole milliseconds. Of rows with the same key the later one holds; every cue of a key gets it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import budget_chars
from ..schema import EXPANSION, FALLBACK_CPS, SHEET_CPS


def key_of(start: str = "start_s"):
    return F.round(F.col(start) * 1000).cast("long")


def last_by_key(edits: DataFrame, key: str = "start_ms", order: str = "row") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return edits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)


def apply_texts(cues: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """cues(start_ms, text) with the texts of edits(start_ms, new_text), matched and changed. The side of edits is left to
    the planner: it broadcasts small ones."""
    on = [*keys, "start_ms"]
    rows = cues.join(edits.where(F.trim("new_text") != ""), on, "left")
    return rows.withColumn("matched", F.col("new_text").isNotNull()).withColumn("changed", F.coalesce(F.col("new_text") != F.col("text"), F.lit(False))).withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def apply_cast(cues: DataFrame, cast: DataFrame, *keys: str) -> DataFrame:
    """Speakers and voices of cast(start_ms, new_speaker, new_voice); blank cells leave what is there."""
    on = [*keys, "start_ms"]
    rows = cues.join(cast.withColumn("_hit", F.lit(True)), on, "left")
    filled = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return rows.withColumn("speaker", filled("new_speaker", "speaker")).withColumn("voice", filled("new_voice", "voice")).withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit", "new_speaker", "new_voice")


def require_matches(applied: DataFrame, name: str) -> DataFrame:
    """applied, with an error where not one of its rows was matched: the sheet is of other cues."""
    if applied.limit(1).count() and not applied.where("matched").limit(1).count():
        raise ValueError(f"{name} matches none of the cues: rows are matched by start, so it must come from a run over the same subtitles")
    return applied


def unknown_voices(cues: DataFrame, voices: DataFrame) -> DataFrame:
    """Voices that cues ask for and no engine has."""
    return cues.where("voice is not null and voice <> ''").select("voice").distinct().join(voices.select(F.col("name").alias("voice")), "voice", "left_anti")


def translation_budget(cues: DataFrame, lang: str) -> DataFrame:
    """budget and whether the text is over it."""
    rows = cues.withColumn("budget", budget_chars(F.col("end_s") - F.col("start_s"), lang).cast("long"))
    return rows.withColumn("over", F.char_length("text") > F.col("budget"))


def expansion_tight(cues: DataFrame, lang: str) -> DataFrame:
    """Lines that a translation of usual length would not fit."""
    return cues.where(F.char_length("text") * F.lit(EXPANSION.get(lang, 1.0)) > (F.col("end_s") - F.col("start_s")) * SHEET_CPS)


def overruns(fitted: DataFrame, cps: float = SHEET_CPS) -> DataFrame:
    """The editing sheet of lines that do not fit, the worst first."""
    budget = F.col("end_s") - F.col("start_s") + F.col("borrowed")
    return fitted.where("overrun > 0").select("track_id", "idx", "start_s", budget.alias("budget_s"), F.col("overrun").alias("over_s"), (budget * cps).cast("long").alias("max_chars"), F.char_length("text").cast("long").alias("cur_chars"), "text").orderBy(F.desc("over_s"), "track_id", "idx")


def chars_per_second(cues: DataFrame, *keys: str, least: int = 20) -> DataFrame:
    """Upper median of measured rates; the fallback where fewer than `least` lines are measured."""
    rate = F.when((F.col("rendered_dur") > 0.5) & (F.col("engine_speed") == 1), F.char_length("text") / F.col("rendered_dur"))
    # the first value that more than half of the values do not pass; counts of values are combined before the shuffle
    upper = F.expr("percentile_disc(0.500000001) within group (order by _rate)")
    return cues.withColumn("_rate", rate).groupBy(*keys).agg(F.when(F.count("_rate") < least, F.lit(FALLBACK_CPS)).otherwise(upper).alias("cps"))


def best_translation(replies: DataFrame) -> DataFrame:
    """Of the rounds' replies the shortest acceptable one of each line; the earlier of equal ones."""
    ok = replies.where("acceptable and text <> ''")
    return ok.groupBy("track_id", "idx").agg(F.min_by("text", F.struct(F.char_length("text"), F.col("round"))).alias("text"))
