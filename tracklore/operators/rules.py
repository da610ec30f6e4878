"""Data-quality rules of rendered tracks, and the ledger of confidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import band
from ..schema import OK, SPOKEN_CPS, UNRELIABLE, WEAK
from .cues import in_order

SILENCE, ABRUPT, HARSH, CUT = 0.005, 0.05, 1.30, 0.15


def _found(rules: list[tuple[Column, str, Column | str]]) -> Column:
    rows = [F.when(cond, F.struct(F.lit(kind).alias("kind"), (F.lit(sev) if isinstance(sev, str) else sev).alias("severity"))) for cond, kind, sev in rules]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def clip_problems(clips: DataFrame) -> DataFrame:
    """Problems of single lines; clips(track_id, idx, start_s, text, dur_s, peak, tail, dead_s, truncated, stretch)."""
    expected = F.char_length("text") / F.lit(SPOKEN_CPS)
    silent = (F.col("dur_s") <= 0) | (F.col("peak") < SILENCE)
    judged = expected > 0.4
    rules = [
        (F.col("truncated") > CUT, "cut off", F.when(F.col("tail") > ABRUPT, "bad").otherwise("warn")),
        (F.col("stretch") > HARSH, "over-stretched", "warn"),
        (judged & (F.col("dur_s") < expected * 0.45), "too short", "bad"),
        (judged & (F.col("dur_s") > expected * 2.5), "runaway", "bad"),
        (F.col("peak") > 0.999, "clipped", "warn"),
        ((F.col("dead_s") > 0.35) & (F.col("dead_s") > F.col("dur_s") * 0.25), "dead air", "bad"),
    ]
    found = F.when(silent, _found([(F.lit(True), "silent", "bad")])).otherwise(_found(rules))
    return clips.select("track_id", "idx", "start_s", F.explode(found).alias("p")).select("track_id", "idx", "start_s", "p.kind", "p.severity")


def track_problems(cues: DataFrame) -> DataFrame:
    """Lines that run into the next: of the same speaker, or for long."""
    after = F.lead("speaker").over(in_order())
    last = F.lead("idx").over(in_order()).isNull()
    rows = cues.select("track_id", "idx", "start_s", "speaker", "overlapped", after.alias("_after"), last.alias("_last"))
    same = (F.col("_after") == F.col("speaker")) & (F.col("speaker") != "")
    kind = F.when(F.coalesce(same, F.lit(False)), F.struct(F.lit("self-overlap").alias("kind"), F.lit("bad").alias("severity"))).when(F.col("overlapped") > 0.6, F.struct(F.lit("long overlap").alias("kind"), F.lit("warn").alias("severity")))
    return rows.where((F.col("overlapped") > 0.02) & ~F.col("_last")).withColumn("p", kind).where("p is not null").select("track_id", "idx", "start_s", "p.kind", "p.severity")


def problem_summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("kind").agg(F.count_if(F.col("severity") == "bad").alias("bad"), F.count_if(F.col("severity") == "warn").alias("warn"), F.count("*").alias("n"))


def serious(problems: DataFrame, n: int = 8) -> DataFrame:
    """The first n bad problems by time."""
    return problems.where("severity = 'bad'").orderBy("start_s", "track_id", "idx").limit(n)


def speaker_check(quality: Column, share: Column, k: Column) -> Column:
    """Level of a speaker split by its silhouette and its largest speaker's share."""
    return F.when((quality < 0.20) | ((share > 0.90) & (k > 1)), UNRELIABLE).when((quality < 0.40) | (share > 0.75), WEAK).otherwise(OK)


def coverage_check(share: Column) -> Column:
    return band(share, 0.85, 0.60)


def translation_check(share_over: Column) -> Column:
    return band(share_over, 0.10, 0.25, higher_is_better=False)


def references_check(made: Column, speakers: Column, weak: Column) -> Column:
    """Level of the cut voice references by how many speakers have one and how many are weak."""
    return F.when((speakers > 0) & (made == 0), UNRELIABLE).when((made < speakers) | (weak > 0), WEAK).otherwise(OK)


def ledger(checks: DataFrame) -> DataFrame:
    """Counts of checks by track and level; remedies of those that are not ok."""
    return checks.groupBy("track_id").agg(
        *[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in (OK, WEAK, UNRELIABLE)],
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("level") != OK, F.concat_ws(": ", "stage", "level")))), ", ").alias("flagged"),
    )
