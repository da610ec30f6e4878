"""Fitting rendered lines to their windows, and laying them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import speakable
from ..schema import SPOKEN_CPS, Fit
from .cues import in_order

SLACK = 1e-9


def _spoken(text: Column) -> Column:
    """Seconds of a line as it is spoken, without what an engine isn't given."""
    return F.char_length(speakable(text)) / F.lit(SPOKEN_CPS)


def fit(cues: DataFrame, config: Fit = Fit()) -> DataFrame:
    """cues(track_id, idx, start_s, end_s, gap_s, text, rendered_dur, source_speech) with stretch, engine_speed, borrowed,
    overrun, final_dur and outcome.

    A line that is short is slowed towards the original's speech; one that is long borrows from the pause after it, is
    spoken faster, then stretched, and what is left is an overrun. Speed and stretch divide the duration where no engine
    gives a measured one."""
    c = config
    window = F.col("end_s") - F.col("start_s")
    rows = cues.withColumn("window_s", window)
    # a short line
    reference = F.when(F.col("source_speech") > c.measured, F.col("source_speech")).otherwise(F.col("window_s"))
    rows = rows.withColumn("_target", F.least(reference, F.col("window_s")) * c.fill_share)
    slow = F.greatest(F.lit(c.fill_rate), F.col("rendered_dur") / F.col("_target"))
    fills = (F.col("rendered_dur") <= F.col("window_s")) & (F.col("rendered_dur") < F.col("_target")) & (F.col("rendered_dur") >= _spoken(F.col("text")) * c.fill_least) & (slow <= c.fill_skip)
    rows = rows.withColumn("_borrow", F.greatest(F.lit(0.0), F.least(F.lit(c.max_borrow), F.col("gap_s") - c.keep_gap))).withColumn("_budget", F.col("window_s") + F.col("_borrow"))
    long = F.col("rendered_dur") > F.col("_budget")
    faster = F.least(F.col("rendered_dur") / F.col("_budget"), F.lit(c.max_speed)) if c.supports_speed else F.lit(1.0)
    rows = rows.withColumn("engine_speed", F.when(long & (faster > c.least_change), faster).otherwise(1.0))
    rows = rows.withColumn("_dur", F.col("rendered_dur") / F.col("engine_speed"))
    still = long & (F.col("_dur") > F.col("_budget") + SLACK)
    need = F.col("_dur") / F.col("_budget")
    first_cap = c.cap_with_speed if c.supports_speed else c.cap_without_speed
    rate = F.when(need > first_cap, F.least(need, F.lit(c.max_stretch))).otherwise(need)
    rows = rows.withColumn("stretch", F.when(fills, slow).when(still & (rate > c.least_change), rate).otherwise(1.0))
    rows = rows.withColumn("final_dur", F.col("_dur") / F.col("stretch"))
    borrowed = F.greatest(F.lit(0.0), F.least(F.col("final_dur"), F.col("_budget")) - F.col("window_s"))
    over = F.col("final_dur") - F.col("_budget")
    rows = rows.withColumn("borrowed", F.when(F.col("rendered_dur") > F.col("window_s"), borrowed).otherwise(0.0)).withColumn("overrun", F.when(long & (over > c.overrun), over).otherwise(0.0))
    return rows.withColumn("outcome", outcome()).drop("_target", "_borrow", "_budget", "_dur")


def outcome(truncated: Column | None = None) -> Column:
    """What was done to a line; the first that holds."""
    cut = (truncated > 0.15) if truncated is not None else F.lit(False)
    return F.when(cut, "cut").when(F.col("overrun") > 0, "overrun").when(F.col("stretch") < 1, "filled").when(F.col("stretch") > 1, "stretched").when(F.col("engine_speed") > 1, "resynth").when(F.col("borrowed") > 0, "borrowed").otherwise("clean")


def report(fitted: DataFrame, *keys: str) -> DataFrame:
    """Counts of lines by what was done; the counts overlap, as a line may be respoken and stretched."""
    return fitted.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("rendered_dur") <= F.col("window_s")).alias("clean"), F.count_if((F.col("borrowed") > 0)).alias("borrowed"), F.count_if(F.col("engine_speed") > 1).alias("resynth"),
        F.count_if(F.col("stretch") > 1).alias("stretched"), F.count_if(F.col("stretch") < 1).alias("filled"), F.count_if(F.col("overrun") > 0).alias("overrun"),
    )


def layout(fitted: DataFrame, config: Fit = Fit()) -> DataFrame:
    """placed_s, truncated and overlapped: a line may run into the pause, and a little over the next line if that has a
    speaker and another one (a line without a speaker differs from any)."""
    free = F.col("window_s") + F.col("gap_s") - config.keep_gap
    after = F.lead("speaker").over(in_order())
    rows = fitted.withColumn("_free", free).withColumn("_room", F.col("_free") + F.when((after != "") & ~after.eqNullSafe(F.col("speaker")), config.overlap_other).otherwise(0.0))
    rows = rows.withColumn("truncated", F.greatest(F.lit(0.0), F.col("final_dur") - F.col("_room"))).withColumn("_kept", F.col("final_dur") - F.col("truncated"))
    over = F.col("_kept") - F.col("_free")
    rows = rows.withColumn("overlapped", F.when((F.col("_free") > 0) & (over > SLACK), over).otherwise(0.0))
    return rows.withColumn("placed_s", F.greatest(F.lit(0.0), F.col("start_s") + F.col("speech_onset"))).drop("_free", "_room", "_kept")


def register_ratio(takes: DataFrame, memory: int = 16) -> DataFrame:
    """ratio: median of a speaker's last target/median pitch ratios, and the shift in semitones, none within 0.75."""
    w = Window.partitionBy("track_id", "speaker").orderBy("idx").rowsBetween(-(memory - 1), 0)
    rows = takes.withColumn("ratio", F.percentile(F.col("target_f0") / F.col("median_f0"), F.lit(0.5)).over(w))
    shift = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), F.lit(12.0) * F.log2("ratio")))
    return rows.withColumn("shift", F.when(F.abs(shift) < 0.75, 0.0).otherwise(shift))


def best_take(takes: DataFrame) -> DataFrame:
    """Of each line's takes (take, liveliness, register_off, dead_s, broken) the best whole one; the first of equal ones."""
    score = F.col("liveliness") - F.lit(2.0) * F.col("register_off") - F.lit(3.0) * F.col("dead_s")
    return takes.where("not broken").groupBy("track_id", "idx").agg(F.max(F.struct(score.alias("score"), (-F.col("take")).alias("_t"))).alias("b")).select("track_id", "idx", (-F.col("b._t")).alias("take"), F.col("b.score").alias("score"))
