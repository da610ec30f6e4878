"""Joins on time within a track, and runs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _cells(windows: DataFrame, bucket: float, start: str, end: str) -> DataFrame:
    return windows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))


def interval_join(points: DataFrame, windows: DataFrame, bucket: float, t: str = "t", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Points within windows of their track, both ends included; a point may lie in several. Time is cut into cells of
    `bucket` seconds, so the join is on (track, cell) and its work follows the matches. Choose about a window's length."""
    left = points.withColumn("_cell", F.floor(F.col(t) / bucket))
    return left.join(_cells(windows, bucket, start, end), ["track_id", "_cell"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_cell")


def interval_anti(points: DataFrame, windows: DataFrame, bucket: float, t: str = "t", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Points in no window of their track."""
    left = points.withColumn("_cell", F.floor(F.col(t) / bucket))
    right = _cells(windows, bucket, start, end).select(F.col("track_id").alias("_t"), F.col("_cell").alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    on = (F.col("track_id") == F.col("_t")) & (F.col("_cell") == F.col("_c")) & F.col(t).between(F.col("_s"), F.col("_e"))
    return left.join(right, on, "left_anti").drop("_cell")


def interval_semi(points: DataFrame, windows: DataFrame, bucket: float, pad: float, every: int, frame: str = "frame_no", t: str = "t") -> DataFrame:
    """Frames in a window widened by pad, and every n-th of the others."""
    wide = windows.select("track_id", (F.col("start_s") - pad).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
    outside = interval_anti(points, wide, bucket, t)
    left = points.withColumn("_cell", F.floor(F.col(t) / bucket))
    right = _cells(wide, bucket, "start_s", "end_s").select(F.col("track_id").alias("_t"), F.col("_cell").alias("_c"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    inside = left.join(right, (F.col("track_id") == F.col("_t")) & (F.col("_cell") == F.col("_c")) & F.col(t).between(F.col("_s"), F.col("_e")), "left_semi").drop("_cell")
    return inside.unionByName(outside.where(F.pmod(F.col(frame), F.lit(every)) == 0))


def _from_start(*order: Column) -> WindowSpec:
    """The rows of a track up to the present one. What lies ahead is looked up in falling order by it as well: Spark goes
    through all following rows anew for each row where a window ends with the last one."""
    return Window.partitionBy("track_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def interpolated(samples: DataFrame, at: DataFrame, t: str = "t", value: str = "value") -> DataFrame:
    """value at the times of `at` (track_id, t), linear between the samples before and after, held at the edges; both
    sides go through one window of the track, so neither is joined to the other."""
    known = samples.groupBy("track_id", t).agg(F.avg(value).alias("_v")).select("track_id", t, "_v", F.lit(None).cast("boolean").alias("_ask"), F.col(t).alias("_t"))
    asked = at.select("track_id", t, F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_ask"), F.lit(None).cast("double").alias("_t"))
    both = known.unionByName(asked)
    # of equal times the sample comes first, so what is asked at it finds it behind
    back, ahead = _from_start(F.col(t).asc(), F.col("_ask").asc_nulls_first()), _from_start(F.col(t).desc(), F.col("_ask").desc_nulls_last())
    rows = both.select("track_id", t, "_ask", F.last("_v", True).over(back).alias("v0"), F.last("_t", True).over(back).alias("t0"), F.last("_v", True).over(ahead).alias("v1"), F.last("_t", True).over(ahead).alias("t1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    exact = F.col("t0") == F.col(t)
    return rows.where("_ask").select("track_id", t, F.when(exact, F.col("v0")).when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(between).alias(value))


def nearest_filled(rows: DataFrame, label: str = "label", order: str = "idx") -> DataFrame:
    """Labels of rows without one from the labelled row next in order; the earlier of two as near."""
    # of equal ones those with a label come first in both directions
    known = F.col(label).asc_nulls_last()
    back, ahead = _from_start(F.col(order).asc(), known), _from_start(F.col(order).desc(), known)
    at = F.when(F.col(label).isNotNull(), F.col(order))
    rows = rows.withColumns({"_l0": F.last(label, True).over(back), "_i0": F.last(at, True).over(back), "_l1": F.last(label, True).over(ahead), "_i1": F.last(at, True).over(ahead)})
    before = F.col("_i1").isNull() | (F.col(order) - F.col("_i0") <= F.col("_i1") - F.col(order))
    return rows.withColumn(label, F.when(before, F.coalesce("_l0", "_l1")).otherwise(F.col("_l1"))).drop("_l0", "_i0", "_l1", "_i1")


def islands(rows: DataFrame, boundary: Column, order: str, *keys: str, name: str = "island") -> DataFrame:
    """Number of the run of each row; boundary: whether a row begins a new one."""
    return rows.withColumn(name, F.sum(F.coalesce(boundary, F.lit(True)).cast("int")).over(Window.partitionBy(*keys).orderBy(order)))
