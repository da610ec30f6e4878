"""Cues: from events to lines of speech, and their neighbours in time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def in_order(*more: str) -> Window:
    return Window.partitionBy("track_id", *more).orderBy("idx")


def windowed(cues: DataFrame) -> DataFrame:
    return cues.withColumn("window_s", F.col("end_s") - F.col("start_s"))


def merge_policy(punctuated: Column) -> tuple[Column, Column]:
    """Largest gap and span of lines that are put together."""
    return F.when(punctuated, 0.30).otherwise(0.24), F.when(punctuated, 12.0).otherwise(5.0)


def split_events(events: DataFrame) -> DataFrame:
    """Events by speaker: lines of dialogue dashes apart, each with its share of the window by length; lines that are no
    speech are left out."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.squeeze), lambda x: x != "")
    parts = events.select("track_id", "seq", "start_s", "end_s", F.posexplode(X.speaker_parts(lines)).alias("part", "raw"))
    parts = parts.withColumn("text", X.clean_line(F.col("raw"))).where(~X.is_dropped(F.col("text")))
    w = Window.partitionBy("track_id", "seq").orderBy("part")
    n = F.char_length("text").cast("long")
    upto = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy("track_id", "seq"))
    span = F.col("end_s") - F.col("start_s")
    return parts.select("track_id", "seq", "part", "text", (F.col("start_s") + span * (upto - n) / total).alias("start_s"), (F.col("start_s") + span * upto / total).alias("end_s"))


_MERGED = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("idx", T.LongType())])
_ARROW = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.int64()]


def _fold(batches: Iterator[pa.RecordBatch], max_span: float) -> Iterator[pa.RecordBatch]:
    """Rows come by track and idx; only the line that is being put together is held."""
    line: list | None = None  # track, first, start, end, texts, members, idx

    def batch(lines: list[list]) -> pa.RecordBatch:
        for x in lines:
            x[4] = " ".join(x[4]) if x[4] else None
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), _ARROW)], names=_MERGED.names)

    for b in batches:
        out: list[list] = []
        for track_id, idx, start, end, text, new in zip(*(c.to_pylist() for c in b.columns)):
            said = [] if text is None else [text]
            same = line is not None and line[0] == track_id
            if same and not new and None not in (end, line[2]) and end - line[2] <= max_span:
                line[3] = end
                line[4] += said
                line[5].append(idx)
            else:
                if line is not None:
                    out.append(line)
                line = [track_id, idx, start, end, said, [idx], line[6] + 1 if same else 0]
        if out:
            yield batch(out)
    if line is not None:
        yield batch([line])


def merge_fragments(cues: DataFrame, max_gap: float = 0.30, max_span: float = 12.0) -> DataFrame:
    """Unfinished lines joined with the next ones: near in time, without an end of sentence between (or the next in
    lower case), the whole no longer than max_span.

    Which pairs may be joined is found by window functions; where a line ends for its span depends on all before, so the
    rows of a track are read in order by one function."""
    prev_end, prev_text = F.lag("end_s").over(in_order()), F.lag("text").over(in_order())
    joins = (F.col("start_s") - prev_end <= max_gap) & (~X.is_terminal(prev_text) | X.starts_lower(F.col("text")))
    rows = cues.select("track_id", "idx", "start_s", "end_s", "text", (~F.coalesce(joins, F.lit(False))).alias("_new"))
    return rows.repartition("track_id").sortWithinPartitions("track_id", "idx").mapInArrow(lambda batches: _fold(batches, max_span), _MERGED)


def gaps(cues: DataFrame, total: str = "total_s") -> DataFrame:
    """gap_s: silence after each cue; after the last one, up to the track's total."""
    return cues.withColumn("gap_s", F.greatest(F.lit(0.0), F.coalesce(F.lead("start_s").over(in_order()), F.col(total)) - F.col("end_s")))


def slice_cues(cues: DataFrame, start: float, seconds: float, least: float = 0.8) -> DataFrame:
    """Cues of a stretch of each track, counted from its start; a cue over the edge stays if least of it is visible."""
    end = start + seconds
    rows = cues.where((F.col("end_s") > start) & (F.col("start_s") < end))
    seen = F.least(F.col("end_s"), F.lit(end)) - F.greatest(F.col("start_s"), F.lit(start))
    rows = rows.where((F.col("start_s") >= start) & (F.col("end_s") <= end) | (seen >= (F.col("end_s") - F.col("start_s")) * least))
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("start_s", "idx")).cast("long") - 1
    return rows.select("track_id", idx.alias("new_idx"), "idx", F.greatest(F.lit(0.0), F.col("start_s") - start).alias("start_s"), F.least(F.lit(float(seconds)), F.col("end_s") - start).alias("end_s"), "speaker", "text")


def context(cues: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Texts of the neighbours, joined, and the characters that fit the window."""
    near = lambda a, b: F.array_join(F.collect_list("text").over(in_order().rowsBetween(a, b)), " | ")
    return cues.withColumn("prev", near(-before, -1)).withColumn("next", near(1, after)).withColumn("max_chars", ((F.col("end_s") - F.col("start_s")) * 15.0).cast("long"))
