"""Caption tracks: what kind they are, and their repair. Rows are events (track_id, seq, start_s, end_s, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EVENTS, OK, UNRELIABLE, WEAK

MEMORY, OVERLAP = 40, 12
_NO_TRACK = object()
REMEDY = "supply an authored subtitle track"


def _ordered():
    return Window.partitionBy("track_id").orderBy("seq")


def inspect(events: DataFrame) -> DataFrame:
    """One row a track: events, ended, duplicated, shared_edges, words, punctuated, rolling, kind, notes."""
    w = X.words(F.col("text"))
    rows = events.select("track_id", "seq", w.alias("w"), F.rtrim("text").rlike("[.!?]$").alias("ends")).withColumn("prev", F.lag("w").over(_ordered()))
    usable = (F.size("prev") > 0) & (F.size("w") > 0)
    # three equal first words (all of a shorter line) say as much as the whole common beginning
    few = F.least(F.lit(3), F.size("prev"))
    over = (F.slice("prev", F.lit(1), few) == F.slice("w", F.lit(1), few)) | (X.shared_tail(F.col("prev"), F.col("w")) > 0)
    one = rows.groupBy("track_id").agg(
        F.count("*").alias("events"),
        F.count_if("ends").alias("ended"),
        F.count_if(usable & (F.col("prev") == F.col("w"))).alias("duplicated"),
        F.count_if(F.when(usable, over).otherwise(False)).alias("shared_edges"),
        F.sum(F.size("w")).cast("long").alias("words"),
    )
    one = one.withColumn("punctuated", F.col("ended") > F.greatest(F.lit(2.0), F.col("events") * 0.15)).withColumn("rolling", (F.col("events") >= 4) & (F.col("shared_edges") > F.col("events") * 0.3))
    many = F.col("duplicated") > F.col("events") * 0.2
    kind = F.when(F.col("rolling"), "automatic captions (rolling)").when(many | ~F.col("punctuated"), "automatic captions").otherwise("subtitles")
    notes = F.array(
        F.when(F.col("rolling"), "each line repeats the previous one").when(many, F.concat(F.col("duplicated").cast("string"), F.lit(" repeated lines"))),
        F.when(~F.col("punctuated"), "no sentence punctuation"),
    )
    return one.withColumn("kind", kind).withColumn("notes", F.filter(notes, lambda x: x.isNotNull()))


def confidence(info: DataFrame, removed_words: str = "removed_words") -> DataFrame:
    """Level of each track as a script. info: inspect() of the track with the number of words that the repair removed;
    duplicated counts lines before the repair, events and words those after it."""
    level = (
        F.when(F.col("events") == 0, UNRELIABLE)
        .when(F.col("rolling") & (F.col(removed_words) > F.col("words")), UNRELIABLE)
        .when(~F.col("punctuated") | F.col("rolling") | (F.col("duplicated") > F.col("events") * 0.2), WEAK)
        .otherwise(OK)
    )
    return info.select("track_id", F.lit("subtitles").alias("stage"), level.alias("level"), "kind", F.when(level != OK, REMEDY).otherwise("").alias("remedy"))


def drop_repeats(events: DataFrame) -> DataFrame:
    """Runs of lines of equal words as one: the first text, the latest end."""
    rows = events.withColumn("_w", X.words(F.col("text"))).withColumn("_new", (F.coalesce(F.lag("_w").over(_ordered()) != F.col("_w"), F.lit(True))).cast("int"))
    runs = rows.withColumn("_run", F.sum("_new").over(_ordered()))
    return runs.groupBy("track_id", "_run").agg(F.min("seq").alias("seq"), F.min_by("start_s", "seq").alias("start_s"), F.max("end_s").alias("end_s"), F.min_by("text", "seq").alias("text")).drop("_run")


def untangle(events: DataFrame) -> DataFrame:
    """Lines end before the next begins, but not before 0.05 s."""
    after = F.lead("start_s").over(_ordered())
    return events.withColumn("end_s", F.when(after < F.col("end_s"), F.greatest(F.col("start_s") + 0.05, after)).otherwise(F.col("end_s")))


def _overlap(seen: list[str], cur: list[str]) -> int:
    for n in range(min(len(seen), len(cur), OVERLAP), 0, -1):
        if seen[-n:] == cur[:n]:
            return n
    tail, n = seen[-len(cur) :] if cur else [], 0
    while n < len(tail) and tail[n] == cur[n]:
        n += 1
    return n


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by track and seq; only the current track's last words are held."""
    track, seen, last = _NO_TRACK, [], None
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            track_id, seq, start, end, text = row
            if track_id != track:
                track, seen, last = track_id, [], None
            plain = (text or "").split()
            cur = [x.lower() for x in plain]
            n = _overlap(seen, cur)
            seen = (seen + cur[n:])[-MEMORY:]
            if plain[n:]:
                out.append((track_id, seq, min(start if last is None else max(start, last), end - 0.05), end, " ".join(plain[n:])))
                last = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), b.schema)], names=EVENTS.names)


def dedupe_rolling(events: DataFrame) -> DataFrame:
    """Only the words that each line adds to the last 40. A line's words depend on all before, so the rows of a track are
    read in order by one function; tracks are dealt out, and the state of one is 40 words."""
    return events.select(*EVENTS.names).repartition("track_id").sortWithinPartitions("track_id", "seq").mapInArrow(_roll, EVENTS)


def normalize(events: DataFrame) -> DataFrame:
    """The repaired events of all tracks: rolling ones by dedupe_rolling, others by drop_repeats, then untangle."""
    kind = inspect(events).select("track_id", "rolling")
    rows = events.join(kind, "track_id")
    rolled = dedupe_rolling(rows.where("rolling").drop("rolling"))
    return untangle(rolled.unionByName(drop_repeats(rows.where("not rolling").drop("rolling")).select(*EVENTS.names)))
