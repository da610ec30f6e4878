"""Frames of sound and pictures; frames(track_id, frame_no, energy) of a fixed step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measure import decibels, plausible_pitch
from .intervals import interval_anti, interval_join, islands

STEP = 0.02


def framed(samples: Column, size: int) -> Column:
    """Mean magnitude of each whole frame of an array of samples."""
    at = F.sequence(F.lit(0), F.greatest(F.floor(F.size(samples) / size).cast("int") - 1, F.lit(0)))
    mean = F.transform(at, lambda i: F.aggregate(F.slice(samples, i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + F.abs(x)) / size)
    return F.when(F.size(samples) >= size, mean).otherwise(F.array().cast("array<double>"))


def cut_samples(samples: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples of a stretch, clamped to what there is."""
    first = F.greatest((start * rate).cast("int"), F.lit(0))
    return F.slice(samples, first + 1, F.greatest((end * rate).cast("int") - first, F.lit(0)))


def _cue_frames(frames: DataFrame, cues: DataFrame, start: Column, end: Column, step: float, bucket: float) -> DataFrame:
    """Whole frames of each cue's stretch, with the stretch's peak; frames begin at frame_no * step."""
    windows = cues.select("track_id", "cue", start.alias("start_s"), end.alias("end_s"), F.col("start_s").alias("cue_s"))
    at = frames.withColumn("t", F.col("frame_no") * step)
    inside = interval_join(at, windows, bucket).where(F.col("t") + step <= F.col("end_s") + step / 2)
    return inside.withColumn("_peak", F.max("energy").over(Window.partitionBy("track_id", "cue")))


def speech_seconds(frames: DataFrame, cues: DataFrame, step: float = STEP, bucket: float = 5.0) -> DataFrame:
    """Seconds of each cue (track_id, cue, start_s, end_s) whose frames are above 6 % of the cue's peak and a floor; 0
    where it has no frame or no sound."""
    inside = _cue_frames(frames, cues, F.col("start_s"), F.col("end_s"), step, bucket)
    loud = F.count_if((F.col("_peak") > 0) & (F.col("energy") > F.greatest(F.lit(0.004), F.col("_peak") * 0.06)))
    found = inside.groupBy("track_id", "cue").agg((loud * step).alias("speech_s"))
    return cues.select("track_id", "cue").join(found, ["track_id", "cue"], "left").withColumn("speech_s", F.coalesce("speech_s", F.lit(0.0)))


def onset(frames: DataFrame, cues: DataFrame, step: float = STEP, back: float = 0.35, reach: float = 4.0, bucket: float = 5.0) -> DataFrame:
    """Seconds from each cue's start to the first frame above 10 % of the peak and a floor, looked for from `back` seconds
    before the cue to its end, `reach` seconds at most; 0 with fewer than three frames, or none that loud."""
    inside = _cue_frames(frames, cues, F.greatest(F.lit(0.0), F.col("start_s") - back), F.least(F.col("end_s"), F.col("start_s") + reach), step, bucket)
    loud = (F.col("_peak") > 0) & (F.col("energy") > F.greatest(F.lit(0.006), F.col("_peak") * 0.10))
    found = inside.groupBy("track_id", "cue").agg(F.count("*").alias("_n"), (F.min(F.when(loud, F.col("t"))) - F.first("cue_s")).alias("onset_s"))
    return cues.select("track_id", "cue").join(found, ["track_id", "cue"], "left").select("track_id", "cue", F.when(F.col("_n") >= 3, F.coalesce("onset_s", F.lit(0.0))).otherwise(0.0).alias("onset_s"))


def quiet_runs(frames: DataFrame, level: float, longer: float, step: float = STEP) -> DataFrame:
    """Runs of quiet frames that touch neither edge of the track and last longer."""
    w = Window.partitionBy("track_id").orderBy("frame_no")
    rows = frames.withColumn("_quiet", F.col("energy") < level).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("track_id")))
    rows = islands(rows, F.lag("_quiet").over(w) != F.col("_quiet"), "frame_no", "track_id")
    runs = rows.where("_quiet").groupBy("track_id", "island").agg(F.min("frame_no").alias("first_frame"), F.count("*").alias("frames"), F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.first("_n").alias("_n"))
    return runs.where((F.col("_a") > 1) & (F.col("_b") < F.col("_n")) & (F.col("frames") * step > longer)).select("track_id", "first_frame", "frames", (F.col("frames") * step).alias("seconds"))


def shortened_pauses(frames: DataFrame, level: float, keep: int) -> DataFrame:
    """Frames without the middle of inner pauses: `keep` stay on each side."""
    w = Window.partitionBy("track_id").orderBy("frame_no")
    rows = islands(frames.withColumn("_quiet", F.col("energy") < level), F.lag("_quiet").over(w) != (F.col("energy") < level), "frame_no", "track_id")
    run = Window.partitionBy("track_id", "island")
    rows = rows.withColumn("_i", F.row_number().over(run.orderBy("frame_no"))).withColumn("_n", F.count("*").over(run)).withColumn("_last", F.max("island").over(Window.partitionBy("track_id")))
    inner = F.col("_quiet") & (F.col("island") > 1) & (F.col("island") < F.col("_last"))
    return rows.where(~(inner & (F.col("_i") > keep) & (F.col("_i") <= F.col("_n") - keep))).select(*frames.columns)


def moving_mean(frames: DataFrame, k: int) -> DataFrame:
    """Mean over k frames around each; beyond the edges counts as zero."""
    w = Window.partitionBy("track_id").orderBy("frame_no").rowsBetween(-(k // 2), k - 1 - k // 2)
    return frames.withColumn("mean", F.sum("energy").over(w) / k)


def speech_gate(frames: DataFrame, step: float = STEP, attack: float = 0.05, share: float = 0.12) -> DataFrame:
    """gate: 0 to 1 as the voice's energy comes up to a share of its peak, as a mean over the attack; 0 without sound."""
    peak = F.max("energy").over(Window.partitionBy("track_id"))
    level = F.when(peak > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("energy") / F.greatest(peak * share, F.lit(1e-6))))).otherwise(0.0)
    rows = frames.withColumn("_energy", F.col("energy")).withColumn("energy", level)
    return moving_mean(rows, max(1, int(attack / step))).withColumnRenamed("mean", "gate").drop("energy").withColumnRenamed("_energy", "energy")


def detrended(rows: DataFrame, value: str = "value", order: str = "t", *keys: str) -> DataFrame:
    """value less the median of the seven rows around it."""
    w = Window.partitionBy("track_id", *keys).orderBy(order).rowsBetween(-3, 3)
    return rows.withColumn("detrended", F.col(value) - F.percentile(value, F.lit(0.5)).over(w))


def shot_cuts(frames: DataFrame, most: float = 18.0) -> DataFrame:
    """scene: number of the shot, by jumps of the pictures' mean level."""
    w = Window.partitionBy("track_id").orderBy("frame_no")
    return frames.withColumn("scene", F.sum((F.abs(F.col("level") - F.lag("level").over(w)) > most).cast("int")).over(w)).fillna({"scene": 0})


def quietest_cut(frames: DataFrame, before: float, step: float = 0.01) -> DataFrame:
    """The quietest frame of the last `before` seconds, where a line is cut; the earlier of equal ones."""
    w = Window.partitionBy("track_id")
    rows = frames.withColumn("_last", F.max("frame_no").over(w)).where((F.col("_last") - F.col("frame_no")) * step < before)
    return rows.groupBy("track_id").agg(F.min(F.struct("energy", "frame_no")).alias("m")).select("track_id", "m.frame_no")


def pitch_stats(pitch: DataFrame, *keys: str, least: int = 8) -> DataFrame:
    """Median of plausible pitches and the span between the 10th and 90th percentile in semitones; null below `least`."""
    rows = pitch.where(plausible_pitch(F.col("f0"))).groupBy(*keys).agg(F.count("*").alias("voiced"), F.percentile("f0", F.lit(0.5)).alias("_m"), F.percentile(F.log2("f0"), F.array(F.lit(0.1), F.lit(0.9))).alias("_p"))
    return rows.select(*keys, "voiced", F.when(F.col("voiced") >= least, F.col("_m")).alias("median_f0"), F.when(F.col("voiced") >= least, (F.col("_p")[1] - F.col("_p")[0]) * 12).alias("range_semitones"))


def terminal_slope(tail: DataFrame, *keys: str, least: int = 6) -> DataFrame:
    """Semitones a second over the pitches of a line's end; 0 below `least`."""
    return tail.groupBy(*keys).agg(F.when(F.count("f0") >= least, F.regr_slope(F.lit(12.0) * F.log2("f0"), F.col("t"))).otherwise(0.0).alias("f0_end_slope"))


def intensity(levels: DataFrame, *keys: str, least: int = 3, shortest: float = 0.15, floor: float = 1e-5) -> DataFrame:
    """Level of each cue (rms, dur_s) in dB against the median of its speaker; 0 where the speaker has fewer than `least`,
    and of cues that are too short or below the floor, which count for no median."""
    w = Window.partitionBy(*keys)
    rows = levels.withColumn("_db", F.when((F.col("rms") > floor) & (F.col("dur_s") >= shortest), decibels(F.col("rms"))))
    return rows.withColumn("intensity", F.when((F.count("_db").over(w) >= least) & F.col("_db").isNotNull(), F.col("_db") - F.percentile("_db", F.lit(0.5)).over(w)).otherwise(0.0)).drop("_db")


def mouth_baselines(samples: DataFrame, windows: DataFrame, bucket: float, least: int = 4) -> DataFrame:
    """Spread of each face's detrended mouth movement outside of all lines of its track; a floor, and a default for few
    samples. samples(track_id, face, t, value)"""
    moves = detrended(interval_anti(samples, windows, bucket), "value", "t", "face")
    stats = moves.groupBy("track_id", "face").agg(F.count("*").alias("n"), F.stddev_pop("detrended").alias("sd"))
    faces = samples.select("track_id", "face").distinct().join(stats, ["track_id", "face"], "left")
    return faces.select("track_id", "face", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.greatest(F.lit(0.02), F.col("sd"))).otherwise(0.05).alias("baseline"))


def cue_scores(samples: DataFrame, windows: DataFrame, baselines: DataFrame, bucket: float, least: int = 3, smallest: float = 0.03) -> DataFrame:
    """How much each face moves its mouth in each line, against its own baseline, and with the sound: min(motion, 1) *
    (0.5 + 0.5 * correlation). Faces of few frames or a small mean size are left out; a correlation needs three samples
    and some spread of both. samples(track_id, face, t, value, level, size)"""
    inside = interval_join(samples.select("track_id", "face", "t", "value", "level", "size"), windows.select("track_id", "cue", "start_s", "end_s"), bucket)
    moves = detrended(inside, "value", "t", "cue", "face")
    spread = F.least(F.stddev_pop("value"), F.stddev_pop("level"))
    r = F.when((F.count("*") >= 3) & (spread > 1e-6), F.try_divide(F.covar_pop("value", "level"), F.stddev_pop("value") * F.stddev_pop("level")))
    stats = moves.groupBy("track_id", "cue", "face").agg(F.count("*").alias("n"), F.stddev_pop("detrended").alias("sd"), F.avg("size").alias("_size"), r.alias("r")).where((F.col("n") >= least) & (F.col("_size") >= smallest))
    motion = F.col("sd") / (F.lit(3.0) * F.col("baseline") + 1e-6)
    together = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(0.0))
    return stats.join(baselines.select("track_id", "face", "baseline"), ["track_id", "face"]).select("track_id", "cue", "face", "n", (F.least(motion, F.lit(1.0)) * (F.lit(0.5) + F.lit(0.5) * together)).alias("score"))


def cue_winners(scores: DataFrame, least: float = 0.35, lead: float = 0.15) -> DataFrame:
    """The face of each line that scores enough and leads the next one enough."""
    w = Window.partitionBy("track_id", "cue").orderBy(F.desc("score"), "face")
    rows = scores.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return rows.where((F.col("_n") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("_next") >= lead)).select("track_id", "cue", "face", "score")


def reject_reason(r: DataFrame) -> DataFrame:
    """Why a track's pictures don't name speakers, the first that holds; null where they do."""
    c = F.col
    return r.withColumn(
        "reject",
        F.when(~c("has_video"), "no video").when(~c("installed"), "no scanner").when(~c("scanned"), "scan failed").when(c("faces") == 0, "no faces").when(c("characters") < 2, "one character")
        .when(c("silhouette") < 0.10, "characters alike").when(c("labelled") < 0.25, "few lines labelled").when(c("top_share") > 0.80, "one character in most lines"),
    )
