"""From files to cues, rounds of translation, and arrays of samples on their way to the mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measure import budget_chars, clip, squeezed
from ..functions.rx import rx
from ..functions.text import RUSSIAN, clean_reply
from ..schema import CUES, SPOKEN_CPS
from . import captions, cues


def load_cues(events: DataFrame) -> DataFrame:
    """Cues of events: repaired, split by speaker, cleaned, and joined by each track's policy."""
    info = captions.inspect(events).select("track_id", "punctuated")
    parts = cues.split_events(captions.normalize(events))
    parts = parts.withColumn("idx", F.expr("row_number() over (partition by track_id order by start_s, seq, part) - 1").cast("long")).join(info, "track_id")
    joined = [cues.merge_fragments(parts.where(cond).drop("punctuated"), gap, span) for cond, gap, span in (("punctuated", 0.30, 12.0), ("not punctuated", 0.24, 5.0))]
    return joined[0].unionByName(joined[1])


def empty_cues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CUES)


def choose_source(given: Column, fetched: Column, embedded: Column) -> Column:
    """The subtitles that are used: given by hand, fetched with the video, or in it."""
    return F.coalesce(given, fetched, embedded)


def stage_list(translate: Column, clone: Column, diarize: Column, engine: Column, target: str = "llm") -> Column:
    """Stages of a run by its options, in order."""
    picked = [
        F.lit("separate"), F.when(diarize, "diarize"), F.when(translate, f"translate_{target}"), F.lit("prosody"), F.when(clone, "references"),
        F.concat(F.lit("synth_"), engine), F.when(clone & (engine != "chatterbox"), "convert"), F.lit("mux"),
    ]
    return F.filter(F.array(*picked), lambda s: s.isNotNull())


def engines_for(engines: DataFrame, lang: str) -> DataFrame:
    """Engines whose languages (null: any) hold the language."""
    return engines.where(F.col("langs").isNull() | F.array_contains("langs", lang))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path and fingerprint (size and time of change) of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_timestamp("modificationTime").cast("string")).alias("fingerprint"))


def reusable(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artefacts of the manifest whose inputs are as they were."""
    return current.join(manifest.select("artefact", "key"), ["artefact", "key"], "left_semi")


def translate_rounds(lines: DataFrame, ask: Callable[[DataFrame], DataFrame], lang: str, rounds: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Translations of lines(track_id, idx, text, budget_s) in rounds: lines whose reply is empty, too long or in the wrong
    language are asked again with a tighter limit; of a line's replies the shortest acceptable one holds. ask: adds reply to
    rows with prompt; keep: cuts lineage (a checkpoint or a written table), so a round is asked once."""
    limit = budget_chars(F.col("budget_s"), lang)
    left, replies = lines, None
    for turn in range(rounds):
        prompts = left.withColumn("limit", squeezed(limit, F.lit(turn)) if turn else limit).withColumn("prompt", F.concat(F.lit("In at most "), F.col("limit").cast("string"), F.lit(" characters: "), F.col("text")))
        got = ask(prompts).withColumn("reply", clean_reply(F.col("reply")))
        wrong = F.col("reply").rlike(rx(RUSSIAN, True)) if lang == "uk" else F.lit(False)
        ok = (F.col("reply") != "") & (F.char_length("reply") <= limit) & ~wrong
        got = keep(got.select("track_id", "idx", F.col("reply").alias("text"), F.coalesce(ok, F.lit(False)).alias("acceptable"), F.lit(turn).alias("round")))
        replies = got if replies is None else replies.unionByName(got)
        left = lines.join(replies.where("acceptable").select("track_id", "idx").distinct(), ["track_id", "idx"], "left_anti")
        if left.isEmpty():
            break
    return replies


def repaired_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words of each track before and after the repair, and how many it took away."""
    n = lambda df, name: df.groupBy("track_id").agg(F.count("*").alias(f"events_{name}"), F.sum(F.size(F.filter(F.split("text", rx(r"\s+")), lambda x: x != ""))).cast("long").alias(f"words_{name}"))
    rows = n(before, "before").join(n(after, "after"), "track_id", "left").fillna(0, ["events_after", "words_after"])
    return rows.withColumn("removed_words", F.col("words_before") - F.col("words_after"))


def delivery_summary(rows: DataFrame) -> DataFrame:
    """How many lines of a track are loud, quiet, rise at their end or were given a mark."""
    return rows.groupBy("track_id").agg(F.count_if(F.col("intensity") >= 3).alias("loud"), F.count_if(F.col("intensity") <= -3).alias("quiet"), F.count_if(F.col("f0_end_slope") >= 2).alias("rising"), F.count_if("punct_fixed").alias("marked"))


def broken_take(dur_s: Column, dead_s: Column, text: Column) -> Column:
    """Whether a take lost words or stalls."""
    said = F.char_length(text) / F.lit(SPOKEN_CPS)
    return ((said > 0.4) & (dur_s < said * 0.5)) | (dead_s > F.greatest(F.lit(0.4), dur_s * 0.3))


# Samples as arrays; for clips of seconds, not for whole tracks.


def peak_scaled(samples: Column, most: float = 0.99) -> Column:
    """Samples scaled so that none is beyond the limit."""
    top = F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0))
    return F.transform(samples, lambda x: F.when(top > most, x * (F.lit(most) / top)).otherwise(x))


def trimmed(samples: Column, level: float) -> Column:
    """Without the quiet samples of both ends."""
    loud = F.filter(F.transform(samples, lambda x, i: F.when(F.abs(x) > level, i)), lambda i: i.isNotNull())
    return F.when(F.size(loud) == 0, F.slice(samples, 1, 0)).otherwise(F.slice(samples, F.array_min(loud) + 1, F.array_max(loud) - F.array_min(loud) + 1))


def faded_out(samples: Column, n: int) -> Column:
    """The last n samples fall to nothing."""
    size = F.size(samples)
    return F.transform(samples, lambda x, i: x * F.least(F.lit(1.0), (size - 1 - i) / F.lit(float(n))))


def crossfaded(a: Column, b: Column, n: int) -> Column:
    """Two clips joined over n samples."""
    k = F.least(F.lit(n), F.size(a), F.size(b))
    mixed = F.transform(F.arrays_zip(F.slice(a, F.size(a) - k + 1, k).alias("x"), F.slice(b, F.lit(1), k).alias("y")), lambda p, i: p["x"] * (F.lit(1.0) - (i + 1) / (k + 1)) + p["y"] * ((i + 1) / (k + 1)))
    return F.concat(F.slice(a, F.lit(1), F.size(a) - k), mixed, F.slice(b, k + 1, F.size(b) - k))


def capped(samples: Column, rate: int, seconds: Column) -> Column:
    """A clip of at most so many seconds: cut after the quietest 10 ms of the last 250 ms before the limit, the first of
    equal ones, and faded out over 20 ms. A limit of nothing leaves a clip as it is."""
    limit = (F.greatest(seconds, F.lit(0.0)) * rate).cast("int")
    frame, reach = max(1, rate // 100), F.least(F.lit(rate // 4), limit)
    at = F.sequence(F.lit(0), F.greatest(F.floor(reach / frame).cast("int") - 1, F.lit(0)))
    level = F.transform(at, lambda k: F.struct(F.aggregate(F.slice(samples, limit - reach + k * frame + 1, F.lit(frame)), F.lit(0.0), lambda s, x: s + F.abs(x)).alias("sum"), k.alias("k")))
    cut = F.when(reach > frame, limit - reach + (F.array_min(level)["k"] + 1) * frame).otherwise(limit)
    short = F.slice(samples, F.lit(1), cut)
    n = F.least(F.lit(rate // 50), cut)
    faded = F.transform(short, lambda x, i: F.when((i >= cut - n) & (n > 1), x * (F.lit(1.0) - (i - (cut - n)) / (n - 1))).otherwise(x))
    return F.when((limit <= 0) | (F.size(samples) <= limit), samples).otherwise(faded)


def ducked_tail(samples: Column, rate: int, start: Column, gain_db: float) -> Column:
    """What runs past `start` seconds falls over 60 ms to a gain and stays there."""
    first, target = (F.greatest(start, F.lit(0.0)) * rate).cast("int"), 10.0 ** (gain_db / 20.0)
    ramp = F.least(F.lit(rate * 60 // 1000), F.size(samples) - first)
    falling = lambda i: F.lit(1.0) + (i - first) / F.greatest(ramp - 1, F.lit(1)) * F.lit(target - 1.0)
    return F.transform(samples, lambda x, i: F.when(i < first, x).when(i < first + ramp, x * falling(i)).otherwise(x * target))


def analysis_audio(vocals: Column, mix: Column) -> Column:
    """What voices and pitch are measured on: the vocal stem where there is one."""
    return F.coalesce(vocals, mix)


def tail_level(samples: Column, rate: int, ms: int = 30) -> Column:
    """Mean magnitude of the last milliseconds."""
    n = F.least(F.lit(rate * ms // 1000), F.size(samples))
    return F.when(n > 0, F.aggregate(F.slice(samples, F.size(samples) - n + 1, n), F.lit(0.0), lambda s, x: s + F.abs(x)) / n).otherwise(0.0)


def duck_ratio(duck: Column, bed: Column) -> Column:
    """Compression of the music under speech, within 2 to 20; less where a bed is kept."""
    return clip(F.when(bed, duck * 0.55).otherwise(duck), 2.0, 20.0)


def voice_duck_ratio(duck: Column) -> Column:
    """The same of the original voices."""
    return clip(duck, 2.0, 20.0)


def rms_weighted(rms: Column, seconds: Column) -> Column:
    """Worth of a line as a reference: loud, and up to 6 s long."""
    return rms * F.least(seconds, F.lit(6.0))
