"""Numbers of cues: budgets, levels, pitch, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BUDGET_CPS, BUDGET_CPS_EN, OK, UNRELIABLE, WEAK


def band(value: Column, weak: float, bad: float, higher_is_better: bool = True) -> Column:
    """Level of a score by two thresholds, both strict."""
    if higher_is_better:
        return F.when(value < bad, UNRELIABLE).when(value < weak, WEAK).otherwise(OK)
    return F.when(value > bad, UNRELIABLE).when(value > weak, WEAK).otherwise(OK)


def budget_chars(seconds: Column, lang: str = "en") -> Column:
    """Characters of a translated line that fit into so many seconds, 12 at least."""
    return F.greatest(F.lit(12), (seconds * F.lit(BUDGET_CPS_EN if lang == "en" else BUDGET_CPS)).cast("int"))


def squeezed(limit: Column, turn: Column) -> Column:
    """The limit asked for in a later round: 3 % less each time."""
    return F.greatest(F.lit(12), (limit * F.pow(F.lit(0.97), turn + 1)).cast("int"))


def plausible_pitch(hz: Column) -> Column:
    return hz.between(80, 360)


def semitones(a: Column, b: Column) -> Column:
    return F.lit(12.0) * F.log2(a / b)


def decibels(x: Column) -> Column:
    return F.lit(20.0) * F.log10(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gain(intensity: Column, most: float = 5.0, scale: float = 0.6) -> Column:
    return clip(intensity * scale, -most, most)


def emotion(intensity: Column, text: Column) -> Column:
    """Engine setting by loudness, a little more for exclamations and questions."""
    mark = F.substring(F.rtrim(text), -1, 1)
    return clip(F.lit(0.72) + intensity * 0.022 + F.when(mark == "!", 0.06).when(mark == "?", 0.02).otherwise(0.0), 0.55, 0.95)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    """Vector of length 1."""
    n = F.sqrt(dot(a, a)) + F.lit(1e-9)
    return F.transform(a, lambda x: x.cast("double") / n)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom)."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = side(0) * side(1)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def duration_text(s: Column) -> Column:
    """Seconds below 90 s, minutes below 90 min, else hours and minutes; halves go to the even number."""
    minutes = F.bround(s / 60).cast("long")
    return F.when(s < 90, F.concat(F.bround(s).cast("long").cast("string"), F.lit("s"))).when(s < 5400, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(
        F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m"))
    )


def probe_windows(start: Column, end: Column) -> Column:
    """Up to three stretches of at most 2 s of a line, without its edges."""
    pad = F.least(F.lit(0.10), (end - start) * 0.15)
    a, b = start + pad, end - pad
    piece = lambda x, y: F.struct(x.alias("from_s"), y.alias("to_s"))
    n = F.least(F.lit(2.0), b - a)
    mid = (a + b) / 2
    return F.when(b - a <= 1.2, F.array(piece(a, b))).otherwise(F.array(piece(a, a + n), piece(mid - n / 2, mid + n / 2), piece(b - n, b)))
