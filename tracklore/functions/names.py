"""Names, addresses, keys and the short texts of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import rx


def is_url(c: Column) -> Column:
    return c.rlike("(?i)^https?://")


def only_automatic(manual: Column, lang: str) -> Column:
    """Whether no hand-made subtitles of a language are among the codes of a map."""
    return ~F.exists(F.map_keys(manual), lambda code: F.split(code, "-")[0] == lang)


def title_name(c: Column, most: int = 120) -> Column:
    """A title as a file name: without characters that file systems refuse."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|\x00-\x1f]", ""), rx(r"\s+"), " ")), 1, most)


def clip_name(idx: Column) -> Column:
    return F.concat(F.lit("line"), F.lpad(idx.cast("string"), 5, "0"), F.lit(".wav"))


def packed_voice(preset: Column, reference: Column) -> Column:
    """A preset voice and the clip it is turned into, in one name."""
    return F.when(reference.isNull() | (reference == ""), preset).otherwise(F.concat_ws("::", preset, reference))


def unpacked_voice(c: Column) -> Column:
    part = F.split(c, "::", 2)
    return F.struct(part[0].alias("preset"), F.try_element_at(part, F.lit(2)).alias("reference"))


def packed_line(reference: Column, line: Column) -> Column:
    """A reference clip and the line it speaks, in one name."""
    return F.when(line.isNull() | (line == ""), reference).otherwise(F.concat_ws("||", reference, line))


def voice_id(voice: Column, content: Column) -> Column:
    """A voice in the key of a clip: a name as it is, a file by twelve digits of its content's SHA-1."""
    return F.when(content.isNull(), voice).otherwise(F.substring(F.sha1(content), 1, 12))


def voice_gender(name: Column) -> Column:
    """Gender of a preset voice by the second letter of its name; null where it says nothing."""
    letter = F.lower(F.substring(name, 2, 1))
    return F.when(letter == "f", "F").when(letter == "m", "M")


def pitch_gender(f0: Column, split: float = 158.0) -> Column:
    return F.when(f0 >= split, "F").when(f0 < split, "M")


def cues_expected(known: Column, seconds: Column, per_minute: float = 11.0) -> Column:
    """Number of cues of a source: what is known, else by its length."""
    return F.coalesce(F.when(known > 0, known), F.greatest(F.lit(1), (seconds / 60 * per_minute).cast("int")))


def fit_line(total: Column, clean: Column, stretched: Column, overrun: Column) -> Column:
    """A report's line on the fit of a track."""
    pct = F.round(F.try_divide(clean * 100, total), 0).cast("long")
    return F.concat_ws(", ", F.concat(total.cast("string"), F.lit(" lines")), F.concat(F.coalesce(pct, F.lit(0)).cast("string"), F.lit(" % clean")), F.concat(stretched.cast("string"), F.lit(" stretched")), F.concat(overrun.cast("string"), F.lit(" over")))


def brief_prompt(brief: Column) -> Column:
    """A brief as the text that goes before a prompt; parts that are missing are left out."""
    terms = F.array_join(F.transform(F.coalesce(brief["glossary"], F.array().cast("array<struct<term:string,target:string,why:string>>")), lambda g: F.concat(g["term"], F.lit(" = "), g["target"])), "; ")
    return F.concat_ws("\n", F.nullif(brief["summary"], F.lit("")), F.nullif(brief["notes"], F.lit("")), F.when(terms != "", F.concat(F.lit("Terms: "), terms)))
