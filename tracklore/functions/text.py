"""Text of dialogue lines as column expressions. Null gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import rx

# Patterns of the caption formats.
TAGS = r"<[^>]+>"
SOUNDS = r"[\[(][^\])]{0,40}[\])]"
LABEL = r"^\s*[A-Z][A-Z0-9 .'#\-]{1,24}:\s*"
DASH = r"^\s*[-–—]\s*"
MUSIC = r"[♪♫#]"
CREDITS = r"\b(subtitle[sd]?|subs|sync(?:ed|hronized)?|translat(?:ed|ion)|encoded|ripped)\b.{0,40}\b(by|from|team|group)\b"
BRACKETED = r"^\s*[\[(][^\])]*[\])]\s*$"
TERMINAL = r"[.!?…\"'”’)\]]\s*$"
RUSSIAN = r"[ыэъЫЭЪ]|\b(что|это|этот|здесь|сегодня|очень|тебя|меня|вы|его|её|если|когда|где|такой|один|нет|да|только|потому|чтобы)\b"
QUESTION = (
    r"^\s*(who|what|when|where|why|how|which|whose|whom|is|are|was|were|do|does|did|can|could|will|would|should|shall"
    r"|have|has|had|am|may|might|isn't|aren't|don't|didn't|can't|won't)\b"
)
TAG_QUESTION = r",\s*(right|okay|ok|yeah|no|isn't it|aren't you)\s*$"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rx(r"\s+"), " "))


def clean_line(c: Column) -> Column:
    """Without tags, sounds in brackets and a speaker label."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, TAGS, ""), SOUNDS, " "), rx(LABEL), ""))


def is_dropped(c: Column) -> Column:
    """Lines that are no speech: without ASCII letters and digits, music, credits, all in brackets. Null is dropped."""
    return F.coalesce(~c.rlike("[A-Za-z0-9]") | c.rlike(MUSIC) | c.rlike(rx(CREDITS, True)) | c.rlike(rx(BRACKETED)), F.lit(True))


def speaker_parts(lines: Column) -> Column:
    """Parts of an array of lines: one each if two or more and all begin with a dash, else one of all; without dashes."""
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, rx(DASH), "")))
    several = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(rx(DASH)))
    return F.when(several, bare).otherwise(F.array(F.array_join(bare, " ")))


def collapse_marks(c: Column) -> Column:
    """Each run of punctuation as its strongest mark (? ! . ; : ,), runs of three dots and more as an ellipsis."""

    def mark(x: Column) -> Column:
        # equal marks of the middle rank: the first of the run
        middle = F.regexp_extract(x, "[;:]", 0)
        strongest = F.when(F.contains(x, F.lit("?")), "?").when(F.contains(x, F.lit("!")), "!").when(F.contains(x, F.lit(".")), ".").when(middle != "", middle).otherwise(",")
        dots = F.when(F.char_length(x) >= 3, "...").otherwise(".")
        return F.when(F.char_length(x) < 2, x).when(x.rlike(r"^\.+$"), dots).when(x.rlike("^[.,!?;:]"), strongest).otherwise(x)

    # most lines have no two marks in a row and are not taken apart
    whole = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([.,!?;:]+|[^.,!?;:]+)"), F.lit(1)), mark), "")
    return F.when(c.rlike("[.,!?;:]{2}"), whole).otherwise(c)


def speakable(c: Column) -> Column:
    """A line for a speech engine: no quotes and dashes, one mark a run, ended by a mark."""
    t = F.regexp_replace(c, rx(r"^\s*[-–—]+\s*"), "")
    t = F.regexp_replace(F.regexp_replace(t, "[\"“”«»‘’`]", ""), "…", "...")
    t = F.regexp_replace(t, rx(r"\s*(?:--+|[–—]+)\s*"), ", ")
    t = F.regexp_replace(t, rx(r"^\s*:\s*"), "")
    t = collapse_marks(F.regexp_replace(t, rx(r"\s+([,.!?;:])"), "$1"))
    t = F.regexp_replace(F.regexp_replace(t, rx(r"\s+"), " "), r"^[ \-–—:;,]+|[ \-–—:;,]+$", "")
    return F.when((t != "") & ~t.rlike("[.!?]$"), F.concat(t, F.lit("."))).otherwise(t)


def words(c: Column) -> Column:
    """Lower-case words; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), rx(r"\s+")), lambda x: x != "")


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of equal items at the beginnings of two arrays."""
    k = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k), lambda x, y: x == y)
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, k).cast("int")


def shared_tail(a: Column, b: Column, most: int = 12) -> Column:
    """Longest end of a (at most so many items) that b begins with."""
    k = F.least(F.size(a), F.size(b), F.lit(most))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda n: (n <= k) & (F.slice(a, -n, n) == F.slice(b, F.lit(1), n)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def is_terminal(c: Column) -> Column:
    return c.rlike(rx(TERMINAL))


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def clean_reply(c: Column) -> Column:
    """First line of a model's reply without quotes and a short label."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), "^[\"'“”«»]+|[\"'“”«»]+$", ""), r"^[^:\n]{0,24}:\s*(?=\S)", "")
    return F.trim(F.split(t, "\n")[0])


def numbered_replies(c: Column, n: Column) -> Column:
    """Map of number to line of a numbered reply; numbers of 1 to n, the last of equal ones."""
    rows = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\d+[.):]\s*.+$"))
    pairs = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int").alias("k"), F.trim(F.regexp_extract(x, r"^\s*\d+[.):]\s*(.+)$", 1)).alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] >= 1) & (p["k"] <= n))
    keep = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(keep)


def brief_of(c: Column) -> Column:
    """The brief in a model's JSON reply, terms without a target left out; null where there is none."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "summary string, notes string, glossary array<struct<term:string,target:string,why:string>>")
    return F.when(got["summary"].isNotNull() | got["notes"].isNotNull() | got["glossary"].isNotNull(), F.struct(got["summary"].alias("summary"), got["notes"].alias("notes"), F.filter(got["glossary"], lambda g: (F.trim(g["term"]) != "") & (F.trim(g["target"]) != "")).alias("glossary")))


def punctuate(text: Column, slope: Column, intensity: Column, use_pitch: bool = True, classes: Callable[..., str] = rx) -> Column:
    """The line with the mark that its delivery asks for: a question mark for questions that rise or have no mark, an
    exclamation mark for short loud lines. classes: what letters and white space are (rx or re2)."""
    t = F.regexp_replace(text, classes(r"\s+$"), "")
    asks = t.rlike(classes(QUESTION, True)) | t.rlike(classes(TAG_QUESTION, True))
    rising = (slope >= 2.0) if use_pitch else F.lit(False)
    bare = F.regexp_replace(t, classes("[.,]+$"), "")
    return (
        F.when((t == "") | t.rlike(classes("[?!]$")), text)
        .when(asks & (rising | ~t.rlike(classes("(?:[.,]|…)$"))), F.concat(bare, F.lit("?")))
        .when((intensity >= 5.0) & (F.char_length(t) < 60), F.concat(bare, F.lit("!")))
        .otherwise(text)
    )


def slug(c: Column, most: int = 40) -> Column:
    """A short file name: letters and digits joined by hyphens, and eight digits of the text's SHA-1."""
    return F.concat(F.substring(F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), 1, most), F.lit("-"), F.substring(F.sha1(c.cast("binary")), 1, 8))
