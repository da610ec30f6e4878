"""Tables, constants and fixed value lists of dialogue tracks.

Times are seconds from a track's start. Speech rates differ by use and are kept apart on purpose.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("text", T.StringType())])
CUES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("track_id", "idx")]
    + [T.StructField(n, T.DoubleType()) for n in ("start_s", "end_s")]
    + [T.StructField(n, T.StringType()) for n in ("text", "speaker", "voice", "source_text")]
    + [T.StructField(n, T.DoubleType()) for n in ("rendered_dur", "engine_speed", "stretch", "borrowed", "overrun", "source_speech", "speech_onset", "overlapped", "truncated", "gain_db", "f0_end_slope", "intensity", "emotion")]
    + [T.StructField("merged_from", T.ArrayType(T.LongType()))]
)
CHECKS = T.StructType([T.StructField("track_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("stage", "level", "detail", "remedy")], T.StructField("score", T.DoubleType())])
PROBLEMS = T.StructType([T.StructField("track_id", T.LongType()), T.StructField("idx", T.LongType()), T.StructField("start_s", T.DoubleType()), *[T.StructField(n, T.StringType()) for n in ("kind", "severity")]])

OK, WEAK, UNRELIABLE = "ok", "weak", "unreliable"

# Speech rates, characters a second: spoken length of a text; budgets of a translation; the editing sheet; a track
# with too few measured lines.
SPOKEN_CPS, BUDGET_CPS, BUDGET_CPS_EN, SHEET_CPS, FALLBACK_CPS = 12.6, 14.0, 14.8, 15.0, 15.0


@dataclass(frozen=True)
class Fit:
    """Knobs of fitting rendered lines to their windows."""

    keep_gap: float = 0.12
    max_borrow: float = 1.5
    max_speed: float = 1.25
    least_change: float = 1.01
    cap_with_speed: float = 1.15
    cap_without_speed: float = 1.22
    max_stretch: float = 1.45
    overrun: float = 0.15
    fill_share: float = 0.85
    fill_rate: float = 0.94
    fill_skip: float = 0.985
    fill_least: float = 0.55
    measured: float = 0.3
    overlap_other: float = 0.45
    headroom: float = 0.89
    supports_speed: bool = True


# Expansion of translated text by language, units, rates and startup seconds of the stages of a run.
EXPANSION = {"uk": 1.12, "ru": 1.10, "de": 1.15, "es": 1.20, "fr": 1.18, "pl": 1.10}
STAGES = {
    "separate": ("audio", 0.12, 12.0),
    "diarize": ("cues", 0.55, 8.0),
    "translate_llm": ("cues", 4.0, 20.0),
    "translate_marian": ("cues", 0.30, 10.0),
    "references": ("cues", 0.05, 0.0),
    "prosody": ("cues", 0.02, 0.0),
    "synth_chatterbox": ("speech", 1.20, 20.0),
    "synth_kokoro": ("speech", 0.15, 6.0),
    "synth_piper": ("speech", 0.05, 2.0),
    "convert": ("speech", 2.50, 15.0),
    "mux": ("video", 0.03, 0.0),
}
# Capitalised words that are no terms.
COMMON_WORDS = (
    "The This That There Then They Their These Those What When Where Who Why How And But For You Your It's I'm We're Okay Yeah Yes Oh Hey Well "
    "All Are Can Did Do Does Don't Get Got Have He Her Here Him His If Just Let Like Look Make Me My No Not Now One Our Out Right She So Some Take "
    "Thank Thanks Was We Will With"
).split()
