"""The named queries, each with the SQL that DuckDB runs on the same tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure as M
from ..functions import text as X
from ..functions.rx import re2
from ..operators import audio, captions, casting, cues, edits, intervals, planning, rules, speakers, timing
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: _r(n, digits) for n in names})


# Cues and timing


@query(f"WITH {B.CUE} SELECT track_id, idx, start_ms, round(gap_s, 4) AS gap_s, round(window_s, 4) AS window_s FROM cue")
def cue_gaps(spark, d):
    return _rounded(cues.windowed(B.cue_track(spark, d)), "gap_s", "window_s").select("track_id", "idx", "start_ms", "gap_s", "window_s")


@query(f"WITH {B.FIT} SELECT track_id, idx, outcome, round(stretch, 4) AS stretch, round(engine_speed, 4) AS engine_speed, round(borrowed, 4) AS borrowed, round(overrun, 4) AS overrun FROM fitted")
def fit_outcomes(spark, d):
    return _rounded(timing.fit(B.cue_track(spark, d)), "stretch", "engine_speed", "borrowed", "overrun").select("track_id", "idx", "outcome", "stretch", "engine_speed", "borrowed", "overrun")


_COUNTS = """count(*) AS total, count(*) FILTER (rendered_dur <= window_s) AS clean, count(*) FILTER (borrowed > 0) AS borrowed, count(*) FILTER (engine_speed > 1) AS resynth,
  count(*) FILTER (stretch > 1) AS stretched, count(*) FILTER (stretch < 1) AS filled, count(*) FILTER (overrun > 0) AS overrun"""


@query(f"WITH {B.FIT} SELECT track_id, {_COUNTS} FROM fitted GROUP BY track_id")
def fit_report(spark, d):
    return timing.report(timing.fit(B.cue_track(spark, d)), "track_id")


@query(f"WITH {B.FIT} SELECT speaker, outcome, count(*) AS lines, round(avg(stretch), 4) AS mean_stretch FROM fitted GROUP BY ALL")
def outcome_mix_by_speaker(spark, d):
    return timing.fit(B.cue_track(spark, d)).groupBy("speaker", "outcome").agg(F.count("*").alias("lines"), _r(F.avg("stretch")).alias("mean_stretch"))


@query(f"WITH {B.LAID} SELECT track_id, idx, round(truncated, 4) AS truncated, round(overlapped, 4) AS overlapped FROM laid WHERE truncated > 0 OR overlapped > 0")
def layout_overlaps(spark, d):
    return _rounded(timing.layout(timing.fit(B.cue_track(spark, d))).where("truncated > 0 or overlapped > 0"), "truncated", "overlapped").select("track_id", "idx", "truncated", "overlapped")


@query(
    f"""WITH {B.CUE}, near AS (SELECT * FROM cue WHERE end_s > 5 AND start_s < 35),
kept AS (SELECT * FROM near WHERE (start_s >= 5 AND end_s <= 35) OR least(end_s, 35::DOUBLE) - greatest(start_s, 5::DOUBLE) >= (end_s - start_s) * 0.8::DOUBLE)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_s, idx) - 1 AS new_idx, idx, round(greatest(0::DOUBLE, start_s - 5), 4) AS start_s, round(least(30::DOUBLE, end_s - 5), 4) AS end_s, speaker, text FROM kept"""
)
def slice_cues(spark, d):
    return _rounded(cues.slice_cues(B.cue_track(spark, d), 5.0, 30.0), "start_s", "end_s")


@query(
    f"""WITH {B.CUE} SELECT track_id, idx,
  coalesce(string_agg(text, ' | ' ORDER BY idx) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS prev,
  coalesce(string_agg(text, ' | ') OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS next, trunc(window_s * 15::DOUBLE)::BIGINT AS max_chars FROM cue""".replace("string_agg(text, ' | ' ORDER BY idx)", "string_agg(text, ' | ')")
)
def context_windows(spark, d):
    return cues.context(B.cue_track(spark, d)).select("track_id", "idx", "prev", "next", "max_chars")


# Rules and the ledger

_CLIPS = B.LAID + """,
clips AS (SELECT track_id, idx, start_s, speaker, text, final_dur * (CASE WHEN idx % 9 = 0 THEN 0.3::DOUBLE WHEN idx % 11 = 0 THEN 3::DOUBLE ELSE 1::DOUBLE END) AS dur_s, CASE WHEN idx % 13 = 0 THEN 0.001::DOUBLE WHEN idx % 7 = 0 THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS peak,
  (idx % 5) / 50::DOUBLE AS tail, (idx % 4) * 0.4::DOUBLE AS dead_s, truncated, stretch, overlapped FROM laid)"""


def _clips(spark, d):
    rows = timing.layout(timing.fit(B.cue_track(spark, d)))
    return rows.selectExpr(
        "track_id", "idx", "start_s", "speaker", "text", "final_dur * (case when idx % 9 = 0 then 0.3D when idx % 11 = 0 then 3D else 1D end) as dur_s", "case when idx % 13 = 0 then 0.001D when idx % 7 = 0 then 1D else 0.5D end as peak",
        "(idx % 5) / 50D as tail", "(idx % 4) * 0.4D as dead_s", "truncated", "stretch", "overlapped",
    )


_CLIP_RULES = _CLIPS + """,
judged AS (SELECT *, length(text) / 12.6::DOUBLE AS expected FROM clips),
found AS (SELECT track_id, idx, start_s, unnest(CASE WHEN dur_s <= 0 OR peak < 0.005::DOUBLE THEN [{'kind': 'silent', 'severity': 'bad'}] ELSE list_filter([
  CASE WHEN truncated > 0.15::DOUBLE THEN {'kind': 'cut off', 'severity': CASE WHEN tail > 0.05::DOUBLE THEN 'bad' ELSE 'warn' END} END,
  CASE WHEN stretch > 1.30::DOUBLE THEN {'kind': 'over-stretched', 'severity': 'warn'} END,
  CASE WHEN expected > 0.4::DOUBLE AND dur_s < expected * 0.45::DOUBLE THEN {'kind': 'too short', 'severity': 'bad'} END,
  CASE WHEN expected > 0.4::DOUBLE AND dur_s > expected * 2.5::DOUBLE THEN {'kind': 'runaway', 'severity': 'bad'} END,
  CASE WHEN peak > 0.999::DOUBLE THEN {'kind': 'clipped', 'severity': 'warn'} END,
  CASE WHEN dead_s > 0.35::DOUBLE AND dead_s > dur_s * 0.25::DOUBLE THEN {'kind': 'dead air', 'severity': 'bad'} END], lambda x: x IS NOT NULL) END) AS p FROM judged),
problems AS (SELECT track_id, idx, round(start_s, 3) AS start_s, p.kind AS kind, p.severity AS severity FROM found)"""


@query(f"WITH {_CLIP_RULES} SELECT * FROM problems")
def clip_rules(spark, d):
    return _rounded(rules.clip_problems(_clips(spark, d)), "start_s", digits=3)


@query(f"WITH {_CLIP_RULES} SELECT kind, count(*) FILTER (severity = 'bad') AS bad, count(*) FILTER (severity = 'warn') AS warn, count(*) AS n FROM problems GROUP BY kind")
def problem_summary(spark, d):
    return rules.problem_summary(rules.clip_problems(_clips(spark, d)))


@query(f"WITH {_CLIP_RULES} SELECT * FROM problems WHERE severity = 'bad' ORDER BY start_s, track_id, idx LIMIT 8")
def serious_problems(spark, d):
    return rules.serious(_rounded(rules.clip_problems(_clips(spark, d)), "start_s", digits=3))


_TRACK_RULES = B.LAID + """,
over AS (SELECT track_id, idx, start_s, speaker, after, next_idx, (idx % 5) * 0.2::DOUBLE AS overlapped FROM laid),
track_found AS (SELECT track_id, idx, round(start_s, 3) AS start_s, CASE WHEN after = speaker AND speaker <> '' THEN 'self-overlap' WHEN overlapped > 0.6::DOUBLE THEN 'long overlap' END AS kind,
  CASE WHEN after = speaker AND speaker <> '' THEN 'bad' WHEN overlapped > 0.6::DOUBLE THEN 'warn' END AS severity FROM over WHERE overlapped > 0.02::DOUBLE AND next_idx IS NOT NULL)"""


@query(f"WITH {_TRACK_RULES} SELECT * FROM track_found WHERE kind IS NOT NULL")
def track_rules(spark, d):
    rows = timing.layout(timing.fit(B.cue_track(spark, d))).withColumn("overlapped", F.expr("(idx % 5) * 0.2D"))
    return _rounded(rules.track_problems(rows), "start_s", digits=3)


_INFO = B.LINES + """,
lw AS (SELECT *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM lines),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY track_id ORDER BY seq) AS prev FROM lw),
flags AS (SELECT *, coalesce(len(prev) > 0 AND len(w) > 0, false) AS usable,
  coalesce(list_max(list_filter(range(1, least(len(prev), len(w), 12) + 1), lambda n: prev[len(prev) - n + 1:] = w[1:n])), 0) AS tail,
  coalesce(list_position(list_transform(range(1, least(len(prev), len(w)) + 1), lambda i: prev[i] = w[i]), false) - 1, least(len(prev), len(w))) AS head FROM pairs),
info0 AS (SELECT track_id, count(*) AS events, count(*) FILTER (regexp_matches(rtrim(text), '[.!?]$')) AS ended, count(*) FILTER (usable AND prev = w) AS duplicated,
  count(*) FILTER (usable AND (tail > 0 OR head >= least(3, len(prev)))) AS shared_edges, sum(len(w))::BIGINT AS words FROM flags GROUP BY track_id),
info1 AS (SELECT *, ended > greatest(2::DOUBLE, events * 0.15::DOUBLE) AS punctuated, events >= 4 AND shared_edges > events * 0.3::DOUBLE AS rolling FROM info0),
info AS (SELECT *, CASE WHEN rolling THEN 'automatic captions (rolling)' WHEN duplicated > events * 0.2::DOUBLE OR NOT punctuated THEN 'automatic captions' ELSE 'subtitles' END AS kind FROM info1)"""


@query(f"WITH {_INFO} SELECT * FROM info")
def caption_inspect(spark, d):
    return captions.inspect(B.caption_lines(spark, d)).drop("notes")


_CHECKED = _INFO + """,
checked AS (SELECT track_id, 'subtitles' AS stage, CASE WHEN events = 0 OR (rolling AND duplicated * 4 > words) THEN 'unreliable' WHEN NOT punctuated OR rolling OR duplicated > events * 0.2::DOUBLE THEN 'weak' ELSE 'ok' END AS level, kind FROM info)"""


@query(f"WITH {_CHECKED} SELECT * FROM checked")
def caption_confidence(spark, d):
    info = captions.inspect(B.caption_lines(spark, d)).withColumn("removed_words", F.col("duplicated") * 4)
    return captions.confidence(info).select("track_id", "stage", "level", "kind")


@query(
    f"""WITH {_CHECKED}, tr AS (SELECT doc_id AS track_id, 'translation' AS stage, CASE WHEN (doc_id % 10) / 20::DOUBLE > 0.25::DOUBLE THEN 'unreliable' WHEN (doc_id % 10) / 20::DOUBLE > 0.10::DOUBLE THEN 'weak' ELSE 'ok' END AS level FROM documents),
sp AS (SELECT doc_id AS track_id, 'speakers' AS stage, CASE WHEN (doc_id % 7) / 10::DOUBLE < 0.2::DOUBLE THEN 'unreliable' WHEN (doc_id % 7) / 10::DOUBLE < 0.4::DOUBLE THEN 'weak' ELSE 'ok' END AS level FROM documents),
every_check AS (SELECT track_id, stage, level FROM checked UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM sp)
SELECT track_id, count(*) FILTER (level = 'ok') AS n_ok, count(*) FILTER (level = 'weak') AS n_weak, count(*) FILTER (level = 'unreliable') AS n_unreliable,
  coalesce(string_agg(DISTINCT stage || ': ' || level, ', ' ORDER BY stage || ': ' || level) FILTER (level <> 'ok'), '') AS flagged FROM every_check GROUP BY track_id"""
)
def confidence_ledger(spark, d):
    first = caption_confidence(spark, d).select("track_id", "stage", "level")
    docs = B.read(spark, d, "documents").select(F.col("doc_id").alias("track_id"))
    tr = docs.select("track_id", F.lit("translation").alias("stage"), rules.translation_check(F.expr("(track_id % 10) / 20D")).alias("level"))
    sp = docs.select("track_id", F.lit("speakers").alias("stage"), rules.speaker_check(F.expr("(track_id % 7) / 10D"), F.lit(0.5), F.lit(2)).alias("level"))
    return rules.ledger(first.unionByName(tr).unionByName(sp))


# Text


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '[\[(][^\])]{{0,40}}[\])]', ' ', 'g'), '^\s*[A-Z][A-Z0-9 .''#\-]{{1,24}}:\s*', ''), '\s+', ' ', 'g'))"


_DROPPED = (
    r"(NOT regexp_matches(text, '[A-Za-z0-9]') OR regexp_matches(text, '[♪♫#]') OR regexp_matches(text, '(?i)\b(subtitle[sd]?|subs|sync(?:ed|hronized)?|translat(?:ed|ion)|encoded|ripped)\b.{0,40}\b(by|from|team|group)\b')"
    r" OR regexp_matches(text, '^\s*[\[(][^\])]*[\])]\s*$'))"
)


@query(f"WITH {B.LINES} SELECT track_id, seq, {_clean('text')} AS clean FROM lines")
def clean_lines(spark, d):
    return B.caption_lines(spark, d).select("track_id", "seq", X.clean_line(F.col("text")).alias("clean"))


@query(f"WITH {B.LINES} SELECT track_id, seq, text FROM lines WHERE {_DROPPED}")
def dropped_lines(spark, d):
    return B.caption_lines(spark, d).where(X.is_dropped(F.col("text"))).select("track_id", "seq", "text")


_SPEAKABLE = f"WITH {B.LINES},\n{B.said('lines')}\nSELECT track_id, seq, said FROM said"


@query(_SPEAKABLE)
def speakable_lines(spark, d):
    return B.caption_lines(spark, d).select("track_id", "seq", X.speakable(F.col("text")).alias("said"))


@query(
    rf"""WITH {B.LINES}, ev AS (SELECT track_id, seq // 2 AS seq, min(start_s) AS start_s, max(end_s) AS end_s, list(CASE WHEN track_id % 3 = 0 OR seq % 2 = 0 THEN '- ' || trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END ORDER BY seq) AS l FROM lines GROUP BY track_id, seq // 2),
ev2 AS (SELECT track_id, seq, start_s, end_s, list_filter(l, lambda x: x <> '') AS l FROM ev),
ev3 AS (SELECT *, list_transform(l, lambda x: trim(regexp_replace(x, '^\s*[-–—]\s*', ''))) AS bare, len(l) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-–—]\s*'))) = len(l) AS several FROM ev2),
parts AS (SELECT track_id, seq, start_s, end_s, unnest(CASE WHEN several THEN bare ELSE [array_to_string(bare, ' ')] END) AS raw, unnest(CASE WHEN several THEN range(0, len(bare)) ELSE [0] END) AS part FROM ev3),
said AS (SELECT track_id, seq, start_s, end_s, part, {_clean('raw')} AS text FROM parts),
kept AS (SELECT *, end_s - start_s AS span, length(text) AS n FROM said WHERE NOT {_DROPPED} AND text <> ''),
run AS (SELECT *, sum(n) OVER (PARTITION BY track_id, seq ORDER BY part)::BIGINT AS upto, sum(n) OVER (PARTITION BY track_id, seq)::BIGINT AS total FROM kept)
SELECT track_id, seq::BIGINT AS seq, part::BIGINT AS part, text, round(start_s + span * (upto - n) / total, 4) AS start_s, round(start_s + span * upto / total, 4) AS end_s FROM run"""
)
def split_speakers(spark, d):
    rows = B.caption_lines(spark, d).withColumn("text", X.squeeze(F.col("text")))
    dashed = F.when(F.expr("track_id % 3 = 0 or seq % 2 = 0"), F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    ev = rows.groupBy("track_id", F.expr("seq div 2").alias("pair")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", dashed.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return _rounded(cues.split_events(ev.withColumnRenamed("pair", "seq")), "start_s", "end_s").withColumn("part", F.col("part").cast("long"))


_PLANTED = ["Де це є?", "что это", "Сьогодні гарний день.", "Объект", "нет!", "дактиль", "Вы где", "це не етот", "ДА.", "тільки так"]


@query(
    f"""WITH {B.LINES}, both_lines AS (SELECT track_id, seq, text FROM lines UNION ALL SELECT -1, i, t FROM (SELECT unnest(range(0, {len(_PLANTED)})) AS i, unnest({_PLANTED!r}) AS t))
SELECT track_id, seq FROM both_lines WHERE regexp_matches(text, '[ыэъЫЭЪ]') OR regexp_matches(text, '(?i)(^|[^\\p{{L}}])(что|это|этот|здесь|сегодня|очень|тебя|меня|вы|его|её|если|когда|где|такой|один|нет|да|только|потому|чтобы)([^\\p{{L}}]|$)')"""
)
def rx_language_filter(spark, d):
    rows = [F.struct(F.lit(-1).cast("long").alias("track_id"), F.lit(i).cast("long").alias("seq"), F.lit(t).alias("text")) for i, t in enumerate(_PLANTED)]
    planted = spark.range(1).select(F.inline(F.array(*rows)))
    return planning.wrong_language(B.caption_lines(spark, d).select("track_id", "seq", "text").unionByName(planted)).select("track_id", "seq")


@query(
    rf"""WITH {B.CUE}, t AS (SELECT track_id, idx, text, regexp_replace(text, '\s+$', '') AS s, (idx % 5)::DOUBLE AS slope, (idx % 7)::DOUBLE AS loud FROM cue),
q AS (SELECT *, regexp_matches(s, '(?i)^\s*(who|what|when|where|why|how|which|whose|whom|is|are|was|were|do|does|did|can|could|will|would|should|shall|have|has|had|am|may|might|isn''t|aren''t|don''t|didn''t|can''t|won''t)\b')
  OR regexp_matches(s, '(?i),\s*(right|okay|ok|yeah|no|isn''t it|aren''t you)\s*$') AS asks, regexp_replace(s, '[.,]+$', '') AS bare FROM t)
SELECT track_id, idx, CASE WHEN s = '' OR regexp_matches(s, '[?!]$') THEN text WHEN asks AND (slope >= 2 OR NOT regexp_matches(s, '([.,]|…)$')) THEN bare || '?' WHEN loud >= 5 AND length(s) < 60 THEN bare || '!' ELSE text END AS marked FROM q"""
)
def punctuated_cues(spark, d):
    # words end as in the SQL, by ASCII letters ("doó" begins with "do"); the operator's own default is Unicode
    return B.cue_track(spark, d).select("track_id", "idx", X.punctuate(F.col("text"), F.expr("cast(idx % 5 as double)"), F.expr("cast(idx % 7 as double)"), classes=re2).alias("marked"))


# Repair of captions


@query(
    f"""WITH {_INFO}, new_run AS (SELECT *, CASE WHEN prev IS NOT NULL AND prev = w THEN 0 ELSE 1 END AS new FROM pairs),
runs AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM new_run)
SELECT track_id, min(seq) AS seq, arg_min(start_s, seq) AS start_s, max(end_s) AS end_s, arg_min(text, seq) AS text FROM runs GROUP BY track_id, run"""
)
def drop_repeats(spark, d):
    return captions.drop_repeats(B.caption_lines(spark, d))


@query(f"WITH {B.LINES}, l AS (SELECT *, lead(start_s) OVER (PARTITION BY track_id ORDER BY seq) AS after FROM lines) SELECT track_id, seq, start_s, CASE WHEN after < end_s THEN greatest(start_s + 0.05::DOUBLE, after) ELSE end_s END AS end_s FROM l")
def untangle(spark, d):
    return captions.untangle(B.caption_lines(spark, d)).drop("text")


_ROLLED = f"""WITH RECURSIVE {B.ROLLING},
ev AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS plain, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS cur FROM rolling),
rec(track_id, seq, seen, last_end, text, start_s, end_s) AS (
  SELECT DISTINCT track_id, -1::BIGINT, []::VARCHAR[], NULL::DOUBLE, ''::VARCHAR, 0::DOUBLE, 0::DOUBLE FROM ev
  UNION ALL
  SELECT track_id, seq, list_concat(seen, cur[ov + 1:])[-40:], CASE WHEN len(cur) > ov THEN end_s ELSE last_end END, array_to_string(plain[ov + 1:], ' '),
    least(CASE WHEN last_end IS NULL THEN start_s ELSE greatest(start_s, last_end) END, end_s - 0.05::DOUBLE), end_s
  FROM (SELECT e.track_id, e.seq, e.start_s, e.end_s, e.plain, e.cur, r.seen, r.last_end,
      coalesce(list_max(list_filter(range(1, least(len(r.seen), len(e.cur), 12) + 1), lambda n: r.seen[len(r.seen) - n + 1:] = e.cur[1:n])),
        coalesce(list_position(list_transform(range(1, least(len(r.seen), len(e.cur)) + 1), lambda i: r.seen[greatest(len(r.seen) - len(e.cur), 0) + i] = e.cur[i]), false) - 1, least(len(r.seen), len(e.cur)))) AS ov
    FROM rec r JOIN ev e ON e.track_id = r.track_id AND e.seq = r.seq + 1) x)
SELECT track_id, seq, round(start_s, 4) AS start_s, end_s, text FROM rec WHERE seq >= 0 AND text <> ''"""


@query(_ROLLED)
def dedupe_rolling(spark, d):
    return _rounded(captions.dedupe_rolling(B.rolling_captions(spark, d)), "start_s")


@query(
    rf"""WITH RECURSIVE {B.CUE}, j AS (SELECT track_id, idx, start_s, end_s, text, coalesce(start_s - lag(end_s) OVER w <= 0.9::DOUBLE AND (NOT regexp_matches(lag(text) OVER w, '[.!?…"''”’)\]]\s*$') OR regexp_matches(text, '^\p{{Ll}}')), false) AS joins FROM cue WINDOW w AS (PARTITION BY track_id ORDER BY idx)),
rec(track_id, idx, first, first_start) AS (
  SELECT track_id, idx, idx, start_s FROM j WHERE idx = 0
  UNION ALL
  SELECT j.track_id, j.idx, CASE WHEN j.joins AND j.end_s - r.first_start <= 12 THEN r.first ELSE j.idx END, CASE WHEN j.joins AND j.end_s - r.first_start <= 12 THEN r.first_start ELSE j.start_s END FROM rec r JOIN j ON j.track_id = r.track_id AND j.idx = r.idx + 1),
g AS (SELECT r.track_id, r.first, min(j.start_s) AS start_s, arg_max(j.end_s, j.idx) AS end_s, string_agg(j.text, ' ' ORDER BY j.idx) AS text, count(*) AS members FROM rec r JOIN j USING (track_id, idx) GROUP BY r.track_id, r.first)
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY first) - 1 AS idx, first, start_s, end_s, text, members FROM g"""
)
def merge_fragments(spark, d):
    return cues.merge_fragments(B.cue_track(spark, d), 0.9, 12.0).withColumn("members", F.size("members").cast("long"))


# Edited tables

_TRANSLATIONS = B.CUE + ", edits AS (SELECT track_id, start_ms, 'T ' || text AS new_text FROM cue WHERE idx % 3 = 0 UNION ALL SELECT 0, 999999999, 'X')"


@query(f"WITH {_TRANSLATIONS} SELECT c.track_id, idx, coalesce(e.new_text, c.text) AS text, e.new_text IS NOT NULL AS matched, coalesce(e.new_text <> c.text, false) AS changed FROM cue c LEFT JOIN (SELECT * FROM edits WHERE trim(new_text) <> '') e USING (track_id, start_ms)")
def apply_translations(spark, d):
    rows = B.cue_track(spark, d)
    table = rows.where("idx % 3 = 0").selectExpr("track_id", "start_ms", "'T ' || text as new_text").unionByName(spark.sql("select 0L as track_id, 999999999L as start_ms, 'X' as new_text"))
    return edits.apply_texts(rows, table, "track_id").select("track_id", "idx", "text", "matched", "changed")


@query(f"WITH {B.FIT}, edits AS (SELECT track_id, start_ms, left(text, 15) AS new_text FROM fitted WHERE overrun > 0) SELECT f.track_id, idx, coalesce(e.new_text, f.text) AS text, e.new_text IS NOT NULL AS matched, coalesce(e.new_text <> f.text, false) AS changed FROM fitted f LEFT JOIN edits e USING (track_id, start_ms)")
def apply_rewrites(spark, d):
    rows = timing.fit(B.cue_track(spark, d))
    table = rows.where("overrun > 0").selectExpr("track_id", "start_ms", "left(text, 15) as new_text")
    return edits.apply_texts(rows, table, "track_id").select("track_id", "idx", "text", "matched", "changed")


@query(
    f"""WITH {B.CUE}, sheet AS (SELECT track_id, start_ms, 'X' || speaker AS new_speaker, CASE WHEN idx % 8 = 0 THEN '' ELSE 'af_heart' END AS new_voice, idx AS row FROM cue WHERE idx % 4 = 0 UNION ALL SELECT track_id, start_ms, 'LATE', '', 1000000 FROM cue WHERE idx = 0 AND track_id % 2 = 0),
one AS (SELECT track_id, start_ms, arg_max(new_speaker, row) AS new_speaker, arg_max(new_voice, row) AS new_voice FROM sheet GROUP BY ALL)
SELECT c.track_id, idx, coalesce(nullif(new_speaker, ''), speaker) AS speaker, coalesce(nullif(new_voice, ''), 'none') AS voice, o.start_ms IS NOT NULL AS matched FROM cue c LEFT JOIN one o ON o.track_id = c.track_id AND o.start_ms = c.start_ms"""
)
def apply_cast(spark, d):
    rows = B.cue_track(spark, d).withColumn("voice", F.lit("none"))
    sheet = rows.where("idx % 4 = 0").selectExpr("track_id", "start_ms", "'X' || speaker as new_speaker", "if(idx % 8 = 0, '', 'af_heart') as new_voice", "idx as row")
    late = rows.where("idx = 0 and track_id % 2 = 0").selectExpr("track_id", "start_ms", "'LATE' as new_speaker", "'' as new_voice", "1000000L as row")
    from pyspark.sql import Window

    w = Window.partitionBy("track_id", "start_ms").orderBy(F.desc("row"))
    one = sheet.unionByName(late).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "row")
    return edits.apply_cast(rows, one, "track_id").select("track_id", "idx", "speaker", "voice", "matched")


@query(f"WITH {B.CUE} SELECT DISTINCT 'v' || (idx % 7) AS voice FROM cue WHERE 'v' || (idx % 7) NOT IN ('v0', 'v2', 'v4')")
def unknown_voices(spark, d):
    voices = spark.sql("select explode(array('v0', 'v2', 'v4')) as name")
    return edits.unknown_voices(B.cue_track(spark, d).withColumn("voice", F.expr("'v' || cast(idx % 7 as string)")), voices)


@query(f"WITH {B.CUE} SELECT track_id, idx, greatest(12, trunc(window_s * 14::DOUBLE)::BIGINT) AS budget, length(text) > greatest(12, trunc(window_s * 14::DOUBLE)::BIGINT) AS over FROM cue")
def translation_budget(spark, d):
    return edits.translation_budget(B.cue_track(spark, d), "uk").select("track_id", "idx", "budget", "over")


@query(
    f"""WITH {B.CUE}, b AS (SELECT track_id, length(text) AS n, greatest(12, trunc(window_s * 14::DOUBLE)::BIGINT) AS budget FROM cue), s AS (SELECT track_id, avg((n > budget)::INT) AS share, max(n - budget) AS worst FROM b GROUP BY track_id)
SELECT track_id, round(share, 4) AS share_over, worst::BIGINT AS worst_over, CASE WHEN share > 0.25::DOUBLE THEN 'unreliable' WHEN share > 0.10::DOUBLE THEN 'weak' ELSE 'ok' END AS level FROM s"""
)
def translation_check(spark, d):
    rows = edits.translation_budget(B.cue_track(spark, d), "uk").groupBy("track_id").agg(F.avg(F.col("over").cast("int")).alias("share"), F.max(F.char_length("text") - F.col("budget")).cast("long").alias("worst_over"))
    return rows.select("track_id", _r("share").alias("share_over"), "worst_over", rules.translation_check(F.col("share")).alias("level"))


@query(f"WITH {B.CUE} SELECT track_id, idx FROM cue WHERE length(text) * 1.12::DOUBLE > window_s * 15::DOUBLE")
def expansion_tight(spark, d):
    return edits.expansion_tight(B.cue_track(spark, d), "uk").select("track_id", "idx")


@query(f"WITH {B.FIT} SELECT track_id, idx, round(window_s + borrowed, 4) AS budget_s, round(overrun, 4) AS over_s, trunc((window_s + borrowed) * 15::DOUBLE)::BIGINT AS max_chars, length(text) AS cur_chars FROM fitted WHERE overrun > 0")
def overruns_ranked(spark, d):
    return _rounded(edits.overruns(timing.fit(B.cue_track(spark, d))), "budget_s", "over_s").select("track_id", "idx", "budget_s", "over_s", "max_chars", "cur_chars")


@query(
    f"""WITH {B.FIT}, r AS (SELECT speaker, list(length(text) / rendered_dur ORDER BY length(text) / rendered_dur) FILTER (rendered_dur > 0.5::DOUBLE AND engine_speed = 1) AS rs FROM fitted GROUP BY speaker)
SELECT speaker, round(CASE WHEN len(rs) < 20 THEN 15::DOUBLE ELSE rs[len(rs) // 2 + 1] END, 4) AS cps FROM r"""
)
def chars_per_sec(spark, d):
    return _rounded(edits.chars_per_second(timing.fit(B.cue_track(spark, d)), "speaker"), "cps")


# Speakers and voices

_SPOKEN = B.CUE + """,
by_speaker AS (SELECT track_id, speaker, count(*) AS lines, min(idx) AS first_idx FROM cue WHERE speaker <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY lines DESC, first_idx) AS rank FROM by_speaker)"""


@query(f"WITH {_SPOKEN} SELECT * FROM ranked")
def speaker_lines(spark, d):
    return casting.speaker_lines(B.cue_track(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SPOKEN} SELECT track_id, speaker AS lead, lines FROM ranked WHERE rank = 1")
def lead_voice(spark, d):
    return casting.lead_voice(B.cue_track(spark, d))


@query(
    f"""WITH {B.PITCHES}, many AS (SELECT track_id, idx, 'S0' || (idx % 6) AS speaker FROM pitch),
by_speaker AS (SELECT track_id, speaker, count(*) AS lines, min(idx) AS first_idx FROM many GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY lines DESC, first_idx) AS rank FROM by_speaker),
f AS (SELECT *, CASE speaker WHEN 'S00' THEN 120 WHEN 'S01' THEN 210 WHEN 'S02' THEN 158 END AS f0 FROM ranked),
g AS (SELECT *, CASE WHEN f0 >= 158 THEN 'F' WHEN f0 < 158 THEN 'M' WHEN (sum((f0 IS NULL)::INT) OVER (PARTITION BY track_id ORDER BY rank) - 1) % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, gender ORDER BY rank) AS k FROM g)
SELECT track_id, speaker, gender, CASE WHEN gender = 'F' THEN ['af_a', 'af_b'][CASE WHEN k <= 2 THEN k ELSE 1 END] ELSE ['am_a', 'am_b', 'am_c'][CASE WHEN k <= 3 THEN k ELSE 1 END] END AS voice FROM n"""
)
def voice_assignment(spark, d):
    rows = B.pitches(spark, d).withColumn("speaker", F.expr("'S0' || cast(idx % 6 as string)"))
    known = casting.speaker_lines(rows).withColumn("speaker_f0", F.expr("case speaker when 'S00' then 120D when 'S01' then 210D when 'S02' then 158D end"))
    voices = spark.sql("select inline(array(named_struct('gender', 'F', 'name', 'af_a', 'ord', 1), named_struct('gender', 'F', 'name', 'af_b', 'ord', 2), named_struct('gender', 'M', 'name', 'am_a', 'ord', 1), named_struct('gender', 'M', 'name', 'am_b', 'ord', 2), named_struct('gender', 'M', 'name', 'am_c', 'ord', 3)))")
    return casting.assign_voices(known, voices, "af_heart").select("track_id", "speaker", "gender", "voice")


_REFERENCES = B.CUE + """,
s AS (SELECT *, CASE WHEN idx % 17 = 0 THEN 0.00005::DOUBLE ELSE (100 + (track_id * 13 + idx * 7) % 50) / 1000::DOUBLE END AS rms, end_ms - start_ms AS dur_ms FROM cue),
r AS (SELECT *, rms * least(dur_ms / 1000::DOUBLE, 6::DOUBLE) AS score FROM s WHERE speaker <> '' AND dur_ms >= 1000 AND rms >= 0.0001::DOUBLE),
k AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(dur_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WINDOW w AS (PARTITION BY track_id, speaker ORDER BY score DESC, idx)),
picked AS (SELECT * FROM (SELECT *, sum(dur_ms) OVER (PARTITION BY track_id, speaker) AS total FROM k WHERE before < 12000) WHERE total >= 4000)"""


def _references(spark, d):
    rows = B.cue_track(spark, d).selectExpr("*", "if(idx % 17 = 0, 0.00005D, (100 + (track_id * 13 + idx * 7) % 50) / 1000D) as rms", "end_ms - start_ms as dur_ms", "(end_ms - start_ms) / 1000D as dur_s")
    return casting.pick_references(rows)


@query(f"WITH {_REFERENCES} SELECT track_id, speaker, idx, rank, round(score, 6) AS score FROM picked")
def reference_pick(spark, d):
    return _rounded(_references(spark, d), "score", digits=6).selectExpr("track_id", "speaker", "idx", "cast(rank as bigint) as rank", "score")


@query(f"WITH {_REFERENCES} SELECT track_id, speaker, trim(string_agg(text, ' ' ORDER BY rank) FILTER (text <> '')) AS transcript FROM picked GROUP BY ALL")
def reference_transcripts(spark, d):
    return casting.transcripts(_references(spark, d))


@query(
    f"""WITH {_REFERENCES}, refs AS (SELECT DISTINCT track_id, speaker, speaker || '.wav' AS reference FROM picked WHERE (track_id + length(speaker)) % 2 = 0),
n AS (SELECT c.track_id, c.speaker, count(*) AS lines, min(idx) AS first_idx FROM cue c JOIN refs USING (track_id, speaker) GROUP BY ALL),
lead AS (SELECT track_id, arg_min(speaker, (-lines, first_idx)) AS speaker FROM n GROUP BY track_id)
SELECT c.track_id, c.idx, coalesce(r.reference, l.reference) AS reference FROM cue c LEFT JOIN refs r USING (track_id, speaker) LEFT JOIN (SELECT lead.track_id, reference FROM lead JOIN refs USING (track_id, speaker)) l ON l.track_id = c.track_id"""
)
def reference_for_cues(spark, d):
    refs = _references(spark, d).where("(track_id + char_length(speaker)) % 2 = 0").select("track_id", "speaker", F.concat("speaker", F.lit(".wav")).alias("reference")).distinct()
    return casting.reference_for(B.cue_track(spark, d), refs).select("track_id", "idx", "reference")


@query(
    f"""WITH {B.PITCHES}, ok AS (SELECT *, row_number() OVER (PARTITION BY track_id, speaker ORDER BY idx) AS n FROM pitch WHERE f0 BETWEEN 75 AND 400)
SELECT track_id, speaker, round(quantile_cont(f0, 0.5), 4) AS speaker_f0, count(*) AS n FROM ok WHERE n <= 15 GROUP BY ALL"""
)
def speaker_median_f0(spark, d):
    return _rounded(speakers.median_pitch(B.pitches(spark, d)), "speaker_f0")


@query(
    f"""WITH {B.PITCHES}, s AS (SELECT track_id, speaker, count(*) AS voiced, quantile_cont(f0, 0.5) AS m, quantile_cont(log2(f0), 0.9) - quantile_cont(log2(f0), 0.1) AS span FROM pitch WHERE f0 BETWEEN 80 AND 360 GROUP BY ALL)
SELECT track_id, speaker, voiced, CASE WHEN voiced >= 8 THEN round(m, 4) END AS median_f0, CASE WHEN voiced >= 8 THEN round(span * 12, 4) END AS range_semitones FROM s"""
)
def pitch_range(spark, d):
    return _rounded(audio.pitch_stats(B.pitches(spark, d), "track_id", "speaker"), "median_f0", "range_semitones")


_LOUD = B.PITCHES + """,
db AS (SELECT track_id, idx, speaker, CASE WHEN f0 > 60.02::DOUBLE AND idx % 10 > 0 THEN 20::DOUBLE * log10((f0 - 60) / 2000::DOUBLE) END AS db FROM pitch),
lv AS (SELECT d.*, m.c, m.med FROM db d JOIN (SELECT track_id, speaker, count(db) AS c, quantile_cont(db, 0.5) AS med FROM db GROUP BY ALL) m USING (track_id, speaker)),
loud AS (SELECT track_id, idx, speaker, CASE WHEN c >= 3 AND db IS NOT NULL THEN db - med ELSE 0::DOUBLE END AS intensity FROM lv)"""


def _loud(spark, d):
    # f0 less 60 is off by rounding, so the floor is that of f0, as in the SQL; its join leaves out rows without track or speaker
    rows = B.pitches(spark, d).where("track_id is not null and speaker is not null").selectExpr("*", "case when f0 > 60.02D then (f0 - 60) / 2000D end as rms", "(idx % 10) * 0.15D as dur_s")
    return audio.intensity(rows, "track_id", "speaker")


@query(f"WITH {_LOUD} SELECT track_id, idx, speaker, round(intensity, 4) AS intensity FROM loud")
def intensity_by_speaker(spark, d):
    return _rounded(_loud(spark, d), "intensity").selectExpr("track_id", "cast(idx as bigint) as idx", "speaker", "intensity")


@query(
    f"""WITH {_LOUD} SELECT track_id, idx, round(greatest(-5::DOUBLE, least(5::DOUBLE, intensity * 0.6::DOUBLE)), 4) AS gain_db,
  round(greatest(0.55::DOUBLE, least(0.95::DOUBLE, 0.72::DOUBLE + intensity * 0.022::DOUBLE + CASE WHEN idx % 3 = 0 THEN 0.06::DOUBLE WHEN idx % 3 = 1 THEN 0.02::DOUBLE ELSE 0::DOUBLE END)), 4) AS emotion FROM loud"""
)
def gain_emotion(spark, d):
    text = F.expr("case when idx % 3 = 0 then 'a!' when idx % 3 = 1 then 'a?' else 'a.' end")
    return _loud(spark, d).select("track_id", F.col("idx").cast("long").alias("idx"), _r(M.gain(F.col("intensity"))).alias("gain_db"), _r(M.emotion(F.col("intensity"), text)).alias("emotion"))


@query(
    f"""WITH {B.PITCHES}, by_label AS (SELECT track_id, label, count(*) AS n, count(*) FILTER (f0 < 140) AS low, count(*) FILTER (f0 > 178) AS high FROM pitch GROUP BY ALL),
s AS (SELECT *, n >= 4 AND low >= 2 AND high >= 2 AND low + high >= n * 0.7::DOUBLE AS split FROM by_label),
nl AS (SELECT track_id, label, CASE WHEN split THEN max(label) OVER (PARTITION BY track_id) + sum(split::INT) OVER (PARTITION BY track_id ORDER BY label) END AS new_label FROM s)
SELECT p.track_id, p.idx, (CASE WHEN new_label IS NOT NULL AND f0 > 159 THEN new_label ELSE p.label END)::INT AS label FROM pitch p JOIN nl USING (track_id, label)"""
)
def split_by_pitch(spark, d):
    return speakers.split_by_pitch(B.pitches(spark, d)).selectExpr("track_id", "cast(idx as bigint) as idx", "label")


# tracks of a low and a high voice: pitches above 90 are raised
_APART = B.PITCHES + """,
apart AS (SELECT track_id, idx, label, CASE WHEN idx % 7 = 0 THEN NULL WHEN track_id % 3 = 0 THEN f0 WHEN f0 > 90 THEN 150 + f0 / 4 ELSE f0 END AS f0 FROM pitch)"""


@query(
    f"""WITH {_APART}, s AS (SELECT track_id, list(f0 ORDER BY f0) AS fs FROM apart WHERE f0 IS NOT NULL GROUP BY track_id HAVING count(*) >= 6), k AS (SELECT track_id, fs, unnest(range(2, len(fs) - 1)) AS k FROM s),
c AS (SELECT track_id, k, (fs[k] + fs[k + 1]) / 2 AS cut, list_median(fs[k + 1:]) - list_median(fs[1:k]) AS gap, greatest((list_stddev_pop(fs[1:k]) + list_stddev_pop(fs[k + 1:])) / 2, 15::DOUBLE) AS spread FROM k),
b AS (SELECT track_id, cut, gap / spread AS score, row_number() OVER (PARTITION BY track_id ORDER BY gap / spread DESC, k) AS n FROM c WHERE gap >= 90)
SELECT a.track_id, a.idx, (CASE WHEN cut IS NULL OR f0 IS NULL THEN label WHEN f0 > cut THEN 1 ELSE 0 END)::INT AS label FROM apart a LEFT JOIN (SELECT * FROM b WHERE n = 1 AND score >= 1.2::DOUBLE) b USING (track_id)"""
)
def cluster_by_pitch(spark, d):
    rows = B.pitches(spark, d).selectExpr("track_id", "idx", "label", "case when idx % 7 = 0 then null when track_id % 3 = 0 then f0 when f0 > 90 then 150 + f0 / 4 else f0 end as f0")
    return speakers.cluster_by_pitch(rows)


@query(f"WITH {B.VECTORS} SELECT track_id, label, n, round(list_sum(centroid), 6) AS total, round(centroid[1], 6) AS first FROM cent")
def centroids(spark, d):
    return speakers.centroids(B.vectors(spark, d)).select("track_id", "label", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"))


@query(f"WITH {B.VECTORS} SELECT track_id, idx, arg_max(to_label, sim) AS label, round(max(sim), 6) AS sim FROM sims GROUP BY ALL")
def nearest_centroid(spark, d):
    rows = B.vectors(spark, d)
    return _rounded(speakers.nearest_centroid(rows, speakers.centroids(rows)), "sim", digits=6).select("track_id", "idx", F.col("label").cast("int").alias("label"), "sim")


@query(f"WITH {B.VECTORS} SELECT a.track_id, a.label, b.label AS other, round(list_dot_product(a.centroid, b.centroid), 6) AS sim FROM cent a JOIN cent b ON a.track_id = b.track_id AND a.label < b.label")
def centroid_pairs(spark, d):
    return _rounded(speakers.centroid_pairs(speakers.centroids(B.vectors(spark, d))), "sim", digits=6)


@query(f"WITH {B.VECTORS} SELECT track_id, idx, arg_max(to_label, sim)::INT AS label FROM sims GROUP BY ALL")
def refine_once(spark, d):
    return speakers.refine_once(B.vectors(spark, d))


@query(
    f"""WITH {B.VECTORS}, e AS (SELECT track_id, idx, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
f AS (SELECT track_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM e), t AS (SELECT track_id, label, pos, sum(x) AS s, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT track_id, label, max(n) AS n, list(s ORDER BY pos) AS s FROM t GROUP BY ALL),
p AS (SELECT e.track_id, e.idx, e.label = s.label AS own, s.n, list_dot_product(e.u, s.s) AS d FROM e JOIN s USING (track_id)),
ab AS (SELECT track_id, idx, max(n) FILTER (own) AS n, max(CASE WHEN own AND n > 1 THEN 1 - (d - 1) / (n - 1) END) AS a, min(CASE WHEN NOT own THEN 1 - d / n END) AS b FROM p GROUP BY ALL)
SELECT track_id, round(avg(CASE WHEN n <= 1 OR b IS NULL THEN 0::DOUBLE ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY track_id"""
)
def silhouette(spark, d):
    return _rounded(speakers.silhouette(B.vectors(spark, d)), "silhouette", digits=6)


@query(f"WITH {B.VECTORS}, l AS (SELECT track_id, CASE WHEN idx % 11 = 0 THEN NULL ELSE label END AS label FROM vec), c AS (SELECT track_id, label, count(*) AS n FROM l GROUP BY ALL) SELECT track_id, round(max(n) FILTER (label IS NOT NULL) / sum(n)::DOUBLE, 6) AS share, count(label) AS labels FROM c GROUP BY track_id")
def largest_share(spark, d):
    return _rounded(speakers.largest_share(B.vectors(spark, d).withColumn("label", F.when(F.expr("idx % 11 <> 0"), F.col("label")))), "share", digits=6)


@query(f"WITH {B.VECTORS}, c AS (SELECT track_id, label, count(*) AS n FROM vec GROUP BY ALL), s AS (SELECT track_id, max(n) / sum(n)::DOUBLE AS share, count(*) AS k FROM c GROUP BY track_id) SELECT track_id, k, CASE WHEN track_id / 10::DOUBLE < 0.2::DOUBLE OR (share > 0.9::DOUBLE AND k > 1) THEN 'unreliable' WHEN track_id / 10::DOUBLE < 0.4::DOUBLE OR share > 0.75::DOUBLE THEN 'weak' ELSE 'ok' END AS level FROM s")
def speaker_check(spark, d):
    rows = speakers.largest_share(B.vectors(spark, d))
    return rows.select("track_id", F.col("labels").alias("k"), rules.speaker_check(F.expr("track_id / 10D"), F.col("share"), F.col("labels")).alias("level"))


@query(
    f"""WITH {B.VECTORS}, l AS (SELECT track_id, idx, CASE WHEN idx % 3 = 0 THEN label END AS label, CASE WHEN idx % 3 = 0 THEN idx END AS at_idx FROM vec),
w AS (SELECT *, max(at_idx) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, min(at_idx) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM l)
SELECT w.track_id, w.idx, CASE WHEN i1 IS NULL OR w.idx - i0 <= i1 - w.idx THEN coalesce(x.label, y.label) ELSE y.label END AS label FROM w LEFT JOIN l x ON x.track_id = w.track_id AND x.idx = i0 LEFT JOIN l y ON y.track_id = w.track_id AND y.idx = i1"""
)
def nearest_label_fill(spark, d):
    rows = B.vectors(spark, d).select("track_id", "idx", F.when(F.expr("idx % 3 = 0"), F.col("label")).alias("label"))
    return intervals.nearest_filled(rows)


@query(
    f"""WITH {B.VECTORS},
anc AS (SELECT track_id, idx, CASE WHEN idx % 4 = 0 AND track_id > 0 THEN label END AS anchor, v FROM vec),
aflat AS (SELECT track_id, anchor, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM anc WHERE anchor IS NOT NULL), amean AS (SELECT track_id, anchor, pos, avg(x) AS m FROM aflat GROUP BY ALL),
ac0 AS (SELECT track_id, anchor, list(m ORDER BY pos) AS c FROM amean GROUP BY ALL), ac AS (SELECT track_id, anchor AS to_label, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9::DOUBLE)) AS c FROM ac0),
asim AS (SELECT u.track_id, u.idx, ac.to_label, list_dot_product(u.u, ac.c) AS sim FROM unit u JOIN ac USING (track_id)),
near AS (SELECT track_id, idx, to_label, sim, row_number() OVER w AS k, sim - coalesce(lead(sim) OVER w, -1) AS ahead, count(*) OVER (PARTITION BY track_id, idx) AS of FROM asim WINDOW w AS (PARTITION BY track_id, idx ORDER BY sim DESC, to_label)),
named AS (SELECT a.track_id, a.idx, coalesce(a.anchor, n.to_label) AS label FROM anc a LEFT JOIN near n ON n.track_id = a.track_id AND n.idx = a.idx AND n.k = 1 AND (n.ahead >= 0.05::DOUBLE OR n.of = 1)),
held AS (SELECT *, CASE WHEN label IS NOT NULL THEN idx END AS at_idx FROM named),
w AS (SELECT *, max(at_idx) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0, min(at_idx) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM held),
lab AS (SELECT w.track_id, w.idx, coalesce(CASE WHEN i1 IS NULL OR w.idx - i0 <= i1 - w.idx THEN coalesce(x.label, y.label) ELSE y.label END, 0) AS label FROM w LEFT JOIN held x ON x.track_id = w.track_id AND x.idx = i0 LEFT JOIN held y ON y.track_id = w.track_id AND y.idx = i1)
SELECT track_id, idx, (dense_rank() OVER (PARTITION BY track_id ORDER BY label) - 1)::INT AS label FROM lab"""
)
def anchors_assign(spark, d):
    rows = B.vectors(spark, d).withColumn("anchor", F.when(F.expr("idx % 4 = 0 and track_id > 0"), F.col("label")))
    return speakers.anchored(rows).select("track_id", "idx", "label")


@query()
def agglomerative(spark, d):
    return speakers.clustered(B.vectors(spark, d), k=6)


@query()
def character_clusters(spark, d):
    return speakers.clustered(B.vectors(spark, d), threshold=0.60)


@query()
def cluster_speakers(spark, d):
    return speakers.cluster_speakers(B.vectors(spark, d)).select("track_id", "idx", "label", "speaker")


@query()
def diarized_speakers(spark, d):
    rows = B.vectors(spark, d).selectExpr("track_id", "idx", "if(idx % 5 = 0, null, vec) as vec", "if(idx % 6 = 0, null, 90D + 150D * (label % 2) + idx % 13) as f0")
    return speakers.diarized(rows)


@query()
def merge_to_characters(spark, d):
    return speakers.merge_to(B.vectors(spark, d), 3)


@query(
    f"""WITH {B.VECTORS}, m AS (SELECT track_id, label AS face, pos, quantile_cont(x, 0.5) AS m, count(*) AS n FROM flat GROUP BY ALL), c AS (SELECT track_id, face, max(n) AS n, list(m ORDER BY pos) AS c FROM m GROUP BY ALL HAVING max(n) >= 3),
u AS (SELECT track_id, face, n, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9::DOUBLE)) AS c FROM c) SELECT track_id, face, n, round(list_sum(c), 6) AS total, round(c[1], 6) AS first FROM u"""
)
def face_vectors(spark, d):
    rows = speakers.face_vectors(B.vectors(spark, d).withColumnRenamed("label", "face"))
    return rows.select("track_id", "face", "n", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("vec")[0], 6).alias("first"))


@query()
def merge_close(spark, d):
    return speakers.merge_close(B.vectors(spark, d), target=4, alike=0.75, least=3)


@query()
def auto_k(spark, d):
    return speakers.auto_k(B.vectors(spark, d), most=6)


# Sound and pictures


@query(f"WITH {B.WINDOWS} SELECT w.cue, s.event_id FROM samples s JOIN win w ON s.track_id = w.track_id AND s.t BETWEEN w.start_s AND w.end_s")
def frames_in_cues(spark, d):
    return intervals.interval_join(B.samples(spark, d), B.windows(spark, d), 3600.0).select("cue", "event_id")


@query(f"WITH {B.WINDOWS} SELECT s.event_id, s.track_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.track_id = s.track_id AND s.t BETWEEN w.start_s AND w.end_s)")
def frames_outside_cues(spark, d):
    return intervals.interval_anti(B.samples(spark, d), B.windows(spark, d), 3600.0).select("event_id", "track_id")


@query(f"WITH {B.WINDOWS} SELECT s.event_id FROM samples s WHERE event_id % 6 = 0 OR EXISTS (SELECT 1 FROM win w WHERE w.track_id = s.track_id AND s.t BETWEEN w.start_s - 900 AND w.end_s + 900)")
def frames_to_scan(spark, d):
    return intervals.interval_semi(B.samples(spark, d), B.windows(spark, d), 3600.0, 900.0, 6, "event_id").select("event_id")


_DETREND = "value - median(value) OVER (PARTITION BY track_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"WITH {B.SAMPLES} SELECT event_id, round({_DETREND}, 4) AS detrended FROM samples")
def detrend(spark, d):
    rows = B.samples(spark, d).withColumn("o", F.struct("t", "event_id"))
    return _rounded(audio.detrended(rows, "value", "o"), "detrended").select("event_id", "detrended")


_BASE = B.WINDOWS + """,
seen AS (SELECT *, event_id % 2 AS face, (event_id * 7 % 100) / 100::DOUBLE AS level, (event_id % 9) / 100::DOUBLE AS size FROM samples),
outside AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.track_id = s.track_id AND s.t BETWEEN w.start_s AND w.end_s)),
moves AS (SELECT track_id, face, value - median(value) OVER (PARTITION BY track_id, face ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM outside),
sd AS (SELECT track_id, face, count(*) AS n, stddev_pop(x) AS sd FROM moves GROUP BY ALL),
base AS (SELECT t.track_id, t.face, coalesce(n, 0) AS n, CASE WHEN n >= 4 THEN greatest(0.02::DOUBLE, sd) ELSE 0.05::DOUBLE END AS baseline FROM (SELECT DISTINCT track_id, face FROM seen) t LEFT JOIN sd USING (track_id, face))"""


def _faces(spark, d):
    return B.samples(spark, d).selectExpr("track_id", "event_id % 2 as face", "t", "value", "(event_id * 7 % 100) / 100D as level", "(event_id % 9) / 100D as size")


@query(f"WITH {_BASE} SELECT track_id, face, n, round(baseline, 4) AS baseline FROM base")
def track_baselines(spark, d):
    return _rounded(audio.mouth_baselines(_faces(spark, d), B.windows(spark, d), 3600.0), "baseline")


_SCORES = _BASE + """,
wide AS (SELECT track_id, cue, start_s, start_s + 43200::DOUBLE AS end_s FROM win),
inside AS (SELECT w.track_id, w.cue, s.face, s.t, s.value, s.level, s.size FROM seen s JOIN wide w ON s.track_id = w.track_id AND s.t BETWEEN w.start_s AND w.end_s),
det AS (SELECT *, value - median(value) OVER (PARTITION BY track_id, cue, face ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM inside),
stat AS (SELECT track_id, cue, face, count(*) AS n, stddev_pop(x) AS sd, CASE WHEN stddev_pop(value) > 1e-6::DOUBLE AND stddev_pop(level) > 1e-6::DOUBLE THEN corr(value, level) ELSE 0 END AS r FROM det GROUP BY ALL HAVING count(*) >= 3 AND avg(size) >= 0.03::DOUBLE),
scored AS (SELECT s.track_id, cue, s.face, s.n, least(sd / (baseline * 3 + 1e-6::DOUBLE), 1::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * greatest(coalesce(CASE WHEN isnan(r) THEN 0::DOUBLE ELSE r END, 0::DOUBLE), 0::DOUBLE)) AS score FROM stat s JOIN base USING (track_id, face))"""


def _scores(spark, d):
    wide = B.windows(spark, d).withColumn("end_s", F.col("start_s") + 43200.0)
    return audio.cue_scores(_faces(spark, d), wide, audio.mouth_baselines(_faces(spark, d), B.windows(spark, d), 3600.0), 43200.0)


@query(f"WITH {_SCORES} SELECT track_id, cue, face, n, round(score, 4) AS score FROM scored")
def cue_scores(spark, d):
    return _rounded(_scores(spark, d), "score")


@query(
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS after FROM scored WINDOW w AS (PARTITION BY track_id, cue ORDER BY score DESC, face))
SELECT track_id, cue, face, round(score, 4) AS score FROM r WHERE k = 1 AND score >= 0.35::DOUBLE AND score - after >= 0.15::DOUBLE"""
)
def cue_winners(spark, d):
    return _rounded(audio.cue_winners(_scores(spark, d)), "score")


@query(
    f"""WITH {B.SAMPLES}, known AS (SELECT track_id, t, avg(value) AS v FROM samples WHERE event_type <> 'purchase' GROUP BY ALL), ask AS (SELECT track_id, event_id, t FROM samples WHERE event_type = 'purchase'),
b AS (SELECT a.*, k.t AS t0, k.v AS v0 FROM ask a ASOF LEFT JOIN known k ON a.track_id = k.track_id AND a.t >= k.t), c AS (SELECT b.*, k.t AS t1, k.v AS v1 FROM b ASOF LEFT JOIN known k ON b.track_id = k.track_id AND b.t <= k.t)
SELECT track_id, round(t, 3) AS t, round(CASE WHEN t0 = t THEN v0 WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) AS value FROM c"""
)
def envelope_interp(spark, d):
    rows = B.samples(spark, d)
    return _rounded(_rounded(intervals.interpolated(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'")), "value"), "t", digits=3)


_RUNS = B.FRAMES + """,
q AS (SELECT *, energy < 0.03::DOUBLE AS quiet, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n, lag(energy < 0.03::DOUBLE) OVER w AS before FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_no)),
isl AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> quiet THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_no) AS island FROM q)"""


@query(f"WITH {_RUNS} SELECT track_id, min(frame_no) AS first_frame, count(*) AS frames, round(count(*) * 0.02::DOUBLE, 4) AS seconds FROM isl WHERE quiet GROUP BY track_id, island HAVING min(i) > 1 AND max(i) < max(n) AND count(*) * 0.02::DOUBLE > 0.05::DOUBLE")
def quiet_runs(spark, d):
    return _rounded(audio.quiet_runs(B.frames(spark, d), 0.03, 0.05), "seconds").withColumn("first_frame", F.col("first_frame").cast("long"))


@query(
    f"""WITH {_RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY track_id, island ORDER BY frame_no) AS j, count(*) OVER (PARTITION BY track_id, island) AS m, max(island) OVER (PARTITION BY track_id) AS last_island FROM isl)
SELECT track_id, frame_no FROM k WHERE NOT (quiet AND island > 1 AND island < last_island AND j > 1 AND j <= m - 1)"""
)
def shortened_pauses(spark, d):
    return audio.shortened_pauses(B.frames(spark, d), 0.03, 1).selectExpr("track_id", "cast(frame_no as bigint) as frame_no")


# cues over the frames of a track: every third frame begins one of 7 to 10 frames
_CUED = B.FRAMES + """,
cued AS (SELECT track_id, frame_no AS cue, frame_no * 0.02::DOUBLE AS start_s, (frame_no + 7 + frame_no % 4) * 0.02::DOUBLE AS end_s FROM frames WHERE frame_no % 3 = 0)"""


def _cued(spark, d):
    return B.frames(spark, d).where("frame_no % 3 = 0").selectExpr("track_id", "cast(frame_no as bigint) as cue", "frame_no * 0.02D as start_s", "(frame_no + 7 + frame_no % 4) * 0.02D as end_s")


def _in_frames(back: int) -> str:
    return f"""{_CUED}, x AS (SELECT c.track_id, c.cue, c.start_s, f.frame_no, f.energy, max(f.energy) OVER (PARTITION BY c.track_id, c.cue) AS peak FROM cued c JOIN frames f ON f.track_id = c.track_id
  AND f.frame_no * 0.02::DOUBLE >= greatest(0::DOUBLE, c.start_s - {back} * 0.01::DOUBLE) - 1e-9::DOUBLE AND f.frame_no * 0.02::DOUBLE + 0.02::DOUBLE <= c.end_s + 0.01::DOUBLE)"""


@query(
    f"""WITH {_in_frames(0)}, g AS (SELECT track_id, cue, count(*) FILTER (peak > 0 AND energy > greatest(0.004::DOUBLE, peak * 0.06::DOUBLE)) * 0.02::DOUBLE AS s FROM x GROUP BY ALL)
SELECT c.track_id, c.cue, round(coalesce(s, 0), 4) AS speech_s FROM cued c LEFT JOIN g USING (track_id, cue)"""
)
def speech_seconds(spark, d):
    return _rounded(audio.speech_seconds(B.frames(spark, d), _cued(spark, d)), "speech_s")


@query(
    f"""WITH {_in_frames(35)}, g AS (SELECT track_id, cue, count(*) AS n, min(frame_no * 0.02::DOUBLE) FILTER (peak > 0 AND energy > greatest(0.006::DOUBLE, peak * 0.10::DOUBLE)) - min(start_s) AS s FROM x GROUP BY ALL)
SELECT c.track_id, c.cue, round(CASE WHEN n >= 3 THEN coalesce(s, 0) ELSE 0 END, 4) AS onset_s FROM cued c LEFT JOIN g USING (track_id, cue)"""
)
def onset(spark, d):
    return _rounded(audio.onset(B.frames(spark, d), _cued(spark, d)), "onset_s")


@query(f"WITH {B.FRAMES} SELECT track_id, frame_no, round(sum(energy) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS mean FROM frames")
def moving_gate(spark, d):
    return _rounded(audio.moving_mean(B.frames(spark, d), 5), "mean", digits=6).selectExpr("track_id", "cast(frame_no as bigint) as frame_no", "mean")


@query(
    f"""WITH {B.FRAMES}, p AS (SELECT *, max(energy) OVER (PARTITION BY track_id) AS peak FROM frames), l AS (SELECT *, CASE WHEN peak > 0 THEN least(1, greatest(0, energy / greatest(peak * 0.12::DOUBLE, 1e-6::DOUBLE))) ELSE 0 END AS level FROM p)
SELECT track_id, frame_no, round((level + coalesce(lag(level) OVER (PARTITION BY track_id ORDER BY frame_no), 0)) / 2, 6) AS gate FROM l"""
)
def speech_gate(spark, d):
    return _rounded(audio.speech_gate(B.frames(spark, d)), "gate", digits=6).selectExpr("track_id", "cast(frame_no as bigint) as frame_no", "gate")


# Planning, artefacts, terms


@query(
    f"""WITH RECURSIVE {B.SAMPLES}, o AS (SELECT event_type AS stage, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, value FROM samples WHERE value > 0),
rec(stage, k, rate) AS (SELECT stage, k, value FROM o WHERE k = 1 UNION ALL SELECT o.stage, o.k, rec.rate * 0.6::DOUBLE + o.value * 0.4::DOUBLE FROM rec JOIN o ON o.stage = rec.stage AND o.k = rec.k + 1)
SELECT stage, round(arg_max(rate, k), 4) AS rate, max(k) AS observations FROM rec GROUP BY stage"""
)
def ema_rates(spark, d):
    rows = B.read(spark, d, "events").selectExpr("event_type as stage", "event_id as ord", "value")
    return _rounded(planning.ema(rows, 0.6, "stage"), "rate")


@query(
    f"""WITH {B.CUE}, p AS (SELECT track_id, max(end_s) AS video_s, sum(CASE WHEN window_s > 0 THEN least(length(text) / 12.6::DOUBLE, window_s * 1.25::DOUBLE) ELSE length(text) / 12.6::DOUBLE END) AS speech_s, count(*) AS cues FROM cue GROUP BY track_id),
st AS (SELECT * FROM (VALUES ('diarize', 'cues', 0.55::DOUBLE, 8::DOUBLE), ('synth_kokoro', 'speech', 0.15::DOUBLE, 6::DOUBLE), ('mux', 'video', 0.03::DOUBLE, 0::DOUBLE)) v(stage, unit, rate, startup_s))
SELECT track_id, stage, round(CASE unit WHEN 'cues' THEN cues::DOUBLE WHEN 'speech' THEN speech_s ELSE video_s END * rate + startup_s, 3) AS seconds FROM p CROSS JOIN st"""
)
def cost_breakdown(spark, d):
    return _rounded(planning.cost(planning.plans(B.cue_track(spark, d)), planning.stage_table(spark), ["diarize", "synth_kokoro", "mux", "unheard_of"]), "seconds", digits=3).select("track_id", "stage", "seconds")


_KEYS = "keys AS (SELECT doc_id, 'doc' || doc_id AS artefact, left(sha1('lang=' || coalesce(lang, 'missing') || '|size=' || coalesce(n_chars::VARCHAR, 'missing')), 16) AS key FROM documents)"


def _keys(spark, d):
    docs = B.read(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("artefact"), planning.artefact_key({"size": F.col("n_chars"), "lang": F.col("lang")}).alias("key"))


@query(f"WITH {_KEYS} SELECT artefact, key FROM keys")
def provenance_keys(spark, d):
    return _keys(spark, d).select("artefact", "key")


@query(f"WITH {_KEYS} SELECT artefact FROM keys WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def stale_artifacts(spark, d):
    now = _keys(spark, d)
    manifest = now.where("doc_id % 5 <> 0").withColumn("key", F.when(F.expr("doc_id % 7 = 0"), "old").otherwise(F.col("key")))
    return planning.stale(now, manifest).select("artefact")


@query(
    rf"""WITH {B.LINES}, l AS (SELECT (track_id % 20) AS track_id, track_id * 100000 + seq AS seq, text FROM lines), s0 AS (SELECT track_id, seq, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM l),
s AS (SELECT track_id, seq, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS s FROM s0), w0 AS (SELECT track_id, seq, s, regexp_extract_all(sentence, '(?:^|[^A-Za-z''’\-])([A-Z][a-zA-Z''’\-]{{2,}})', 1) AS ws, regexp_extract(sentence, '^([A-Z][a-zA-Z''’\-]{{2,}})', 1) AS first FROM s),
w AS (SELECT track_id, seq, s, first, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS w FROM w0),
c AS (SELECT track_id, term, count(*) AS n, min(seq * 1000000000 + s * 10000 + w) AS first_at FROM w WHERE NOT (w = 0 AND first <> '') AND term <> upper(term) AND term NOT IN ({', '.join("'" + x.replace("'", "''") + "'" for x in planning.COMMON_WORDS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, first_at) AS rank FROM c) SELECT track_id, term, n, rank FROM r WHERE rank <= 120 AND n >= 2"""
)
def term_candidates(spark, d):
    rows = B.caption_lines(spark, d).selectExpr("track_id % 20 as track_id", "track_id * 100000 + seq as seq", "text")
    return planning.term_candidates(rows).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {B.CUE}, p AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY track_id) // 3) AS step FROM cue),
q AS (SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS pick FROM p WHERE i % step = 0 AND length(text) > 15) SELECT * FROM q WHERE pick <= 3"""
)
def evenly_spaced_sample(spark, d):
    return planning.even_sample(B.cue_track(spark, d), 3).selectExpr("track_id", "idx", "cast(pick as bigint) as pick")


# Replies, takes, voices and frames made of the tables


@query(f"WITH {B.CUE} SELECT track_id, idx, CASE WHEN speaker = 'user' THEN 0.30::DOUBLE ELSE 0.24::DOUBLE END AS gap, CASE WHEN speaker = 'user' THEN 12::DOUBLE ELSE 5::DOUBLE END AS span FROM cue")
def merge_policies(spark, d):
    gap, span = cues.merge_policy(F.col("speaker") == "user")
    return B.cue_track(spark, d).select("track_id", "idx", gap.alias("gap"), span.alias("span"))


@query(
    f"""WITH {B.CUE}, v AS (SELECT track_id, speaker, 'v' || (idx * idx % 5) AS voice, idx FROM cue), n AS (SELECT track_id, speaker, voice, count(*) AS n, min(idx) AS i FROM v GROUP BY ALL)
SELECT track_id, speaker, arg_max(voice, (n, -i)) AS voice, count(*) AS voices FROM n GROUP BY ALL"""
)
def common_voices(spark, d):
    return casting.common_voice(B.cue_track(spark, d).withColumn("voice", F.expr("concat('v', idx * idx % 5)")))


@query(
    f"""WITH {B.PITCHES} SELECT track_id, speaker, round(avg((f0 <= 200 AND idx % 4 > 0)::INT), 6) AS voiced, avg((f0 <= 200 AND idx % 4 > 0)::INT) >= 0.004::DOUBLE AS usable FROM pitch GROUP BY ALL"""
)
def voiced_references(spark, d):
    frames_ = B.pitches(spark, d).selectExpr("track_id", "speaker", "if(f0 <= 200, f0, null) as f0", "(idx % 4) * 0.4D + 0.2D as prob")
    return _rounded(casting.voiced_fraction(frames_, "track_id", "speaker"), "voiced", digits=6)


@query(
    f"""WITH {B.FRAMES}, l AS (SELECT *, max(frame_no) OVER (PARTITION BY track_id) AS last FROM frames) SELECT track_id, arg_min(frame_no, (energy, frame_no)) AS frame_no FROM l WHERE (last - frame_no) * 0.01::DOUBLE < 0.12::DOUBLE GROUP BY track_id"""
)
def quietest_cuts(spark, d):
    return audio.quietest_cut(B.frames(spark, d), 0.12).select("track_id", F.col("frame_no").cast("long").alias("frame_no"))


@query(f"WITH {B.FRAMES}, c AS (SELECT *, coalesce(abs(energy * 1000 - lag(energy * 1000) OVER w) > 18, false)::INT AS jump FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_no)) SELECT track_id, frame_no, sum(jump) OVER (PARTITION BY track_id ORDER BY frame_no)::BIGINT AS scene FROM c")
def shot_cuts(spark, d):
    return audio.shot_cuts(B.frames(spark, d).withColumn("level", F.col("energy") * 1000)).selectExpr("track_id", "cast(frame_no as bigint) as frame_no", "cast(scene as bigint) as scene")


@query(f"WITH {B.PITCHES} SELECT track_id, speaker, round(CASE WHEN count(f0) >= 6 THEN regr_slope(12 * log2(f0), idx * 0.1::DOUBLE) ELSE 0 END, 4) AS f0_end_slope FROM pitch WHERE idx % 7 < 5 AND f0 < 300 GROUP BY ALL")
def terminal_slopes(spark, d):
    tail = B.pitches(spark, d).where("idx % 7 < 5 and f0 < 300").selectExpr("track_id", "speaker", "idx * 0.1D as t", "f0")
    return _rounded(audio.terminal_slope(tail, "track_id", "speaker"), "f0_end_slope")


@query(
    f"""WITH {B.PITCHES}, t AS (SELECT track_id, speaker, idx, f0 / (100 + idx % 90) AS ratio FROM pitch),
m AS (SELECT *, quantile_cont(ratio, 0.5) OVER (PARTITION BY track_id, speaker ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS r FROM t)
SELECT track_id, idx, round(r, 4) AS ratio, round(CASE WHEN abs(greatest(-6, least(6, 12 * log2(r)))) < 0.75::DOUBLE THEN 0 ELSE greatest(-6, least(6, 12 * log2(r))) END, 4) AS shift FROM m"""
)
def register_shifts(spark, d):
    takes = B.pitches(spark, d).selectExpr("track_id", "speaker", "idx", "f0 as target_f0", "100D + idx % 90 as median_f0")
    return _rounded(timing.register_ratio(takes), "ratio", "shift").selectExpr("track_id", "cast(idx as bigint) as idx", "ratio", "shift")


_TAKES = "takes AS (SELECT track_id, idx // 4 AS idx, (idx % 4)::INT AS take, f0 / 50 AS liveliness, (idx % 3) * 0.25::DOUBLE AS register_off, (idx % 5) * 0.1::DOUBLE AS dead_s, idx % 6 = 0 AS broken FROM pitch)"


@query(f"WITH {B.PITCHES}, {_TAKES}, s AS (SELECT *, liveliness - 2 * register_off - 3 * dead_s AS score FROM takes WHERE NOT broken) SELECT track_id, idx, arg_max(take, (score, -take))::INT AS take, round(max(score), 4) AS score FROM s GROUP BY ALL")
def best_takes(spark, d):
    takes = B.pitches(spark, d).selectExpr("track_id", "idx div 4 as idx", "cast(idx % 4 as int) as take", "f0 / 50 as liveliness", "(idx % 3) * 0.25D as register_off", "(idx % 5) * 0.1D as dead_s", "idx % 6 = 0 as broken")
    return _rounded(timing.best_take(takes), "score")


@query(
    f"""WITH {B.CUE}, r AS (SELECT track_id, idx // 3 AS idx, idx % 3 AS round, text, idx % 4 > 0 AS acceptable FROM cue) SELECT track_id, idx, arg_min(text, (length(text), round)) AS text FROM r WHERE acceptable AND text <> '' GROUP BY ALL"""
)
def best_translations(spark, d):
    replies = B.cue_track(spark, d).selectExpr("track_id", "idx div 3 as idx", "idx % 3 as round", "text", "idx % 4 > 0 as acceptable")
    return edits.best_translation(replies)


@query(
    rf"""WITH {B.CUE}, r AS (SELECT track_id, idx, CASE idx % 4 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN 'Line: ' || text WHEN 2 THEN '«' || text || '»' || chr(10) || 'Note' ELSE ' ' || text END AS reply FROM cue),
q AS (SELECT *, regexp_replace(regexp_replace(trim(reply), '^["''“”«»]+|["''“”«»]+$', '', 'g'), '^[^:
]{{0,24}}:\s*(\S)', '\1') AS t FROM r) SELECT track_id, idx, trim(string_split(t, chr(10))[1]) AS said FROM q"""
)
def clean_replies(spark, d):
    reply = F.expr("case idx % 4 when 0 then concat('\"', text, '\"') when 1 then concat('Line: ', text) when 2 then concat('«', text, '»\\nNote') else concat(' ', text) end")
    return B.cue_track(spark, d).select("track_id", "idx", X.clean_reply(reply).alias("said"))


@query(
    f"""WITH {B.CUE}, g AS (SELECT track_id, idx // 5 AS part, idx % 5 AS k, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM cue), n AS (SELECT track_id, part, CASE WHEN k = 4 THEN 2 WHEN k = 3 THEN 9 ELSE k + 1 END AS number, k, t FROM g WHERE t <> '' AND k <> 1)
SELECT track_id, part, number::INT AS number, arg_max(t, k) AS said FROM n WHERE number BETWEEN 1 AND 5 GROUP BY ALL"""
)
def numbered_replies(spark, d):
    lines = B.cue_track(spark, d).withColumn("t", X.squeeze(F.col("text"))).where("t <> ''")
    line = F.expr("case when idx % 5 = 1 then concat('x ', t) else concat(case idx % 5 when 4 then '2) ' when 3 then '9. ' else concat(idx % 5 + 1, ': ') end, t) end")
    reply = lines.groupBy("track_id", F.expr("idx div 5").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("t")))), lambda x: x["t"]), "\n").alias("reply"))
    return reply.select("track_id", "part", F.explode(X.numbered_replies(F.col("reply"), F.lit(5))).alias("number", "said"))


@query("SELECT item_id, 'about ' || item_id AS summary, 'n' AS notes, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END::INT AS terms FROM benchmark WHERE item_id % 4 <> 0")
def briefs(spark, d):
    body = F.expr("concat('{\"summary\": \"about ', item_id, '\", \"notes\": \"n\", \"glossary\": [{\"term\": \"a\", \"target\": \"', if(item_id % 3 = 0, ' ', 'b'), '\", \"why\": \"w\"}]}')")
    reply = F.expr("case item_id % 4 when 0 then 'no json here' when 1 then body when 2 then concat('```json\\n', body, '\\n```') else concat('Here it is: ', body) end")
    rows = B.read(spark, d, "benchmark").withColumn("body", body).select("item_id", X.brief_of(reply).alias("b")).where("b is not null")
    return rows.select("item_id", "b.summary", "b.notes", F.size("b.glossary").alias("terms"))


@query(
    """WITH r AS (SELECT item_id, item_id % 11 <> 0 AS has_video, item_id % 7 <> 0 AS installed, item_id % 5 <> 0 AS scanned, item_id % 4 AS faces, item_id % 3 AS characters, (item_id % 6) / 20::DOUBLE AS silhouette, (item_id % 9) / 10::DOUBLE AS labelled, (item_id % 10) / 10::DOUBLE AS top_share FROM benchmark)
SELECT item_id, CASE WHEN NOT has_video THEN 'no video' WHEN NOT installed THEN 'no scanner' WHEN NOT scanned THEN 'scan failed' WHEN faces = 0 THEN 'no faces' WHEN characters < 2 THEN 'one character' WHEN silhouette < 0.10::DOUBLE THEN 'characters alike' WHEN labelled < 0.25::DOUBLE THEN 'few lines labelled' WHEN top_share > 0.80::DOUBLE THEN 'one character in most lines' END AS reject FROM r"""
)
def reject_ladder(spark, d):
    rows = B.read(spark, d, "benchmark").selectExpr(
        "item_id", "item_id % 11 <> 0 as has_video", "item_id % 7 <> 0 as installed", "item_id % 5 <> 0 as scanned", "item_id % 4 as faces", "item_id % 3 as characters", "(item_id % 6) / 20D as silhouette", "(item_id % 9) / 10D as labelled", "(item_id % 10) / 10D as top_share"
    )
    return audio.reject_reason(rows).select("item_id", "reject")


@query(
    """WITH f AS (SELECT vec_id, vec_id % 7 AS track_id, vec_id // 7 % 3 AS scene, (vec_id // 21) * 1::DOUBLE AS t FROM embeddings) SELECT track_id, scene, t, (row_number() OVER (PARTITION BY track_id, scene ORDER BY t) - 1)::INT AS face FROM f"""
)
def face_numbers(spark, d):
    """Detections too far apart in time to be one face: each is a new one."""
    rows = B.read(spark, d, "embeddings").selectExpr("vec_id % 7 as track_id", "vec_id div 7 % 3 as scene", "(vec_id div 21) * 1D as t", "array(0D, 0D, 10D, 10D) as bbox", "cast(embedding as array<double>) as sface")
    return speakers.face_tracks(rows)
