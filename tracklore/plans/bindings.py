"""Dialogue tracks made of the driver's tables, for Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cues import gaps


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cue_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as cues: a turn's whole text in pieces of 20 to 80 characters; times from whole milliseconds."""
    rows = read(spark, sf_dir, "conversations").selectExpr("conv_id as track_id", "turn", "role as speaker", "text", "cast(20 + ((conv_id * 7 + turn * 13) % 61) as int) as n")
    rows = rows.selectExpr("*", "explode(sequence(0, greatest(1, cast(ceil(coalesce(char_length(text), 0) / n) as int)) - 1)) as piece")
    rows = rows.selectExpr("track_id", "row_number() over (partition by track_id order by turn, piece) - 1L as idx", "speaker", "substring(text, piece * n + 1, n) as text")
    rows = rows.selectExpr("*", "greatest(500, (char_length(text) * 1000) div 14) as win_ms", "50 + (idx % 4) * 400 as gap_ms")
    rows = rows.selectExpr("*", "cast(coalesce(sum(win_ms + gap_ms) over (partition by track_id order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms")
    rows = rows.selectExpr(
        "track_id", "idx", "speaker", "text", "start_ms", "start_ms + win_ms as end_ms", "start_ms / 1000D as start_s", "(start_ms + win_ms) / 1000D as end_s",
        "char_length(text) / 12.6D * (0.6D + 0.2D * ((track_id + idx) % 8)) as rendered_dur", "0D as source_speech", "0D as speech_onset", "(max(start_ms + win_ms) over (partition by track_id) + 500) / 1000D as total_s",
    )
    return gaps(rows)


CUE = """sized_turn AS (SELECT conv_id AS track_id, turn, role AS speaker, text, (20 + ((conv_id * 7 + turn * 13) % 61))::BIGINT AS n FROM conversations),
pieces AS (SELECT *, unnest(range(0, greatest(1, ceil(coalesce(length(text), 0) / n)::BIGINT))) AS piece FROM sized_turn),
raw_cue AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY turn, piece) - 1 AS idx, speaker, substring(text, piece * n + 1, n) AS text FROM pieces),
win_cue AS (SELECT *, greatest(500, (length(text) * 1000) // 14)::BIGINT AS win_ms, 50 + (idx % 4) * 400 AS gap_ms FROM raw_cue),
at_cue AS (SELECT *, coalesce(sum(win_ms + gap_ms) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM win_cue),
cue0 AS (SELECT track_id, idx, speaker, text, start_ms, start_ms + win_ms AS end_ms, start_ms / 1000::DOUBLE AS start_s, (start_ms + win_ms) / 1000::DOUBLE AS end_s,
  length(text) / 12.6::DOUBLE * (0.6::DOUBLE + 0.2::DOUBLE * ((track_id + idx) % 8)) AS rendered_dur, 0::DOUBLE AS source_speech,
  (max(start_ms + win_ms) OVER (PARTITION BY track_id) + 500) / 1000::DOUBLE AS total_s FROM at_cue),
cue AS (SELECT *, greatest(0::DOUBLE, coalesce(lead(start_s) OVER (PARTITION BY track_id ORDER BY idx), total_s) - end_s) AS gap_s, end_s - start_s AS window_s FROM cue0)"""


def said(source: str) -> str:
    """Common table expressions that add to the rows of source their text as it is spoken: said0 to said."""
    step = lambda n, of, x: f"said{n} AS (SELECT * EXCLUDE (t), {x} AS t FROM {of})"
    marks = (
        "array_to_string(list_transform(regexp_extract_all(t, '([.,!?;:]+|[^.,!?;:]+)'), lambda x: CASE WHEN length(x) < 2 THEN x WHEN regexp_full_match(x, '\\.+') THEN CASE WHEN length(x) >= 3 THEN '...' ELSE '.' END "
        "WHEN NOT regexp_matches(x, '^[.,!?;:]') THEN x WHEN contains(x, '?') THEN '?' WHEN contains(x, '!') THEN '!' WHEN contains(x, '.') THEN '.' WHEN regexp_extract(x, '[;:]') <> '' THEN regexp_extract(x, '[;:]') ELSE ',' END), '')"
    )
    return ",\n".join(
        [
            f"said0 AS (SELECT *, regexp_replace(text, '^\\s*[-–—]+\\s*', '') AS t FROM {source})",
            step(1, "said0", "replace(regexp_replace(t, '[\"“”«»‘’`]', '', 'g'), '…', '...')"),
            step(2, "said1", "regexp_replace(regexp_replace(regexp_replace(t, '\\s*(?:--+|[–—]+)\\s*', ', ', 'g'), '^\\s*:\\s*', ''), '\\s+([,.!?;:])', '\\1', 'g')"),
            step(3, "said2", marks),
            step(4, "said3", "regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^[ \\-–—:;,]+', ''), '[ \\-–—:;,]+$', '')"),
            "said AS (SELECT * EXCLUDE (t), CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS said FROM said4)",
        ]
    )


FIT = (
    CUE
    + ",\n"
    + said("cue")
    + """,
fit1 AS (SELECT *, least(CASE WHEN source_speech > 0.3::DOUBLE THEN source_speech ELSE window_s END, window_s) * 0.85::DOUBLE AS target,
  greatest(0::DOUBLE, least(1.5::DOUBLE, gap_s - 0.12::DOUBLE)) AS may_borrow FROM said),
fit2 AS (SELECT *, window_s + may_borrow AS budget, greatest(0.94::DOUBLE, rendered_dur / target) AS slow FROM fit1),
fit3 AS (SELECT *, rendered_dur > budget AS long, rendered_dur <= window_s AND rendered_dur < target AND rendered_dur >= length(said) / 12.6::DOUBLE * 0.55::DOUBLE AND slow <= 0.985::DOUBLE AS fills,
  least(rendered_dur / budget, 1.25::DOUBLE) AS faster FROM fit2),
fit4 AS (SELECT *, CASE WHEN long AND faster > 1.01::DOUBLE THEN faster ELSE 1::DOUBLE END AS engine_speed FROM fit3),
fit5 AS (SELECT *, rendered_dur / engine_speed AS dur1 FROM fit4),
fit6 AS (SELECT *, CASE WHEN dur1 / budget > 1.15::DOUBLE THEN least(dur1 / budget, 1.45::DOUBLE) ELSE dur1 / budget END AS rate, long AND dur1 > budget + 1e-9::DOUBLE AS still FROM fit5),
fit7 AS (SELECT *, CASE WHEN fills THEN slow WHEN still AND rate > 1.01::DOUBLE THEN rate ELSE 1::DOUBLE END AS stretch FROM fit6),
fit8 AS (SELECT *, dur1 / stretch AS final_dur FROM fit7),
fit9 AS (SELECT *, CASE WHEN rendered_dur > window_s THEN greatest(0::DOUBLE, least(final_dur, budget) - window_s) ELSE 0::DOUBLE END AS borrowed,
  CASE WHEN long AND final_dur - budget > 0.15::DOUBLE THEN final_dur - budget ELSE 0::DOUBLE END AS overrun FROM fit8),
fitted AS (SELECT *, CASE WHEN overrun > 0 THEN 'overrun' WHEN stretch < 1 THEN 'filled' WHEN stretch > 1 THEN 'stretched' WHEN engine_speed > 1 THEN 'resynth' WHEN borrowed > 0 THEN 'borrowed' ELSE 'clean' END AS outcome FROM fit9)"""
)
LAID = (
    FIT
    + """,
lay1 AS (SELECT *, window_s + gap_s - 0.12::DOUBLE AS free, lead(speaker) OVER (PARTITION BY track_id ORDER BY idx) AS after, lead(idx) OVER (PARTITION BY track_id ORDER BY idx) AS next_idx FROM fitted),
lay2 AS (SELECT *, free + CASE WHEN after <> '' AND after IS DISTINCT FROM speaker THEN 0.45::DOUBLE ELSE 0::DOUBLE END AS room FROM lay1),
lay3 AS (SELECT *, greatest(0::DOUBLE, final_dur - room) AS truncated FROM lay2),
laid AS (SELECT *, CASE WHEN free > 0 AND final_dur - truncated - free > 1e-9::DOUBLE THEN final_dur - truncated - free ELSE 0::DOUBLE END AS overlapped FROM lay3)"""
)


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document as caption events."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return rows.selectExpr("track_id", "cast(seq as bigint) as seq", "seq * 2.0D as start_s", "seq * 2.0D + 2.0D + (seq % 3) * 0.5D as end_s", "text")


LINES = """lines0 AS (SELECT doc_id AS track_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
lines AS (SELECT track_id, seq::BIGINT AS seq, seq * 2.0::DOUBLE AS start_s, seq * 2.0::DOUBLE + 2.0::DOUBLE + (seq % 3) * 0.5::DOUBLE AS end_s, text FROM lines0)"""


def rolling_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of every document in windows of eight that move on by four, as automatic captions roll."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("track_id"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    k = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / 4).cast("int") - 1, F.lit(0)))
    rows = docs.select("track_id", "w", F.explode(k).alias("k")).selectExpr("track_id", "cast(k as bigint) as seq", "k * 2.0D as start_s", "k * 2.0D + 2.0D as end_s", "array_join(slice(w, 4 * k + 1, 8), ' ') as text")
    return rows.where("text <> ''")


ROLLING = """docs_w AS (SELECT doc_id AS track_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
rolling0 AS (SELECT track_id, w, unnest(range(0, ceil(len(w) / 4)::BIGINT)) AS seq FROM docs_w),
rolling AS (SELECT track_id, seq, seq * 2.0::DOUBLE AS start_s, seq * 2.0::DOUBLE + 2.0::DOUBLE AS end_s, array_to_string(w[4 * seq + 1:4 * seq + 8], ' ') AS text FROM rolling0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as timed samples of a track."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id as track_id", "event_id", "event_type", "value", "timestampdiff(MICROSECOND, min(ts) over (partition by user_id), ts) / 1000000D as t")
    return rows


SAMPLES = "samples AS (SELECT user_id AS track_id, event_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000::DOUBLE AS t FROM events)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour from each purchase."""
    return samples(spark, sf_dir).where("event_type = 'purchase'").selectExpr("track_id", "event_id as cue", "t as start_s", "t + 3600D as end_s")


WINDOWS = SAMPLES + ",\nwin AS (SELECT track_id, event_id AS cue, t AS start_s, t + 3600::DOUBLE AS end_s FROM samples WHERE event_type = 'purchase')"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).selectExpr("track_id", "row_number() over (partition by track_id order by t, event_id) - 1 as frame_no", "value / 1000D as energy")


FRAMES = SAMPLES + ",\nframes AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS frame_no, value / 1000::DOUBLE AS energy FROM samples)"


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as pitch of lines; two speakers a track."""
    return samples(spark, sf_dir).selectExpr(
        "track_id", "row_number() over (partition by track_id order by t nulls last, event_id nulls last) - 1 as idx", "value + 60D as f0", "'S0' || cast(event_id % 2 as string) as speaker", "cast(event_id % 3 as int) as label"
    )


PITCHES = SAMPLES + ",\npitch AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS idx, value + 60::DOUBLE AS f0, 'S0' || (event_id % 2)::VARCHAR AS speaker, (event_id % 3)::INT AS label FROM samples)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as voice vectors of five tracks."""
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id % 5 as track_id", "vec_id as idx", "cast(label as int) as label", "cast(embedding as array<double>) as vec")


VECTORS = """vec AS (SELECT vec_id % 5 AS track_id, vec_id AS idx, label::INT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
flat AS (SELECT track_id, idx, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec),
mean AS (SELECT track_id, label, pos, avg(x) AS m, count(*) AS n FROM flat GROUP BY ALL),
cent0 AS (SELECT track_id, label, max(n) AS n, list(m ORDER BY pos) AS c FROM mean GROUP BY ALL),
cent AS (SELECT track_id, label, n, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-9::DOUBLE)) AS centroid FROM cent0),
unit AS (SELECT track_id, idx, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9::DOUBLE)) AS u FROM vec),
sims AS (SELECT u.track_id, u.idx, u.label, c.label AS to_label, list_dot_product(u.u, c.centroid) AS sim FROM unit u JOIN cent c USING (track_id))"""
