"""SQL for DuckDB of those queries that SQL can express."""

from __future__ import annotations

from .mixing import TEMPER
from .secrets import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates() -> str:
    """Components by the lowest id, one step of a link at a time."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


def repeats() -> str:
    """Every 200-byte window of every text by its digest; removed runs are windows that overlap or touch."""
    return """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
hs AS (SELECT doc_id, list_transform(range(1, octet_length(b) - 198), lambda k: md5(array_slice(b, k, k + 199))) AS hs FROM d WHERE octet_length(b) >= 200),
h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS k FROM hs),
hit AS (SELECT doc_id, k FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
isl AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM hit)),
runs AS (SELECT doc_id, g, min(k) AS a, max(k) + 199 AS z FROM isl GROUP BY ALL),
gaps AS (SELECT doc_id, g, coalesce(lag(z) OVER w, 0) + 1 AS from_at, a - 1 AS to_at, z - a + 1 AS gone, g = max(g) OVER (PARTITION BY doc_id) AS last, z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN to_at >= from_at THEN hex(array_slice(b, from_at, to_at)) ELSE '' END || CASE WHEN last AND z < octet_length(b) THEN hex(array_slice(b, z + 1, octet_length(b))) ELSE '' END, '' ORDER BY g) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), b)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def secrets() -> str:
    """Every rule on every text; offsets are sums of the lengths before."""
    parts, lists = [], []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"m{k} AS (SELECT doc_id, regexp_extract_all(t, '({p})', 0) AS m, regexp_extract_all(t, '({p})', {r.value_group + 1}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')),\n"
            f"s{k} AS (SELECT doc_id, '{r.name}' AS kind, {k} AS rank, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(v[i]) AS vn FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k})),"
        )
        lists.append(f"SELECT doc_id, kind, rank, s::BIGINT AS s, (s + n)::BIGINT AS e FROM s{k} WHERE vn >= {r.least}")
    base = ", ".join(f"'{r.name}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{chr(10).join(parts)}
spans AS ({" UNION ALL ".join(lists)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


def contamination() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}') AS w FROM documents),
at AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hits AS (SELECT a.doc_id, a.k, a.n, win.item_id FROM at a JOIN win ON win.n = a.n AND win.g = array_to_string(a.w[a.k:a.k + a.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM hits),
runs AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit_words) GROUP BY doc_id, g),
lens AS (SELECT doc_id, list_transform(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}'), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}'), lambda x: length(x)) AS wl FROM documents WHERE doc_id IN (SELECT doc_id FROM runs)),
spans AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM (SELECT doc_id, (list_sum(gap[1:a]) + coalesce(list_sum(wl[1:a - 1]), 0))::BIGINT AS s, (list_sum(gap[1:b]) + list_sum(wl[1:b]))::BIGINT AS e FROM runs JOIN lens USING (doc_id)) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)""".replace("at AS (", "places AS (").replace("FROM at a", "FROM places a")


def mixture(rounds: int = 40) -> str:
    goal = lambda d: f"g_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {TEMPER[d]}::DOUBLE) / (SELECT sum(x) FROM (SELECT pow(sum(tokens)::DOUBLE, {TEMPER[d]}::DOUBLE) AS x FROM cells GROUP BY {d} HAVING sum(tokens) > 0)) AS goal_{d} FROM cells GROUP BY {d} HAVING sum(tokens) > 0)"
    step = lambda d, a, b: f"CASE WHEN sum({a}) OVER (PARTITION BY {d}) > 0 THEN {a} * goal_{d} / sum({a}) OVER (PARTITION BY {d}) ELSE {a} END AS {b}"
    return f"""WITH RECURSIVE m AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
docs AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 60 THEN 'note' WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact' ELSE 'prose' END AS topic FROM m),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
{goal("source")}, {goal("lang")}, {goal("topic")},
start AS (SELECT c.*, goal_source, goal_lang, goal_topic FROM cells c LEFT JOIN g_source USING (source) LEFT JOIN g_lang USING (lang) LEFT JOIN g_topic USING (topic)),
rec AS (SELECT 0 AS k, *, tokens::DOUBLE AS w FROM start
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, goal_source, goal_lang, goal_topic, w3 FROM (SELECT *, {step("topic", "w2", "w3")} FROM (SELECT *, {step("lang", "w1", "w2")} FROM (SELECT *, {step("source", "w", "w1")} FROM rec WHERE k < {rounds})))),
raked AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w * (SELECT sum(tokens) FROM cells)::DOUBLE / tokens ELSE 1::DOUBLE END AS weight FROM rec WHERE k = {rounds}),
p AS (SELECT *, weight / (SELECT max(weight) FROM raked) AS p FROM raked),
off AS (SELECT max(abs(s - g)) AS off FROM (SELECT sum(w) AS s, any_value(goal_source) AS g FROM rec WHERE k = {rounds} GROUP BY source UNION ALL SELECT sum(w), any_value(goal_lang) FROM rec WHERE k = {rounds} GROUP BY lang UNION ALL SELECT sum(w), any_value(goal_topic) FROM rec WHERE k = {rounds} GROUP BY topic))
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 5) AS weight, round(p, 5) AS probability, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296::DOUBLE < p AS kept, round(coalesce((SELECT off FROM off), 0), 5) AS marginal_error FROM docs JOIN p USING (source, lang, topic)"""


ORACLES = {"op1_substrings": repeats(), "op4_neardup": near_duplicates(), "op7_secrets": secrets(), "op8_decontaminate": contamination(), "op9_mixing": mixture()}
