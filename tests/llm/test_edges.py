"""Each operator on nulls, empty and long texts, repeated rows, empty tables and extra columns, against brute force."""

import hashlib
import math
import pickle
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.llm import common, decontaminate, html, lm, media, mixing, neardup, quality, secrets, substrings, tokens

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("spans", T.StringType())])


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "Tion", "ande", "rethe", "inga", "ous", "é", "x1", "quel"]) + str(rng.randint(0, 40)) for _ in range(n))


def fixture():
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.split()
    near[50] = "changed"
    texts = [base, base, " ".join(near), None, "", "   ", "one two", "One  TWO\n", words(rng, 30), words(rng, 5000), "x" * 300, "aé" * 400, words(rng, 60) + base[:400], "password: token: abcdefgh AKIA" + "B" * 18 + " " + "0f" * 14, base.upper(), "<|endoftext|> ½ 漢字 \x1c ok", "solo"]
    texts += [words(rng, 40) for _ in range(25)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if i % 5 == 0 else 7, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[8]]  # a repeated row


ROWS = fixture()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def brute_removals(data, length=200):
    """n_bytes, n_removed, n_spans and the hash of what is left, by a table of all windows."""
    seen = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    for t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def removed(df):
    return {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(substrings.dedup(df)).items()}


def test_substrings(spark, docs, none):
    want = dict(zip((i for i, *_ in ROWS), brute_removals([(t or "").encode() for _, t, *_ in ROWS])))
    assert removed(docs) == want and any(n > 1 for _, _, n, _ in want.values())
    assert substrings.dedup(none).count() == 0


def test_large_seeds_are_taken_apart_by_longer_grams(spark, monkeypatch):
    """A common passage in different surroundings, a run of one byte, copies: at every size of the groups, dealt out or not."""
    rng = random.Random(1)
    common_ = words(rng, 60)[:230]
    texts = [words(rng, 40) + common_ + words(rng, 40) for _ in range(30)] + [words(rng, 100)] + [words(rng, 30) + "=" * rng.randint(190, 500) + words(rng, 30) for _ in range(8)] + [words(rng, 90)] * 6
    df = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    want = dict(enumerate(brute_removals([t.encode() for t in texts])))
    assert want[30][1:3] == (0, 0) and all(want[i][1] >= 230 for i in range(30))
    for most in (100, 3000, 8 << 20):
        monkeypatch.setattr(substrings, "GROUP_BYTES", most)
        monkeypatch.setattr(common, "HOT_ROWS", 2 if most == 3000 else 1000)
        assert removed(df) == want


def test_segments_of_equal_windows_have_equal_seeds():
    np.seterr(over="ignore")
    rng = random.Random(2)
    t = bytes(rng.choice(b"abc") for _ in range(700))
    for gram in substrings.GRAMS:
        seeds = lambda data: [(s, data[i:j]) for s, i, j in zip(*(x.tolist() for x in substrings.segments(data, 200, gram)))]
        whole = seeds(t)
        windows = {}
        for s, piece in whole:
            for k in range(len(piece) - 199):
                windows[piece[k : k + 200]] = s
        assert set(windows) == {t[k : k + 200] for k in range(501)}
        assert all(seeds(w) == [(s, w)] for w, s in list(windows.items())[::7])


def test_run_length_index():
    np.seterr(over="ignore")
    rng, lost = random.Random(3), []
    for turn in range(30):
        depth = rng.choice([1, 7, 9, 20, 40])
        texts = list(dict.fromkeys(bytes(rng.choice(b"ab" if turn % 2 else b"\0a\xff") for _ in range(rng.randint(depth, depth * 4 + 9))) for _ in range(8)))
        if turn % 3 == 0:  # a repetitive collection: few runs
            texts = list(dict.fromkeys([b"abcabd" * k for k in range(7, 15)] + [t[:30] for t in texts]))
        weights = [rng.choice([1, 2]) for _ in texts]
        count = Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - depth + 1):
                count[t[i : i + depth]] += w
        for t, ranges in zip(texts, substrings.repeats_in(texts, weights, depth)):
            found = {k for a, b in ranges for k in range(a, b)}
            assert found == {i for i in range(len(t) - depth + 1) if count[t[i : i + depth]] > 1}
        # the index holds runs only, and its samples are the places that sorted suffixes have there
        index = substrings.RunLengthIndex.build(texts, depth)
        flat = [(t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t) + 1)]
        start = np.cumsum([0] + [len(t) + 1 for t in texts])
        rows = sorted(flat, key=lambda x: ([b + 1 for b in x[0]] + [0], x[1]))
        before = [texts[k][i - 1] + 1 if i else 0 for _, k, i in rows]
        heads = [r for r in range(len(rows)) if r == 0 or before[r] != before[r - 1]]
        assert list(index.heads) == heads and list(index.chars) == [before[r] for r in heads]
        place = [int(start[k]) + i for _, k, i in rows]
        assert list(index.at_head) == [place[r] for r in heads] and list(index.at_last) == [place[r - 1] for r in heads[1:]] + [place[-1]]
        assert max(len(v) for k, v in vars(index).items() if k in ("heads", "chars", "before", "at_head", "at_last", "above", "below")) == len(heads)
        # the samples decide: with wrong ones matches are lost
        right = sum(int(f.sum()) for f in index.repeated(np.arange(len(texts))))
        index.at_head[:] = index.at_last[:] = index.ends[0]
        lost.append(right - sum(int(f.sum()) for f in index.repeated(np.arange(len(texts)))))
    assert min(lost) >= 0 and sum(n > 0 for n in lost) > 15


def test_index_sorts_only_suffixes_that_are_alike(monkeypatch):
    """Rounds of prefix doubling leave alone what earlier ones have told apart; the rows are those of sorted suffixes."""
    rng, sorted_, argsort = random.Random(5), [], np.argsort
    texts = [rng.randbytes(300) for _ in range(40)] + [b"x" * 300]
    monkeypatch.setattr(substrings.np, "argsort", lambda a, **k: sorted_.append(len(a)) or argsort(a, **k))
    index = substrings.RunLengthIndex.build(texts)
    rows = index.rows
    assert sorted_[0] == rows and sum(n for n in sorted_[1:] if n != len(index.heads)) < rows / 4
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    suffixes = sorted(((([b + 1 for b in t[i:]] + [0]), k, int(start[k]) + i) for k, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: x[:2])
    assert [suffixes[r][2] for r in index.heads] == list(index.at_head) and [suffixes[r][2] for r in index.lasts] == list(index.at_last)


def test_language_model(spark, docs, none):
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(x for i, t, *_ in ROWS if not held(i) for x in tok(t))
    n, v = sum(count.values()), len(count)
    got = by_id(lm.score(docs))
    for i, t, *_ in ROWS:
        w, r = tok(t), got[i]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.bits_per_byte == (pytest.approx(-r.score / math.log10(2) / len((t or '').encode())) if t else None)
    assert lm.score(none).count() == 0


def test_model_is_a_distribution():
    """Codes part the line of probability: chances of all symbols sum to 1."""
    code = lm.Code.huffman([5, 1, 1, 9, 3, 2])
    p = np.array([1 - code.one, code.one])
    assert sum(np.prod([p[b, n] for n, b in zip(code.node[k, : code.length[k]], code.bit[k, : code.length[k]])]) for k in range(6)) == pytest.approx(1.0)
    # the places of a node's symbols lie side by side
    for n in range(5):
        places = sorted(code.rank[k] for k in range(6) if n in code.node[k, : code.length[k]])
        assert places == list(range(places[0], places[-1] + 1))


def test_html(spark):
    pages = [
        (0, "u", "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy this, now.</div><article><h1>Head &amp; tail</h1><p>One  two, <b>three</b>four.<br>Five<p>Six.</article><div id=comments><p>I agree, yes.</div><footer>&copy; x</footer>"),
        (1, "u", None), (2, None, ""), (3, "u", "plain text, only"), (4, "u", "<body><header>H</header><div><p>" + "A long text, it is. " * 20 + "</p><p>Short.</p></div><aside>side</aside><form>f</form></body>"), (5, "u", "<p>a &lt; b &#233; &am"),
        (6, "u", "<article><p>" + "word, " * 40_000 + "</p></article>"), (7, "u", "<div <<<< \"'"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[0].text == "Head & tail One two, threefour. Five Six."
    assert got[1].text == got[2].text == "" and got[3].text == "plain text, only"
    assert got[4].text == ("A long text, it is. " * 20).strip() + " Short." and got[5].text == "a < b é &am"
    assert got[6].n_chars == len(got[6].text) == 40_000 * 6 - 1
    assert html.extract(df.limit(0)).count() == 0


ARTICLE = "<h1>Head of it</h1>" + "<p>" + "A long sentence, with some marks. " * 8 + "</p>"


@pytest.mark.parametrize("names", ["content has-sidebar", "post related-posts-enabled", "entry tags", "page-share", "left-rail main", "site no-ads", "comments-off", "sidebar"])
def test_html_names_are_only_a_prior(names):
    """A name around the whole article takes nothing away; the same name beside it does."""
    want = " ".join(re.sub("<[^>]+>", " ", ARTICLE * 4).split())
    assert html.main_text(f"<body><nav>Home</nav><div class='{names}'>{ARTICLE * 4}</div><footer>x</footer></body>") == want
    assert html.main_text(f"<body><form id=f><div class='{names}'>{ARTICLE * 4}<div class=ad>Buy this, now.</div></div></form></body>") == want
    assert html.main_text(f"<body><div>{ARTICLE * 4}</div><div class='{names}'><p>Other things, here.</p></div></body>") == want


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "deep text, here.", "<p>x" + "<div><li>y" * 30_000, "<td><p>" + "<td><div>z" * 30_000, "<a><b>" * 50_000 + "w", "<table><tr><td>" * 20_000 + "q"])
def test_html_deep_pages(page):
    t = time.time()
    assert html.main_text(page).replace(" ", "") == re.sub("<[^>]+>| ", "", page)
    assert time.time() - t < 20


def test_html_ratios_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 40):
        of = np.unique(rng.integers(0, max(1, n // 2), n), return_inverse=True)[1]
        size, marks, prior = rng.integers(1, 90, n).astype(float), rng.integers(0, 9, n).astype(float), rng.choice([1.0, 0.02], n)
        mean = lambda x, k: sum(v for v, p in zip(x, of) if p == k) / sum(p == k for p in of)
        fused = []
        for i in range(n):
            near = [j for j in range(n) if abs(i - j) <= html.REACH]
            w = [math.exp(-0.5 * ((i - j) / html.SIGMA) ** 2) * prior[j] for j in near]
            length, punct = (sum(a * mean(x, of[j]) for a, j in zip(w, near)) / sum(w) for x in (size, marks))
            fused.append(math.sqrt(length * (1 + punct)))
        got, score = html.path_scores(of, size, marks, prior, of.max() + 1)
        assert got == pytest.approx(fused)
        assert score == pytest.approx([mean([f * p for f, p in zip(fused, prior)], k) for k in range(of.max() + 1)])


def test_html_chooses_by_ratios():
    """No element or name tells: short links go, the text stays, and ties fare alike."""
    links = "".join(f"<section><div><span>{w}</span></div></section>" for w in ["Home", "News", "About", "Help", "More", "Jobs", "Maps"] * 6)
    body = "".join("<div><p>" + "A sentence of the text, with marks, and more. " * 6 + "</p></div>" for _ in range(5))
    got = html.main_text(f"<body>{links}{body}{links}</body>")
    assert "Home" not in got and "Maps" not in got and got.count("A sentence") == 30
    same = html.main_text("<body>" + "<div><p>Equal text, here.</p></div>" * 2 + "<section><p>Equal text, here.</p></section></body>")
    assert same == " ".join(["Equal text, here."] * 3)


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] < comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[b] = comp[a]
                    changed = True
    return sets, comp


def test_neardup(spark, docs, none):
    sets, comp = brute_components(ROWS)
    got = by_id(neardup.near_components(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert neardup.near_components(none).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in comp if comp[i] == i}


def test_neardup_chains_and_outliers(spark):
    """Variants of one text at all distances: links between any two of them count."""
    rng = random.Random(9)
    base = words(rng, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(150), i // 4):
            w[k] = f"new{rng.randint(0, 3)}"
        rows.append((i * 7 % 61, " ".join(w), None, None, None, None, None))
    _, comp = brute_components(rows)
    got = by_id(neardup.near_components(spark.createDataFrame(rows, DOCS)))
    assert {i: r.component_id for i, r in got.items()} == comp


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (2, 7), (12, 11), (11, 10), (10, 9)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 7: 2, 9: 8, 8: 8, 12: 8, 11: 8, 10: 8} or {k: v for k, v in got.items() if k != v} == {5: 2, 4: 2, 3: 2, 7: 2, 9: 8, 12: 8, 11: 8, 10: 8}


def test_tokens(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokens.Encoder(path).library
    folder, manifest = tokens.write(docs, path, length=64, partitions=3)
    got = tokens.read_back(spark, folder, manifest, docs.schema["doc_id"]).orderBy("start").collect()
    start, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    # random access to rows, and the mask of the filled end
    for m in manifest.collect():
        reader = tokens.ShardReader(folder, m["name"])
        held = [reader.sequence(k) for k in range(m.n_rows)]
        assert all(len(i) == 64 for i, _ in held) and sum(int(mask.sum()) for _, mask in held) == m.n_tokens
        assert [x for i, mask in held for x in i[mask].tolist()] == [x for _, _, ids in reader.documents() for x in ids.tolist()]
    folder, manifest = tokens.write(none, path)
    assert tokens.read_back(spark, folder, manifest, none.schema["doc_id"]).count() == 0


def naive_chunks(p):
    """Chunks byte by byte: a cut where the gear hash has its mask bits zero, LEAST bytes after the last one at least."""
    h, at, out = 0, 0, []
    for k, b in enumerate(p):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        n = k + 1 - at
        if n >= media.LEAST and (h & int(media._MASK)) == 0 and k + 1 < len(p) or n == media.MOST and k + 1 < len(p):
            out.append(p[at : k + 1])
            at = k + 1
    return [*out, p[at:]]


def test_media(spark, docs, none):
    got = by_id(media.stored_and_read(docs))
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        p = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        pieces = naive_chunks(p)
        form = b"".join(len(c).to_bytes(4, "little") + c for c in pieces)
        assert (r.n_chunks, r.media_bytes, r.media_sha256) == (len(pieces), len(form), hashlib.sha256(form).hexdigest())
        mean = sum(p) / len(p)
        want = {"mean": mean, "std": (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5, "step": sum(abs(x - y) for x, y in zip(p, p[1:])) / (len(p) - 1), "fill": p.count(255) / len(p)}
        assert {k: float(v) for k, v in (x.split("=") for x in r.feature.split(";"))} == pytest.approx(want, abs=1e-4)
    assert tuple(got[0])[1:] == tuple(got[1])[1:]
    assert media.stored_and_read(none).count() == 0


def test_media_stores_each_chunk_once(spark, docs, monkeypatch):
    """Every task writes its own copies; after compact() the packs hold each chunk once, and hot chunks are dealt out."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    first, stored = media.store(docs.unionByName(docs).repartition(4))
    packs, table = media.compact(first, media.chunk_table(stored), drop=True)
    assert not [*Path(first.removeprefix("file://")).rglob("*.pack")]
    rows = table.collect()
    want = Counter(c for _, t, *_ in ROWS for c in naive_chunks(media.payload_of((t or "").encode())))
    assert {bytes(r.digest): r.n for r in rows} == {hashlib.sha256(c).digest(): 2 * n for c, n in want.items()}
    reader, held = media.PackReader(packs), 0
    for r in rows:
        record = reader.record(r.place.asDict(), r.length)
        assert hashlib.sha256(record[4:]).digest() == bytes(r.digest)
        held += len(record)
    files = [f for f in Path(packs.removeprefix("file://")).rglob("*.pack") if not f.name.startswith(".")]
    assert sum(len(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read()) for f in files) == held
    assert media.rebuild(packs, media.recipes(stored, table)).count() == 2 * len(ROWS)
    # a damaged record is an error
    for f in files:
        f.write_bytes(f.read_bytes()[:-9])
    with pytest.raises(Exception):
        media.rebuild(packs, media.recipes(stored, table)).collect()


def test_media_cuts_follow_content():
    rng = random.Random(2)
    data = rng.randbytes(40_000)
    pieces = lambda b: [b[i:j] for i, j in zip([0, *media.cuts(b)], media.cuts(b))]
    a, b = pieces(data), pieces(b"inserted" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) > len(a) * 0.9
    assert all(media.LEAST <= len(p) <= media.MOST for p in a[:-1])


def test_secrets(spark, docs, none):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    extra = [(100, t, None, None, None, None, None) for t in ("Api_Key='ab12cd34' x", "token=abc secret=abcdefg", "é passwd : \"qwertyui\"", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "APIKEY=zzzzzz")]
    rows = ROWS + [(100 + k, *r[1:]) for k, r in enumerate(extra)]
    got = by_id(secrets.scan(spark.createDataFrame(rows, DOCS)))
    for i, t, *_ in rows:
        t = t or ""
        want = [(m.start(), m.end(), "assign") for m in a.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(tuple(s) for s in got[i].spans if s.kind in ("assign", "access", "hex")) == sorted(want), i
    assert [s.kind for s in got[103].spans] == ["private_key"] and "github" in {s.kind for s in got[104].spans}
    assert secrets.scan(none).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("api_?key") == [["api", "key"]]
    assert secrets.trigram_query("password|token") == [["ken", "tok"], ["ord", "pas"]]
    assert secrets.trigram_query("ab|abcd") is None


def test_postings_are_intersected(spark, monkeypatch):
    """Posting lists by blocks, many or one, give the documents that hold all trigrams of an alternative."""
    texts = ["pas ord", "pas", "PASSWORD", "tok", "tok ken", "AKI", "akia", None, "", "key api", "ghp_ x", "-----begin y PRIVATE KEY-----"]
    rows = [(k, t, None, None, None, None, None) for k, t in enumerate(texts * 3)] + [(None, "akia", None, None, None, None, None), (2, "PASSWORD", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    held = lambda t, alt: t is not None and all(g in t.lower() for g in alt)
    want = {}
    for k, t, *_ in rows:
        for r in secrets.RULES:
            if k is not None and any(held(t, alt) for alt in secrets.trigram_query(r.pattern) or []):
                want.setdefault(k, set()).add(r.name)
    for most in (1, 7, 1 << 16):
        monkeypatch.setattr(secrets, "BLOCK_POSTINGS", most)
        index = secrets.build_index(docs)
        assert {r.doc_id: set(r.rules) for r in secrets.candidates(index).collect()} == want
        assert most > 7 or index.select("block").distinct().count() > 1


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, ROWS[0][1][30:200]), (2, "ONE, two!"), (3, None), (4, ""), (11, "solo"), (None, "x1")], "item_id long, text string")
    items = [(i, t) for i, t in ((r.item_id, r.text) for r in bench.collect()) if i is not None]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        for x in [tuple(w[k : k + 10]) for k in range(len(w) - 9)] if len(w) >= 10 else [tuple(w)] if w else []:
            windows.setdefault(x, set()).add(str(i))
    for block in (decontaminate.BLOCK_WINDOWS, 7, 1):
        got = by_id(decontaminate.report(docs, bench, block_windows=block))
        for i, t, *_ in ROWS:
            w, hit, met = fold(t), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) in windows:
                        hit |= set(range(k, k + size))
                        met |= windows[tuple(w[k : k + size])]
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(met)), (i, block)
            if hit:
                assert [x for s in got[i].spans for x in fold(t[s.start : s.end])] == [w[k] for k in sorted(hit)]
    assert decontaminate.report(none, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if r.n_hit == 0}


def test_mixing(spark, docs, none):
    raked, off = mixing.rake(spark.createDataFrame([("a", "x", "p", 60), ("a", "y", "q", 20), ("b", "x", "q", 15), ("b", "y", "p", 5), ("c", "y", "p", 0)], "source string, lang string, topic string, tokens long"), {"source": {"a": 1.0, "b": 1.0}})
    raked = raked.collect()
    share = Counter()
    for r in raked:
        share[r.source] += r.tokens * r.weight / 100
    assert share["a"] == pytest.approx(0.5, abs=1e-6) and share["b"] == pytest.approx(0.5, abs=1e-6) and off < 1e-9
    # a language that only one source has can't have another share: raking ends and says by how much it failed
    two = spark.createDataFrame([("a", "x", "p", 60), ("b", "y", "p", 40)], "source string, lang string, topic string, tokens long")
    _, off = mixing.rake(two, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}})
    assert off == pytest.approx(0.4, abs=1e-6)
    clash = docs.selectExpr("*", "1 as _source", "2 as _weight", "3 as _p", "4 as __mix_tokens", "5 as __MIX_p", "6 as weight")
    kept = mixing.keep_sample(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in mixing.keep_sample(docs).collect()}
    assert {tuple(r[7:]) for r in kept.collect()} == {(1, 2, 3, 4, 5, 6)}
    got = mixing.sample(docs).collect()
    assert {r.marginal_error for r in got} != {None}
    assert len(got) == len(ROWS) and all(0 <= r.probability <= 1 and r.weight >= 0 for r in got)
    assert all((r.n_tokens or 0) == len((dict((x[0], x[1]) for x in ROWS)[r.doc_id] or "").encode().split()) for r in got)
    assert mixing.sample(none).count() == 0 and mixing.keep_sample(docs).columns == docs.columns


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(30)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert 0 < model.rows <= 31
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0


def test_linear_time_identity():
    """The sum over pairs is half the square of the sum less the sum of squares."""
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.1, rng.normal(size=quality.DIM).astype(np.float32), rng.normal(size=(quality.DIM, 3)).astype(np.float32))
    idx, val = np.array([3, 70, 900]), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(3) for b in range(a))
    assert m.raw(idx, val, np.array([0]))[0] == pytest.approx(0.1 + float(m.w[idx] @ val) + pairs, rel=1e-4)


def test_quality_against_double_sums(spark, docs, none):
    """Scores by all pairs of features, the threshold, which counts as good, clashing names and repeated ids."""
    rng = np.random.default_rng(2)
    model = quality.FactorisationMachine(0.3, rng.normal(0, 0.3, quality.DIM).astype(np.float32), rng.normal(0, 0.3, (quality.DIM, 3)).astype(np.float32))

    def brute(t):
        idx, val = quality.features((t or "").encode(), None)
        z = model.w0 + sum(float(model.w[i] * x) for i, x in zip(idx, val))
        z += sum(float(model.v[i] @ model.v[j]) * float(x) * float(y) for k, (i, x) in enumerate(zip(idx, val)) for j, y in zip(idx[k + 1 :], val[k + 1 :]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    short = docs.where("n_chars is null and length(coalesce(text, '')) < 600")
    rows = short.collect()
    want = {r.doc_id: brute(r.text) for r in rows}
    got = by_id(quality.score(short, model))
    assert len(got) == len(want) > 3 and all(got[i].score == pytest.approx(w, abs=1e-5) for i, w in want.items())
    edge = got[rows[0].doc_id].score
    at = by_id(quality.score(short, model, edge))
    assert all(r.predicted == (r.score >= edge) for r in at.values()) and at[rows[0].doc_id].predicted == 1
    clash = docs.selectExpr("*", "1 as __length", "2 as __LENGTH_", "'x' as label")
    kept = quality.keep_good(clash, model, edge)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, r in by_id(quality.score(docs, model, edge)).items() if r.predicted}
    assert quality.keep_good(none, model).count() == 0
    many = docs.unionByName(docs).unionByName(docs)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality").distinct()
    one, three = quality.train(docs, labels), quality.train(many, labels)
    assert one.rows == three.rows == labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").count() and (one.w == three.w).all()


def test_quality_on_held_out_labels(spark):
    """Labels that were not learned from, by a few hundred labels: all good ones before all bad ones, nearly."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert len(good) > 50 and len(bad) > 10
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_learns(spark):
    rng = random.Random(0)
    rows = [(i, words(rng, 80) if i % 2 else " | ".join(words(rng, 1) + "!!" for _ in range(60)), None, None, None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = quality.score(df, quality.train(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))).where("held_out").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 0.97 * len(got)


def test_language_model_counts_every_context():
    """More contexts than any table of a fixed size, each counted by itself, down to the last bit of a code."""
    code = lm.Code.huffman([2**k for k in range(9)])
    assert code.length.max() == 8
    code.lay_out()
    rng = np.random.default_rng(0)
    context = np.repeat(np.arange(200_000), 2)
    symbol, taught = rng.integers(0, 9, 400_000), rng.integers(0, 3, 400_000).astype(np.int32)
    length = code.length[symbol]
    counts = np.repeat(taught.astype(np.int64), length)
    counts += (counts * np.concatenate([code.bit[s, :n] for s, n in zip(symbol, length)])) << lm.ALL
    lm.path_counts(code, context, symbol, taught, counts, np.cumsum(length) - length)
    ones, seen = counts >> lm.ALL, counts & ((1 << lm.ALL) - 1)
    want = Counter()
    bits = [(c, code.node[s, d], code.bit[s, d], t) for c, s, t in zip(context[:20_000].tolist(), symbol, taught.tolist()) for d in range(code.length[s])]
    for c, n, b, t in bits:
        want[c, n] += t
        want[c, n, "one"] += t * b
    assert [*seen[: len(bits)]] == [want[c, n] for c, n, *_ in bits] and [*ones[: len(bits)]] == [want[c, n, "one"] for c, n, *_ in bits]


def brute_token_costs(coder, before, second, third, kind, symbol, taught, weights, order):
    """Costs of tokens one bit at a time, all in one step of the mixer, so by the given weights."""
    code, seen = coder.tokens, Counter()
    keys = list(zip(zip(kind, before), zip(kind, before, second), zip(kind, before, third)))
    path = lambda s: [(code.node[s, d], code.bit[s, d]) for d in range(code.length[s])]
    for ks, s, t in zip(keys, symbol, taught):
        for j, k in enumerate(ks):
            for n, b in path(s):
                seen[j, k, n, b] += t
    level = lambda n: sum(n > x for x in (0, 1, 2, 8, 64))
    for ks, s, t in zip(keys, symbol, taught):
        cost = 0.0
        for n, b in path(s):
            p, x, levels = code.one[n], [], []
            for j, k in enumerate(ks):
                one, zero = seen[j, k, n, 1] - t * b, seen[j, k, n, 0] - t * (1 - b)
                got = (one + lm.BACKOFF[j] * p) / (one + zero + lm.BACKOFF[j])
                x.append(math.log(got / (1 - got)))
                levels.append(level(one + zero))
                p = got if j == 0 else p
            w = weights[levels[0] * 6 + levels[1]]
            one = 1 / (1 + math.exp(-sum(a * v for a, v in zip(w, [*x, lm.BIAS]))))
            cost -= math.log2(one if b else 1 - one)
        yield cost


def test_language_model_costs_against_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    coder = lm.Coder([b"w%d" % k for k in range(30)] + [b""], [*range(400, 370, -1), 90], 13_000, 60)
    symbol = rng.integers(0, 12, 500)
    symbol[[300, 301, 499]] = coder.end
    before, second, third = coder.contexts(symbol, np.array([0, 301, 302]))
    kind, taught = rng.integers(0, 2, 500), rng.integers(0, 2, 500)
    weights = rng.normal(0.4, 0.1, (36, 4)).astype(np.float32)
    monkeypatch.setattr(lm, "STEP_BITS", 1 << 30)
    got, new = lm.token_costs(coder, before, second, third, kind, symbol, taught, weights)
    assert got == pytest.approx([*brute_token_costs(coder, before, second, third, kind, symbol, taught, weights, None)], rel=1e-4)
    assert (new != weights).any()
    # in steps the weights go along; repeated tokens cost the same, and what isn't learned from changes nothing
    monkeypatch.setattr(lm, "STEP_BITS", 64)
    got, new = lm.token_costs(coder, before, second, third, kind, symbol, taught, weights)
    cost = {}
    assert all(cost.setdefault(k, c) == c for k, c in zip(zip(before, second, third, kind, symbol, taught), got))
    assert (lm.token_costs(coder, before, second, third, kind, symbol, taught * 0, weights)[1] == weights).all()
    # a bit's cost and the weights after it, bit by bit
    monkeypatch.setattr(lm, "STEP_BITS", 1)
    x, gate, bit = [rng.normal(0, 1, 50).astype(np.float32) for _ in range(3)], rng.integers(0, 36, 50), rng.integers(0, 2, 50)
    cost, end = lm.refined(x, gate, bit, weights)
    w = weights.astype(float)
    for k in range(50):
        v = np.array([*(a[k] for a in x), lm.BIAS])
        p = 1 / (1 + math.exp(-v @ w[gate[k]]))
        assert cost[k] == pytest.approx(-math.log2(p if bit[k] else 1 - p), rel=1e-3)
        w[gate[k]] += lm.RATE / (1 + lm.STEADY) * (bit[k] - p) * v
    assert end == pytest.approx(w, rel=1e-3)


def test_language_model_parts_that_travel():
    """Workers get the words only where they meet them, and lay out the codes only where they use them."""
    coder = lm.Coder([b"w%d" % k for k in range(30)] + [b""], [*range(400, 370, -1), 90], 13_000, 60)
    there, light = pickle.loads(pickle.dumps(coder)), pickle.loads(pickle.dumps(coder.without_words()))
    assert "tokens" not in vars(there) and "tokens" not in vars(light) and not light.index and there.index == coder.index
    for c in (there, light):
        assert (c.tokens.flat == coder.tokens.flat).all() and (c.tokens.rank == coder.tokens.rank).all() and c.tokens.node is None
    held = np.zeros(300_000, np.int32)
    held[[0, 65_535, 65_536, 299_999]] = [1, 2, 3, 4]
    assert [(r["slot"], r["n"]) for b in lm._slot_rows(held) for r in b.to_pylist()] == [(0, 1), (65_535, 2), (65_536, 3), (299_999, 4)]


def test_language_model_does_not_depend_on_parts(spark, monkeypatch):
    """Frequent tokens are dealt out by classes; blocks and partitions change no score, and copies are known."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(0, 300, 10)] + [(900, "the " * 3000), (901, "w1 unseen" + "x" * 50), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda d: {r.doc_id: r.score for r in lm.score(d).collect()}
    one = score(df.repartition(1))
    assert one == pytest.approx(score(df.repartition(5)), abs=1e-6)
    assert all(one[300 + k] == pytest.approx(one[k]) for k in range(0, 300, 10) if (zlib.crc32(str(k).encode()) % 10 == 0) == (zlib.crc32(str(300 + k).encode()) % 10 == 0))
    words_of = dict(rows)
    each = lambda ids: sum(one[k] for k in ids) / sum(len(words_of[k].split()) + 1 for k in ids)
    assert each([k for k in range(300) if k % 10 == 0]) > each([k for k in range(300) if k % 10]) + 0.5
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    assert all(math.isfinite(v) and v < 0 for v in score(df).values())


def test_language_model_counts_do_not_depend_on_how_tokens_are_dealt(monkeypatch):
    """By the same weights tokens of frequent contexts cost the same in many parts as in one."""
    rng = np.random.default_rng(3)
    symbol = np.minimum(rng.geometric(0.3, 6000) - 1, 11)
    symbol[2000:3500] = 1
    begin = np.array([0, 900, 1800, 4000])
    coder = lm.Coder([b"w%d" % k for k in range(12)], sorted(np.bincount(symbol, minlength=12).tolist(), reverse=True), 6000, 12)
    before, second, third = coder.contexts(symbol, begin)
    taught = (rng.integers(0, 9, 6000) > 0).astype(np.int64)
    monkeypatch.setattr(lm, "RATE", 0.0)

    def costs(part_tokens, parts):
        monkeypatch.setattr(lm, "PART_TOKENS", part_tokens)
        pairs, triples = (Counter(zip(*(x.tolist() for x in keys))) for keys in ((before, second), (before, second, third)))
        deal = lm.Dealing(np.bincount(before, minlength=coder.known + 2), pairs, triples, parts)
        dealt, given = np.empty(6000, np.int64), {}
        for block in range(6):
            at = slice(block * 1000, block * 1000 + 1000)
            dealt[at], marks = deal.deal(before[at], second[at], third[at], block)
            for part, rows in deal.counted(marks, symbol[at], taught[at]).items():
                given.setdefault(part, []).append(rows)
        sums = lm.summed_rows([lm.summed_rows(x) for x in given.values()])
        out = np.empty(6000)
        for part in np.unique(dealt):
            o = np.flatnonzero(dealt == part)
            brought = sums[:, [int(part) in deal.holders(c) for c in sums[0].tolist()]]
            out[o] = lm.part_costs(coder, deal, [x[o] for x in (before, second, third, symbol, taught)], brought)
        return out, deal, len(np.unique(dealt))

    one, deal, _ = costs(1 << 20, 1)
    assert not deal.any
    for part_tokens, parts in ((4000, 3), (600, 20), (100, 120)):
        many, deal, used = costs(part_tokens, parts)
        assert used > parts // 2 and deal.any and np.abs(many - one).max() <= 1
    assert len(deal.pairs) and len(deal.triples) and deal.triple_slots.max() > 3


def test_parts_that_are_encoded_in_one_text(monkeypatch):
    """Each part has the ids that the library gives it alone, and the library is called once for many."""
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    odd = [" ", "  ", " \n", "\n ", "\n", " '", " 's", "'s", "'", " _", " __", " 12", "12", " !?", " \x00", "\x1b", " é", "é", " ſ"[:2], " don", " " + "x" * 5000, " Ω", "\t"]
    parts = odd + sorted({" " + "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 14))) for _ in range(2000)})
    rng.shuffle(parts)
    alone = {w: np.array(encoder.library.encode(w, add_special_tokens=False).ids, encoder.dtype).tobytes() for w in parts}
    assert dict(encoder._each(parts)) == alone
    calls = []

    class Library:
        def encode(self, text, **more):
            calls.append(text)
            return library.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return library.encode_batch_fast(texts, **more)

    library, encoder.library = encoder.library, Library()
    # the library takes " 's" for two parts: those of its text are encoded alone
    assert dict(encoder._each(parts)) == alone and len(calls) < len(odd) + tokens._JOINED + 10
    calls.clear()
    parts.remove(" 's")
    assert dict(encoder._each(parts)).keys() == alone.keys() - {" 's"} and len(calls) < len(odd) + 10
    # a special token with a space could lie across parts
    encoder.special = ["<a b>"]
    calls.clear()
    assert {**alone, **dict(encoder._each(parts))} == alone and calls == parts


def test_language_model_counts_that_are_given_by_node():
    code = lm.Code.huffman([5, 1, 1, 9, 3, 2, 40])
    code.lay_out()
    given = lm.Given(code, np.array([[4, 9, 9, 9, 9, 12], [1, 0, 2, 3, 6, 5], [8, 7, 1, 20, 300, 6]]))
    for context, n in ((9, {0: 7, 2: 1, 3: 20, 6: 300}), (4, {1: 8}), (5, {})):
        want = Counter()
        for s, k in n.items():
            for node, bit in zip(code.node[s, : code.length[s]].tolist(), code.bit[s, : code.length[s]].tolist()):
                want[node] += k + (k * bit << lm.ALL)
        assert given.nodes(context).tolist() == [want[node] for node in range(6)]


def test_language_model_of_frequent_tokens_in_many_parts(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["a", "b", "a b", "c", "d e"]) for _ in range(n))
    rows = [(k, words(rng.randint(1, 60))) for k in range(300)] + [(900, "the " * 3000), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    read = lambda: {r.doc_id: r for r in lm.score(df).collect()}
    one = read()
    monkeypatch.setattr(lm, "PART_TOKENS", 2000)
    many = read()
    # weights are refined in each part, so costs differ a little; all else does not
    assert sum(r.score for r in many.values()) == pytest.approx(sum(r.score for r in one.values()), rel=0.1)
    assert [(k, *many[k][1:6]) for k in one] == [(k, *one[k][1:6]) for k in one] and len(many) == len(rows)


def test_mixing_is_not_thinned_by_a_stray_source(spark):
    text = " ".join(["word"] * 100)
    rows = [(i, text, "en", "ab"[i % 2]) for i in range(2000)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stray = spark.createDataFrame([*rows, (9999, "one two three", None, None)], plain.schema)
    kept = lambda docs: {r.doc_id for r in mixing.keep_sample(docs).collect()}
    assert kept(plain) == set(range(2000)) and len(kept(stray)) > 1990 and 9999 in kept(stray)
    # a cell that is not negligible sets the rate, so that targets hold
    even = mixing.sample(plain.where("source = 'a' or doc_id < 1000"), {"source": {"a": 1.0, "b": 1.0}}).groupBy("source").agg(F.max("probability").alias("p")).collect()
    assert {r.source: r.p for r in even} == {"a": 0.5, "b": 1.0}


def test_language_model_looks_for_each_word_once():
    """Words are parted as bytes.split() does, and only distinct ones are looked for in Python."""
    every = bytes(range(256))
    texts = [b"", b" ", None, b" A b\x0bB ", every, b"x" + every[::-1] * 2, b"\x00", "É ſ İ ß\x85".encode(), b"the end " * 50_000, b"a"]
    words, token, sizes = lm.tokens_of(pa.array(texts, pa.binary()))
    held = [*words.to_pylist(), lm.END]
    want = [[*(t or b"").lower().split(), lm.END] for t in texts]
    assert [held[k] for k in token] == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert len(set(held)) == len(held) and lm._bytes_of(words) == held[:-1] and lm._bytes_of(words[:0]) == []
    looked = []

    class Index(dict):
        def get(self, word, *other):
            looked.append(word)
            return super().get(word, *other)

    coder = lm.Coder([b"the", b"end", lm.END, b"b"], [50_000, 50_000, 10, 2], 100_020, 20)
    coder.index = Index(coder.index)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    blocks = list(lm._groups(batch, 0, coder.numbers, 300))
    assert [b[0] for b in blocks] == [0, 5, 6, 9] and [n for b in blocks for n in b[-1]] == [len(t or b"") for t in texts]
    assert [words[k] for _, words, _, token, *_ in blocks for k in token] == sum(want, []) and len(looked) == len(held)
    number = np.concatenate([numbers.take(token) for _, _, numbers, token, *_ in blocks])
    assert number.tolist() == [coder.index.get(w, -1) for w in sum(want, [])]
    known = {b"the": 0, b"end": 1, lm.END: coder.end}
    assert coder.symbols(number, sizes).tolist() == [known.get(w, coder.escape) for w in sum(want, [])]


def test_language_model_counts_words_and_samples(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["a", "B", "c\x0b", "é" * 3]) for _ in range(rng.randint(0, 40))) + " " * (k % 2)) for k in range(200)] + [(1000, None), (1001, "")]
    monkeypatch.setattr(lm, "SAMPLED", 7)
    monkeypatch.setattr(lm, "LOOKED_FOR", 500)
    got = {r.word: r.n for r in lm.word_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    want, place = Counter(), 0
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 10:
            words = [*(text or "").encode().lower().split(), lm.END]
            want.update(words)
            for at in range(len(words)):
                if place % 7 == 0:
                    want[b" ".join([lm.END] * (3 - at) + words[max(0, at - 3) : at])] += 1
                place += 1
    assert got == want
