"""MinHash near-dedup with tensored banding.

A document's set is its distinct 5-word shingles. COLLECTIONS small collections of WIDTH min-hashes are computed; every
pair of collections forms the key of one table, so COLLECTIONS * WIDTH min-hash functions feed
COLLECTIONS * (COLLECTIONS - 1) / 2 tables of keys of 2 * WIDTH min-hashes: about the square root of the work of
independent tables. A pair of similarity s meets in some table unless fewer than two collections agree, with the chance
(1-q)^m + m q (1-q)^(m-1), q = s^WIDTH, m = COLLECTIONS: 1.8e-4 at s = 0.75, 2e-5 at 0.8.

Candidates are confirmed on full sets. Texts of the same words are one node. Within a table's group no pairs are listed
at first: each node is held against the group's lowest node, and groups whose nodes are by then in one component are done.
Nodes of groups that still hold several components are then joined exactly: their shingles are ordered from rare to
frequent, and two sets of sizes x and y that share at least 3/7 (x + y) shingles have their first common one among the
first x - 3/7 (x + y) + 1 of the one and y - 3/7 (x + y) + 1 of the other. Only such pairs of different components are
confirmed, so no link between different texts is lost, and groups that share a frequent passage make few pairs.
Components are found by alternating large and small stars.

Defined results: null and empty texts and texts without words have no set and no link; fewer than 5 words are one shingle;
very long texts count whole; doc_id is a key (repeated rows are one node, and texts that share a lowest id are one too); rows without doc_id have no component
and are not kept; an empty table gives an empty result; columns beside id and text are carried only by keep_first().
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, own_cache, scratch, text_bytes

SIZE, THRESHOLD = 5, 75
COLLECTIONS, WIDTH = 14, 2
LEADER_ROUNDS = 2
#: The order of shingles is by their number in every SAMPLEth undecided set, known for at most HOT_SHINGLES shingles;
#: it decides how many pairs are confirmed, never which links are found.
SAMPLE, HOT_SHINGLES = 4, 1 << 20
#: A side of ids of at most so many rows (16 bytes each) is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
_M64 = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 63, COLLECTIONS * WIDTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, COLLECTIONS * WIDTH, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words that a process keeps.
_KEPT = 150_000
_hashes: dict[bytes, int] = own_cache("neardup")


def _hash_of(word: bytes) -> int:
    if len(_hashes) > _KEPT:
        _hashes.clear()
    h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a word list."""
    if not words:
        return np.zeros(0, np.uint64)
    get = _hashes.get
    w = np.fromiter(((h if (h := get(x)) is not None else _hash_of(x)) for x in words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(size, len(w))):
        h = _mix(h * _STEP + w[k : k + n])
    return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """One value for each collection, of its WIDTH min-hashes."""
    out = np.empty(COLLECTIONS, np.uint64)
    for c in range(COLLECTIONS):
        v = np.uint64(c)
        for k in range(c * WIDTH, (c + 1) * WIDTH):
            v = v * _STEP + np.min((s * _A[k] + _B[k]) >> np.uint64(16))
        out[c] = v
    return _mix(out)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, words_key (digest of the word sequence, null without words) and sketch of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("words_key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        np.seterr(over="ignore")
        own_cache("neardup")
        for b in batches:
            n, keys, sk = [], [], []
            for data in text_bytes(b.column(1)):
                words = data.lower().split()
                s = shingles(words)
                n.append(len(s))
                keys.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                sk.append(sketch(s).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sk, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and hashes (sorted, 8 bytes each) of the documents whose words_key is that of a node of ids(node, words_key)."""
    small = ids.select("node").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    picked = docs.select(F.col("doc_id").alias("node"), "text").join(F.broadcast(ids) if small else ids, "node")

    def run(batches):
        np.seterr(over="ignore")
        own_cache("neardup")
        for b in batches:
            nodes, sets = [], []
            for node, data, key in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                words = data.lower().split()
                if hashlib.md5(b" ".join(words)).digest() == key:  # of rows with the same id, the one that is meant
                    nodes.append(node)
                    sets.append(shingles(words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, b.column(0).type), pa.array(sets, pa.binary())], names=["node", "hashes"])

    found = picked.select("node", "text", "words_key").mapInArrow(run, T.StructType([T.StructField("node", docs.schema["doc_id"].dataType), T.StructField("hashes", T.BinaryType())]))
    return found.dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """pairs(a, b) with linked: whether 100 * intersection >= threshold * union of their full sets."""
    kind = pairs.schema["a"].dataType
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")

    def run(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    linked.append(False)
                    continue
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                linked.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("linked", T.BooleanType())]))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (lowest node reachable) for the nodes of edges(a, b); large and small stars in turn until nothing changes."""
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "components")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = cut(small.where("u > v").distinct(), "components")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            return links.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
        state = now


def _labelled(busy: DataFrame, labels: DataFrame | None) -> DataFrame:
    """busy(key, node) with the component of each node, of the keys that hold several components."""
    rows = busy.withColumn("comp", F.col("node")) if labels is None else busy.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    leads = rows.groupBy("key").agg(F.min("comp").alias("lead"), F.max("comp").alias("last")).where("lead < last").drop("last")
    return rows.join(leads, "key")


def undecided_pairs(undecided: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a < b, of undecided(node, comp) in different components that share a shingle early in both orders."""
    spark = undecided.sparkSession

    def tokens(batches):
        for b in batches:
            held = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], names=["token"])

    some = sets.join(undecided.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node"), "node", "left_semi").select("hashes")
    hot = some.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).toArrow()
    at = np.argsort(hot["token"].to_numpy())
    shared = spark.sparkContext.broadcast((hot["token"].to_numpy()[at], hot["n"].to_numpy()[at].astype(np.int32)))
    kind = undecided.schema["node"].dataType
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", kind), T.StructField("comp", kind), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def early(batches):
        known, count = shared.value
        for b in batches:
            cols = [[], [], [], []]
            owner = []
            for k, data in enumerate(b.column(2).to_pylist()):
                h = np.frombuffer(data, np.int64)
                freq = np.zeros(len(h), np.int32)
                if len(known):
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    freq = np.where(known[i] == h, count[i], 0)
                n = len(h)
                take = n - -(-threshold * n // 100) + 1
                first = h[np.lexsort((h, freq))[:take]]
                cols[0].append(first)
                owner.append(np.full(len(first), k))
                cols[2].append(np.full(len(first), n, np.int32))
                cols[3].append(np.arange(1, len(first) + 1, dtype=np.int32))
            if owner:
                who = pa.array(np.concatenate(owner))
                arrays = [pa.array(np.concatenate(cols[0])), b.column(0).take(who), b.column(1).take(who), pa.array(np.concatenate(cols[2])), pa.array(np.concatenate(cols[3]))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    prefixes = undecided.join(sets, "node").select("node", "comp", "hashes").mapInArrow(early, schema)
    x = prefixes.select("token", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    y = prefixes.select("token", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    need = f"ceil({threshold} * (na + nb) / {100 + threshold}D)"
    close = f"a < b and ca <> cb and 100 * least(na, nb) >= {threshold} * greatest(na, nb) and pa <= na - {need} + 1 and pb <= nb - {need} + 1"
    return x.join(y, "token").where(close).select("a", "b").distinct()


def near_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    with scratch(docs.sparkSession) as keep:
        return _near_components(docs, threshold, keep)


def _near_components(docs: DataFrame, threshold: int, keep) -> DataFrame:
    bound_batches(docs.sparkSession)
    sig = keep(cut(signatures(docs), "neardup-signatures"))
    with_id = sig.where("doc_id is not null and words_key is not null")
    nodes = keep(cut(with_id.groupBy("words_key").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")), "neardup-nodes"))
    # two texts may share the lowest id where ids repeat: such nodes are one
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("sketch")[i], F.col("sketch")[j]) for k, (i, j) in enumerate(combinations(range(COLLECTIONS), 2))]))
    met = nodes.select(keys.alias("key"), "node").repartition("key")
    shared = met.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    busy = cut(met.join(shared, "key", "left_semi"), "neardup-tables")
    involved = cut(busy.select("node").distinct(), "neardup-involved")
    ids = cut(nodes.select("node", "words_key").dropDuplicates(["node"]).join(involved, "node", "left_semi"), "neardup-ids")
    sets = cut(shingle_sets(docs, ids), "neardup-sets")
    labels = checked = links = None
    for turn in range(LEADER_ROUNDS + 1):
        rows = _labelled(busy, labels)
        if turn < LEADER_ROUNDS:
            # one pair a node: with the lowest leader of its groups that it was not held against
            pairs = rows.where("comp <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
            if checked is not None:
                pairs = pairs.join(checked, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        else:
            pairs = undecided_pairs(cut(rows.select("node", "comp").distinct(), "neardup-undecided"), sets, threshold)
            if checked is not None:
                pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = cut(confirm(pairs, sets, threshold), "neardup-pairs")
        checked = found.select("a", "b") if checked is None else checked.unionByName(found.select("a", "b"))
        new = found.where("linked").select("a", "b")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = keep(cut(components(links), "neardup-labels"))
    placed = nodes.select("words_key", "node") if labels is None else nodes.select("words_key", "node").join(labels, "node", "left")
    comp = F.col("node") if labels is None else F.coalesce("comp", "node")
    placed = placed.select("words_key", comp.alias("component"))
    out = sig.drop("sketch").join(placed, "words_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one document of each component, all columns as they are. The ids that go are few beside the rest; they
    are broadcast up to BROADCAST_ROWS rows and else joined by a shuffle."""
    with scratch(docs.sparkSession) as keep:
        gone = keep(cut(near_components(docs, threshold).where("not kept and doc_id is not null").select("doc_id").distinct(), "neardup-gone"))
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
