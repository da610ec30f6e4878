"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)); the last form of the
pairwise term takes time linear in the number of features of a document.

Defined results: null and empty texts have only bias, metadata and structure features and get a score; very long texts
are read whole; ties at the threshold count as good; repeated rows get the same score each; an empty table gives an
empty result; without labelled rows of both classes every score is the share of label 1 (0.5 where there is none).
Columns beside the text and the id are neither read nor changed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, doc_bucket, own_cache, text_bytes

#: Bound of the fitting sample: so many labelled rows at most, those of the smallest hash.
MAX_TRAIN_ROWS = 8000
WORD_BITS = 16
BINS = 8
STATS = ("upper", "digit", "symbol", "pipe", "bang", "space", "non_ascii", "word_len", "repeat_word", "repeat_line", "top_word", "line_len", "symbol_run", "empty")
N_META = 24
OFFSET_STATS = 1 << WORD_BITS
OFFSET_META = OFFSET_STATS + len(STATS) * (BINS + 1)
DIM = OFFSET_META + N_META
THRESHOLD = 0.7

_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-" for b in range(256)])
#: Words that a process keeps.
_KEPT = 150_000
_buckets: dict[bytes, int] = own_cache("quality")


def _bucket_of(word: bytes) -> int:
    if len(_buckets) > _KEPT:
        _buckets.clear()
    b = _buckets[word] = xxhash.xxh32_intdigest(word) & (OFFSET_STATS - 1)
    return b


def features(data: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (distinct) and values of a text's UTF-8 bytes and its length column."""
    words = data.lower().split()
    if words:
        get = _buckets.get
        idx = np.fromiter(((b if (b := get(w)) is not None else _bucket_of(w)) for w in words), np.int64, len(words))
        idx, tf = np.unique(idx, return_counts=True)
        val = np.log1p(tf)
        val /= math.sqrt(float(val @ val))
        distinct, top = len(idx), int(tf.max())
    else:
        idx, val, distinct, top = np.zeros(0, np.int64), np.zeros(0), 0, 0
    n, nw = len(data), len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    part = lambda k: k / n if n else 0.0
    stats = (
        part(hist[_UPPER].sum()), part(hist[_DIGIT].sum()), part(hist[_SYMBOL].sum()) * 2, part(hist[124]) * 4, part(hist[33]) * 4, part(hist[_SPACE].sum()), part(hist[128:].sum()),
        min(1.0, n / max(1, nw) / 20), 1 - distinct / nw if nw else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, top / nw if nw else 0.0, min(1.0, n / max(1, len(lines)) / 2000),
        min(1.0, sum(map(data.count, (b"!!", b"***", b"###", b"$$$", b"%%%", b"&&&"))) / max(1, nw)), float(not nw),
    )
    at, values = [], []
    for k, x in enumerate(stats):
        x = min(1.0, float(x))
        base = OFFSET_STATS + k * (BINS + 1)
        at += [base, base + 1 + min(BINS - 1, int(math.sqrt(x) * BINS))]
        values += [x, 0.5]
    # metadata: a bin of the length column, the last bin where it is null
    at.append(OFFSET_META + (N_META - 1 if n_chars is None else min(N_META - 2, max(0, int(n_chars)).bit_length())))
    values.append(0.5)
    return np.concatenate([idx, at]).astype(np.int32), np.concatenate([val, values]).astype(np.float32)


@dataclass
class FactorisationMachine:
    w0: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 1), np.float32))
    rows: int = 0

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of documents whose features lie one after the other; starts: where each begins. None is empty."""
        x = val[:, None]
        vx = self.v[idx] * x
        s, q = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - q).sum(1)

    def predict(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, starts).astype(np.float64), -30, 30)))


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], factors: int = 8, epochs: int = 6, updates: int = 600, rate: float = 0.08, l2: float = 1e-5, batch: int = 32, seed: int = 1) -> FactorisationMachine:
    """AdaGrad on the logistic loss over (label, feature numbers, values); the rows' order is fixed by the seed. Few rows are
    gone through more often, for as many updates at least."""
    y = np.array([d[0] for d in docs], np.float32)
    rng = np.random.default_rng(seed)
    m = FactorisationMachine(rows=len(docs))
    share = float(y.mean()) if len(y) else 0.5
    m.w0 = math.log(max(share, 1e-6) / max(1 - share, 1e-6)) if len(y) else 0.0
    if not 0 < share < 1 or not len(y):
        return m
    m.v = rng.normal(0, 0.02, (DIM, factors)).astype(np.float32)
    gw, gv, g0 = np.full(DIM, 1e-2, np.float32), np.full((DIM, factors), 1e-2, np.float32), 1e-2
    for _ in range(max(epochs, -(-updates * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            sizes = np.array([len(docs[r][1]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            idx, val = np.concatenate([docs[r][1] for r in rows]), np.concatenate([docs[r][2] for r in rows])
            vx = m.v[idx] * val[:, None]
            s = np.add.reduceat(vx, starts)
            z = m.w0 + np.add.reduceat(m.w[idx] * val, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            e = np.repeat(err, sizes)
            near, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e * val, len(near)).astype(np.float32) + l2 * m.w[near]
            dvx = e[:, None] * val[:, None] * (np.repeat(s, sizes, 0) - vx)
            dv = np.stack([np.bincount(inv, dvx[:, f], len(near)) for f in range(factors)], 1).astype(np.float32) + l2 * m.v[near]
            gw[near] += dw * dw
            gv[near] += dv * dv
            m.w[near] -= rate * dw / np.sqrt(gw[near])
            m.v[near] -= rate * dv / np.sqrt(gv[near])
            d0 = float(err.sum())
            g0 += d0 * d0
            m.w0 -= rate * d0 / math.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, label: str = "quality") -> FactorisationMachine:
    """Fits on at most max_rows labelled documents whose crc32(doc_id) mod 4 is not 2. Several labels of a document: the
    larger. Only ids and labels of the sample (bounded by max_rows) are broadcast, only its features come to the driver."""
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (doc_bucket(F.col("doc_id"), 4) != 2))
    sample = usable.groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text", _length(docs).alias("_n")).join(F.broadcast(sample), "doc_id")
    # one row for each id, the least: repeated ids add nothing and are combined before the shuffle
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_y", "text", "_n")).alias("r")).select("r.*")

    def featurize(batches):
        own_cache("quality")
        for b in batches:
            got = [features(t, n) for t, n in zip(text_bytes(b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], names=["y", "i", "v"])

    got = rows.mapInArrow(featurize, "y int, i binary, v binary").collect()
    # a fixed order, whatever order the tasks end in
    return fit([(r.y, np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32)) for r in sorted(got, key=lambda r: (r.i, r.v, r.y))])


def _length(docs: DataFrame):
    return F.expr("try_cast(n_chars as bigint)") if "n_chars" in docs.columns else F.char_length("text").cast("long")


def _scores(model: FactorisationMachine, texts: list[bytes], lengths: list) -> np.ndarray:
    out = []
    for at in range(0, len(texts), 256):
        got = [features(t, n) for t, n in zip(texts[at : at + 256], lengths[at : at + 256])]
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])[:-1]])
        out.append(model.predict(np.concatenate([i for i, _ in got]), np.concatenate([v for _, v in got]), starts))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row, in one pass without a shuffle."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own_cache("quality")
        for b in batches:
            s = _scores(shared.value, text_bytes(b.column(2)), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(doc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text", _length(docs))
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold, all columns as they are."""
    bound_batches(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches):
        own_cache("quality")
        for b in batches:
            s = _scores(shared.value, text_bytes(b.column(at)), b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(s >= threshold))

    # a name that no column has; columns are read by place
    extra = "__length"
    while extra.lower() in (c.lower() for c in names):
        extra += "_"
    return docs.withColumn(extra, _length(docs)).mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> FactorisationMachine:
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
