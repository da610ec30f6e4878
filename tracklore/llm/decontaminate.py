"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, texts scanned once.

Items and texts are reduced to words (A-Z lower-cased; runs of ASCII letters, digits and characters beyond ASCII). Every
window of `size` consecutive item words, or a whole item of fewer words, is a pattern over an alphabet of words: each word
of the items is one symbol, all other words are one symbol that no pattern has. The automaton meets all patterns in one
pass over a text's symbols. Hit words are mapped back to character offsets of the original text.

Defined results: null and empty texts and texts without words have no hits; very long texts are scanned whole; a window
that several items hold counts for each; repeated rows are reported each; an empty benchmark leaves every text clean;
null items hold no window, items without id are ignored. Columns beside id and text are not read.
The automaton is bounded by its nodes: it takes `block_windows` windows, so `size` times as many nodes at most. A larger
benchmark is taken in blocks of that many windows (long items in parts that overlap), each of which is one pass.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, scratch, text_bytes

WINDOW = 10
#: Windows of an automaton: some 100 bytes for each of the ten nodes that a window adds at most.
BLOCK_WINDOWS = 150_000
#: Words: bytes of lower-case letters, digits and all beyond ASCII; A-Z are lower-cased, all others part words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A word that no item has.
_OTHER = "\x01"
_automata: dict[str, Matcher] = {}


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def _symbol(k: int) -> str:
    """The k-th symbol: a character beyond ASCII, no surrogate."""
    k += 0x100
    return chr(k if k < 0xD800 else k + 0x800)


class Matcher:
    """The alphabet of the items' words, and the automaton of their windows; values: (words in the window, positions in
    items of those that hold it)."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.symbols: dict[bytes, str] = {}
        self.ids = [str(k) for k, _ in items]
        found: dict[str, set[int]] = {}
        for k, (_, text) in enumerate(items):
            line = "".join([self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in words_of(text)])
            for i in range(max(1, len(line) - size + 1) if line else 0):
                found.setdefault(line[i : i + size], set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for key, holders in found.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(holders))))
        if found:
            self.automaton.make_automaton()

    def scan(self, data: bytes) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which are hit, and the positions of the items met."""
        words = words_of(data)
        if not words or not self.symbols:
            return len(words), np.zeros(0, bool), set()
        get = self.symbols.get
        met = list(self.automaton.iter("".join([get(w, _OTHER) for w in words])))
        if not met:
            return len(words), np.zeros(0, bool), set()
        step = np.zeros(len(words) + 1, np.int64)
        after = np.array([end + 1 for end, _ in met])
        np.add.at(step, after - [n for _, (n, _) in met], 1)
        np.add.at(step, after, -1)
        return len(words), np.cumsum(step[:-1]) > 0, {k for _, (_, holders) in met for k in holders}


def spans_of(data: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of the runs of hit words, end exclusive."""
    at = [m.span() for m in _WORD.finditer(data)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    # bytes that begin a character, so that byte offsets become character offsets
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(heads[at[i][0]]), int(heads[at[j - 1][1]])) for i, j in zip(edges[::2], edges[1::2])]


def blocks(benchmark: DataFrame, limit: int = BLOCK_WINDOWS, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of at most so many windows; only one block at a time is on the driver. An item of more windows
    comes in parts that share size - 1 words."""
    block, held = [], 0
    for r in benchmark.where(F.col(id_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        words = words_of((r[1] or "").encode())
        for k in range(0, max(1, len(words) - size + 1), limit):
            part = words[k : k + limit + size - 1]
            n = max(1, len(part) - size + 1)
            if block and held + n > limit:
                yield block
                block, held = [], 0
            block.append((r[0], b" ".join(part)))
            held += n
    if block:
        yield block


def _matcher(shared: Broadcast, key: str, size: int) -> Matcher:
    """The matcher of a block in this worker, where it is made once."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Matcher(shared.value, size)
    return _automata[key]


def _reports(docs: DataFrame, items: list[tuple[object, bytes]], size: int, spans: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex
    fields = [docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))

    def run(batches):
        m = _matcher(shared, key, size)
        for b in batches:
            n, h, found, where = [], [], [], []
            for data in text_bytes(b.column(1)):
                words, hit, met = m.scan(data)
                n.append(words)
                h.append(int(hit.sum()))
                found.append(sorted({m.ids[k] for k in met}))
                if spans:
                    where.append([{"start": i, "end": j} for i, j in spans_of(data, hit)] if len(hit) else [])
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(found, pa.list_(pa.string()))]
            if spans:
                cols.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and spans of each row. A benchmark beyond one block is
    taken in several passes, whose word hits are put together from the spans; two blocks are on the driver at most."""
    parts = blocks(benchmark, block_windows, size)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _reports(docs, first, size, spans)
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_in_blocks(docs, chain([first, second], parts), size, spans), "decontaminate-report"))


def _in_blocks(docs: DataFrame, items: Iterator[list[tuple[object, bytes]]], size: int, spans: bool) -> DataFrame:
    numbered = cut(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    total: DataFrame | None = None
    for block in items:
        one = cut(_reports(numbered.select(F.col("_row").alias("doc_id"), "text"), block, size, True), "decontaminate-block")
        total = one if total is None else total.unionByName(one)
    merged = total.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # spans of different blocks may overlap or touch: words are counted over their union
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (a, s) -> if(size(a) > 0 and s.start < try_element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', try_element_at(a, -1).start, 'end', greatest(try_element_at(a, -1).end, s.end)))), concat(a, array(s))))"
    )
    merged = merged.withColumn("spans", joined).join(numbered.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_row"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.size(F.regexp_extract_all(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), 1)))
    return merged.select(F.col("_id").alias("doc_id"), "n_words", hit.alias("n_hit"), "items", *(["spans"] if spans else []))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that hold any window, all columns as they are; a pass for each block of the benchmark."""
    bound_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    for block in blocks(benchmark, size=size):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            m = _matcher(shared, key, size)
            for b in batches:
                clean = [not len(m.scan(data)[1]) for data in text_bytes(b.column(at))]
                yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
