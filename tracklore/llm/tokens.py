"""Token ids of documents in Arrow files of equal-length sequences.

A shard holds the documents of one range of doc_ids in ascending order. It is two Arrow IPC files, uncompressed, so that
a memory map gives any row without a copy:
  ids-*.arrow    record batches of at most ROWS_PER_BATCH rows: `input_ids` fixed_size_list<uint16|uint32>[length] and
                 `mask` fixed_size_list<bool>[length]; the shard's stream of ids, cut into rows; the last row is filled
                 with the end id, and there the mask is false
  index-*.arrow  one row a document: doc_id, first (place of its first id in the shard), n_tokens
Every document ends with the end id, also counted. Shards are named by the attempt that wrote them and come under
their final name by a rename, so a task that is run again leaves a whole file.

Defined results: null and empty texts are the end id alone; very long texts are encoded whole; documents of the same
doc_id stand by text (null first); rows without doc_id come first; an empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, input_partitions, local_fs, own_cache, shared_dir

LENGTH = 2048
ROWS_PER_BATCH = 256
END_ID = 0
#: The pattern by which byte-level BPE parts text, written for re; it holds where letters are the only word characters
#: beyond ASCII, other texts are encoded by the library in one piece.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\x00-\x1b!-~\x20À-ÖØ-öø-ʯͰ-ͳΆΈ-ϿЀ-ҁҊ-ԯ]*")
#: Parts that a process keeps, some 150 bytes each, and their longest. Bytes of text encoded at a time.
_KEPT, _SHORT, _AT_ONCE = 450_000, 12, 1 << 20
#: New parts that the library is given as one text.
_JOINED = 256


class Encoder:
    """Ids of texts as bytes. Parts that occur again are looked up; the library encodes each part once."""

    def __init__(self, path: str):
        # one thread a task: the library's own threads would each hold memory beyond the cores that Spark gave
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.dtype = np.uint32 if self.wide else np.uint16
        self.code = "I" if self.wide else "H"
        self.cache: dict[str, bytes] = {}
        state = self.library.pre_tokenizer.__getstate__() if self.library.pre_tokenizer else b""
        self.by_parts = self.library.normalizer is None and b'"ByteLevel"' in state and b'"add_prefix_space":false' in state and b'"use_regex":true' in state
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _each(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of different parts. Where each begins with its only space the library parts their text as it was, so that
        they need no call each."""
        spaced, rest = [], []
        for w in parts:
            (spaced if w[0] == " " and len(w) > 1 and not w[1].isspace() else rest).append(w)
        if any(" " in s for s in self.special):
            spaced, rest = [], parts
        for k in range(0, len(spaced), _JOINED):
            words = spaced[k : k + _JOINED]
            found = self.library.encode("".join(words), add_special_tokens=False)
            n = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
            if len(n) != len(words) or not n.all():
                rest += words
                continue
            ids, stop = np.array(found.ids, self.dtype).tobytes(), (np.cumsum(n) * np.dtype(self.dtype).itemsize).tolist()
            yield from zip(words, (ids[a:b] for a, b in zip([0, *stop], stop)))
        yield from ((w, array(self.code, e.ids).tobytes()) for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)))

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return [self._whole(t) for t in texts]
        parts = [None if any(s in t for s in self.special) or not _PLAIN.fullmatch(t) else _PARTS.findall(t) for t in texts]
        # short parts stay, as they come again; long ones and those beyond the bound last for this call
        new = list(set().union(*(p for p in parts if p)).difference(self.cache))
        self.cache.update(self._each(new))
        get = self.cache.__getitem__
        out = [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]
        full = len(self.cache) - len(new) >= _KEPT
        for w in new:
            if full or len(w) > _SHORT:
                del self.cache[w]
        return out


def _encoder(path: str) -> Encoder:
    _encoders = own_cache("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Shard:
    """Takes documents one after the other; holds at most one batch of rows and the index."""

    def __init__(self, folder: str, dtype, length: int):
        self.fs, self.path = local_fs(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.length, self.dtype = uuid.uuid4().hex, length, np.dtype(dtype)
        self.value = pa.uint32() if self.dtype.itemsize == 4 else pa.uint16()
        self.schema = pa.schema([("input_ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.path}/.ids-{self.name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.size, self.total, self.rows = [], 0, 0, 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.total, n))
        self.held.append(ids)
        self.size += n
        self.total += n
        if self.size >= self.length * ROWS_PER_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        rows = -(-len(ids) // self.length) if last else len(ids) // self.length
        whole, self.held = ids[: rows * self.length], [ids[rows * self.length :].tobytes()]
        self.size = len(ids) - len(whole)
        mask = np.ones(rows * self.length, bool)
        if len(whole) < len(mask):
            mask[len(whole) :] = False
            whole = np.concatenate([whole, np.full(len(mask) - len(whole), END_ID, self.dtype)])
        for at in range(0, rows, ROWS_PER_BATCH):
            part = slice(at * self.length, min(rows, at + ROWS_PER_BATCH) * self.length)
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[part], t), self.length) for x, t in ((whole, self.value), (mask, pa.bool_()))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.rows += rows

    def close(self, id_type: pa.DataType) -> dict:
        self._flush(True)
        self.writer.close()
        self.sink.close()
        ids, first, n = zip(*self.index)
        table = pa.table({"doc_id": pa.array(ids, id_type), "first": pa.array(first, pa.int64()), "n_tokens": pa.array(n, pa.int64())})
        with self.fs.open_output_stream(f"{self.path}/.index-{self.name}") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table, max_chunksize=1 << 16)
        for kind in ("ids", "index"):
            self.fs.move(f"{self.path}/.{kind}-{self.name}", f"{self.path}/{kind}-{self.name}.arrow")
        return {"name": self.name, "n_docs": len(ids), "n_tokens": self.total, "n_rows": self.rows}


def _portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about _AT_ONCE bytes of text, one row at least."""
    size = np.cumsum([0, *(n or 0 for n in pc.binary_length(b.column(1)).to_pylist())])
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + _AT_ONCE, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


MANIFEST = "shard int, name string, n_docs long, n_tokens long, n_rows long"


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH, partitions: int | None = None) -> tuple[str, DataFrame]:
    """Writes the shards below folder (a new shared one by default) and returns it with the manifest: one row a shard,
    numbered in the order of doc_ids. tokenizer: a file of the tokenizers library, at the same path on all machines."""
    bound_batches(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    id_type = docs.schema["doc_id"].dataType
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions or input_partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        shard, encoder, kind = None, _encoder(tokenizer), None
        end = np.array([END_ID], encoder.dtype).tobytes()
        for b in batches:
            kind = b.column(0).type
            shard = shard or _Shard(folder, encoder.dtype, length) if b.num_rows else shard
            for part in _portions(b):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.many([t or "" for t in part.column(1).to_pylist()])):
                    shard.add(doc_id, ids + end)
        if shard:
            row = shard.close(kind) | {"shard": TaskContext.get().partitionId()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_rows", pa.int64())]))

    assert id_type is not None
    return folder, cut(dealt.mapInArrow(run, MANIFEST), "tokens-manifest")


class ShardReader:
    """A memory-mapped shard: rows and documents without a copy."""

    def __init__(self, folder: str, name: str):
        fs, path = local_fs(folder)
        opened = pa.memory_map if type(fs).__name__ == "LocalFileSystem" else fs.open_input_file
        self.ids = pa.ipc.open_file(opened(f"{path}/ids-{name}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{path}/index-{name}.arrow"))
        self.length = self.ids.schema.field("input_ids").type.list_size
        # all batches but the last have as many rows as the first, or the writer's flushes differ: keep their first rows
        self.starts: list[int] | None = None

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of each record batch, flat."""
        for k in range(self.ids.num_record_batches):
            b = self.ids.get_batch(k)
            yield b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).values.to_numpy(zero_copy_only=False)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Random access: ids (a view of the map) and mask of one row."""
        if self.starts is None:
            self.starts = list(np.cumsum([0] + [self.ids.get_batch(k).num_rows for k in range(self.ids.num_record_batches)]))
        k = int(np.searchsorted(self.starts, row, "right")) - 1
        b, at = self.ids.get_batch(k), row - self.starts[k]
        part = slice(at * self.length, (at + 1) * self.length)
        return b.column(0).values.to_numpy(zero_copy_only=True)[part], b.column(1).values.to_numpy(zero_copy_only=False)[part]

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """doc_id, place of the first id in the shard, and ids of each document, in order; a batch or two in memory."""
        source, held, base = self.batches(), np.zeros(0, np.uint16), 0
        for k in range(self.index.num_record_batches):
            b = self.index.get_batch(k)
            for doc_id, first, n in zip(*(c.to_pylist() for c in b.columns)):
                while base + len(held) < first + n:
                    ids, mask = next(source)
                    held, base = np.concatenate([held[first - base :], ids[mask]]), first
                yield doc_id, first, held[first - base : first - base + n]


def read_back(spark, folder: str, manifest: DataFrame, id_field: T.StructField) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, read from the files. The manifest has
    one row a shard, so its running total is small."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut(manifest.select("shard", "name", before.cast("long").alias("base")), "tokens-places")
    shards = placed.repartition(max(1, min(placed.count(), input_partitions(placed))), "shard")
    fields = [id_field, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("shard", T.IntegerType())]

    def run(batches):
        names = [f.name for f in fields]
        for b in batches:
            for shard, name, base in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                for doc_id, first, ids in ShardReader(folder, name).documents():
                    rows.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names).cast(kind(rows))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names).cast(kind(rows))

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))

    def kind(_):
        return arrow

    return shards.mapInArrow(run, T.StructType(fields))
