"""Media columns as content-defined chunks.

A payload (the text's UTF-8 bytes, filled with bytes 255 to a positive multiple of BLOCK, as 8-bit samples) is cut where
a gear hash of its last 32 bytes has its mask bits zero. Chunks are known by their SHA-256. Each task appends the chunks
it has not seen to a pack file; a Spark aggregation of digests gives every chunk one place, the lowest, and compact()
rewrites the packs by it, so that each chunk is stored once. Recipes, the ordered chunk lists, are joined to the places
by digest and rebuild the payloads, which are verified against the digests of their chunks and of the whole.

Packs lie in GROUPS folders. A pack is a row of compressed frames of about FRAME bytes of chunk records. A record is the chunk's length (4 bytes,
little-endian) and its samples; a payload's stored form is its records in order, as they are read back.

Defined results: null and empty texts are one block of bytes 255; very long texts are cut as any other; equal texts have
equal values in every column; repeated rows are each rebuilt; an empty table gives an empty result; other columns are
not read. A damaged chunk raises an error. Packs get their final names by a rename when whole.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, drop_dir, join_salted, local_fs, scratch, shared_dir, text_bytes

BLOCK, FILL, TAIL = 576, 255, 32
LEAST, MASK_BITS, MOST = 256, 10, 8192
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The mask takes the upper bits, which all of the last 32 bytes reach.
_MASK = np.uint32(((1 << MASK_BITS) - 1) << (32 - MASK_BITS))
#: Digests that a task remembers so as not to write a chunk twice; beyond, the oldest go and compact() drops the copies.
SEEN = 200_000
FRAME = 1 << 18
#: Packs are in so many groups; compact() rewrites one after the other and can drop each, so that copies never double the disk.
GROUPS = 6


def payload_of(data: bytes) -> bytes:
    return data + bytes([FILL]) * (BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks; each chunk has LEAST to MOST bytes, but for the last."""
    h, s = _GEAR[np.frombuffer(payload, np.uint8)], 1
    h = h.copy()
    while s < 32:
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if len(h) > s else h[s:]
        s *= 2
    ends, at, n = [], 0, len(payload)
    for p in (np.flatnonzero((h & _MASK) == 0) + 1).tolist():
        while p - at > MOST:
            at += MOST
            ends.append(at)
        if p - at >= LEAST and p < n:
            ends.append(p)
            at = p
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n]


_CHUNK = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("length", T.IntegerType()), T.StructField("frame", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType())])
_ARROW_CHUNK = pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("frame", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])


def record_of(chunk: bytes) -> bytes:
    return struct.pack("<I", len(chunk)) + chunk


class _Pack:
    """A pack that is written: records are held until they make a frame, then their places get its offset and size."""

    def __init__(self, folder: str, group: int):
        self.fs, self.path = local_fs(f"{folder}/{group}")
        self.fs.create_dir(self.path, recursive=True)
        self.file = uuid.uuid4().hex
        self.name = f"{group}/{self.file}"
        self.out = self.fs.open_output_stream(f"{self.path}/.{self.file}")
        self.size = self.fill = 0
        self.held: list[bytes] = []
        self.places: list[dict] = []
        self.press = zstandard.ZstdCompressor(level=6)

    def add(self, record: bytes, place: dict) -> None:
        place["at"] = self.fill
        self.held.append(record)
        self.places.append(place)
        self.fill += len(record)
        if self.fill >= FRAME:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        frame = self.press.compress(b"".join(self.held))
        for p in self.places:
            p["frame"], p["size"] = self.size, len(frame)
        self.out.write(frame)
        self.size += len(frame)
        self.held, self.places, self.fill = [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.fs.move(f"{self.path}/.{self.file}", f"{self.path}/{self.file}.pack")


def store(docs: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes packs and returns their folder and, for each row: row (unique), doc_id, n_bytes, pack, payload digest and
    the chunks (digest, length; frame, size and at where this row's chunk was stored, else null)."""
    bound_batches(docs.sparkSession)
    folder = folder or shared_dir(docs.sparkSession, "media-packs")
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("pack", T.StringType()), T.StructField("whole", T.BinaryType()), T.StructField("chunks", T.ArrayType(_CHUNK))])

    def run(batches):
        from pyspark import TaskContext

        pack, seen, row = None, OrderedDict(), TaskContext.get().partitionId() << 40
        for b in batches:
            pack = pack or _Pack(folder, TaskContext.get().partitionId() % GROUPS)
            cols = [[], [], [], []]
            for data in text_bytes(b.column(1)):
                payload = payload_of(data)
                chunks, at = [], 0
                for end in cuts(payload):
                    piece, at = payload[at:end], end
                    digest = hashlib.sha256(piece).digest()
                    chunk = {"digest": digest, "length": len(piece), "frame": None, "size": None, "at": None}
                    if digest not in seen:
                        seen[digest] = None
                        pack.add(record_of(piece), chunk)
                        if len(seen) > SEEN:
                            seen.popitem(last=False)
                    chunks.append(chunk)
                cols[0].append(row)
                cols[1].append(len(data))
                cols[2].append(hashlib.sha256(payload).digest())
                cols[3].append(chunks)
                row += 1
            pack.flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), b.column(0), pa.array(cols[1], pa.int64()), pa.array([pack.name] * b.num_rows, pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(_ARROW_CHUNK))],
                names=schema.names,
            )
        if pack:
            pack.close()

    return folder, cut(docs.select("doc_id", "text").mapInArrow(run, schema), "media-recipes")


def chunk_table(stored: DataFrame) -> DataFrame:
    """digest, length, n (how often it occurs) and the one place (pack, frame, size, at) of each distinct chunk."""
    chunks = stored.select("pack", F.explode("chunks").alias("c"))
    place = F.when(F.col("c.at").isNotNull(), F.struct("pack", "c.frame", "c.size", "c.at"))
    return chunks.groupBy("c.digest").agg(F.first("c.length").alias("length"), F.count("*").alias("n"), F.min(place).alias("place"))


def recipes(stored: DataFrame, table: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, whole and the ordered chunks, each with its place in the packs. Chunks that many payloads
    share are dealt out."""
    steps = stored.select("row", F.posexplode("chunks").alias("seq", "c")).select("row", "seq", "c.digest", "c.length")
    met = join_salted(steps, table.select("digest", "place"), ["digest"], table.select("digest", "n"), F.xxhash64("row", "seq"))
    lists = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "length", "place"))).alias("list"))
    return stored.select("row", "doc_id", "n_bytes", "whole").join(lists, "row")


class PackReader:
    """Chunks by their places; keeps the last frames and open packs."""

    def __init__(self, folder: str, frames: int = 32, files: int = 16):
        self.fs, self.path = local_fs(folder)
        self.files, self.frames, self.most = OrderedDict(), OrderedDict(), (files, frames)
        self.open = zstandard.ZstdDecompressor()

    def _file(self, pack: str):
        if pack not in self.files:
            self.files[pack] = self.fs.open_input_file(f"{self.path}/{pack}.pack")
            if len(self.files) > self.most[0]:
                self.files.popitem(last=False)[1].close()
        return self.files[pack]

    def record(self, place: dict, length: int) -> bytes:
        """The record of a chunk as it is stored: its length and samples."""
        key = (place["pack"], place["frame"])
        if key in self.frames:
            self.frames.move_to_end(key)
        else:
            f = self._file(place["pack"])
            f.seek(place["frame"])
            self.frames[key] = self.open.decompress(f.read(place["size"]))
            if len(self.frames) > self.most[1]:
                self.frames.popitem(last=False)
        found = self.frames[key][place["at"] : place["at"] + 4 + length]
        if struct.unpack("<I", found[:4])[0] != length:
            raise ValueError(f"a record in pack {place['pack']} is damaged")
        return found


def feature(samples: np.ndarray) -> str:
    """Level, spread, activity and share of fill of 8-bit samples."""
    x = samples.astype(np.float64)
    return f"mean={x.mean():.4f};std={x.std():.4f};step={np.abs(np.diff(x)).mean():.4f};fill={(samples == FILL).mean():.4f}"


def rebuild(folder: str, listed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and n_chunks, all
    from the bytes read back."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.LongType())
    schema = T.StructType([listed.schema["doc_id"], T.StructField("n_bytes", T.LongType()), *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches):
        reader = PackReader(folder)
        for b in batches:
            cols = [[] for _ in names]
            for whole, steps in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                pieces, media, size = [], hashlib.sha256(), 0
                for s in steps:
                    record = reader.record(s["place"], s["length"])
                    piece = record[4:]
                    if hashlib.sha256(piece).digest() != s["digest"]:
                        raise ValueError(f"a chunk in pack {s['place']['pack']} is damaged")
                    pieces.append(piece)
                    media.update(record)
                    size += len(record)
                payload = b"".join(pieces)
                digest = hashlib.sha256(payload)
                if digest.digest() != whole:
                    raise ValueError("a chunk list doesn't give its payload")
                for c, v in zip(cols, (len(payload), digest.hexdigest(), zlib.crc32(payload[-TAIL:]), size, media.hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(pieces))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string() if n.endswith("sha256") or n == "feature" else pa.int64()) for c, n in zip(cols, names))], names=schema.names)

    first = F.element_at("list", 1)["place"]
    near = listed.sortWithinPartitions(first["pack"], first["frame"])
    return near.select("doc_id", "n_bytes", "whole", "list").mapInArrow(run, schema)


def compact(folder: str, table: DataFrame, drop: bool = False) -> tuple[str, DataFrame]:
    """Packs in a new folder that hold each distinct chunk once, in the order of the old ones, and the chunk table with
    the new places. A group of packs at a time; drop: each is deleted when all of it is rewritten."""
    spark, target, done = table.sparkSession, shared_dir(table.sparkSession, "media-compact"), None
    table = cut(table.select("digest", "length", "n", "place"), "media-table")
    schema = table.schema

    def run(batches):
        from pyspark import TaskContext

        reader, pack = PackReader(folder), None
        for b in batches:
            pack = pack or _Pack(target, TaskContext.get().partitionId() % GROUPS)
            places = []
            for length, place in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                new = {"pack": pack.name}
                pack.add(reader.record(place, length), new)
                places.append(new)
            pack.flush()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(places, pa.struct([("pack", pa.string()), ("frame", pa.int64()), ("size", pa.int32()), ("at", pa.int32())]))], names=["digest", "length", "n", "place"])
        if pack:
            pack.close()

    for group in range(GROUPS):
        rows = table.where(F.startswith("place.pack", F.lit(f"{group}/"))).repartition("place.pack").sortWithinPartitions("place.pack", "place.frame", "place.at")
        part = cut(rows.mapInArrow(run, schema), "media-chunks")
        done = part if done is None else done.unionByName(part)
        if drop:
            drop_dir(spark, f"{folder}/{group}")
    return target, done


def stored_and_read(docs: DataFrame) -> DataFrame:
    """rebuild() of docs whose chunks are stored once each. Packs and all tables but the result are deleted."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        first, stored = store(docs)
        packs, table = compact(first, chunk_table(stored), drop=True)
        out = keep(cut(rebuild(packs, recipes(stored, table)), "media-result"))
        drop_dir(spark, first)
        drop_dir(spark, packs)
        return out
