"""Exact substring dedup with run-length indexes.

Every string of LENGTH bytes that starts at two places, in one text or two, is a repeat; each byte that a repeat covers
is removed. Texts are compared as UTF-8, matches never cross texts.

1. Each LENGTH-byte window of a text picks the smallest hash among its grams (leftmost where equal): its seed. Equal
   windows pick equal seeds, so all that can match meets at a seed. Consecutive windows that pick the same gram make one
   segment. Texts give (seed, segment digest, place).
2. Seeds that occur once end here. Segments that are alike as a whole are counted: all their windows are repeats.
3. The distinct segments of the remaining seeds are dealt out by seed and put into indexes of bounded size: the
   Burrows-Wheeler transform of their concatenation, stored by its runs, with the suffixes' places sampled at the runs'
   first and last rows. Segments are streamed backwards through the index by LF steps on the runs. The matching statistic
   of a place, the longest match with any other place, goes along: it grows by one while the neighbouring row is in the
   same run, and at a run's border the place sampled at the next run of that byte says what to compare with. Places whose
   statistic reaches LENGTH are repeats.
   A seed with more than GROUP_BYTES of distinct segments is not gathered: its segments are taken apart by seeds of longer
   grams, GRAMS, and go through the same steps; grams of LENGTH bytes are whole windows.
4. The repeats' places come back to the texts by a join on the text's digest and are cut out.
Joins whose keys may hold a large share of the rows (a common passage, a text with many copies) deal those keys out.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH have no window; very long texts are handled
whole; repeated rows are repeats of each other; an empty table gives an empty result; texts are known by a 64-bit hash and
their length, so equal texts lose the same bytes; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, join_salted, scratch, text_bytes

LENGTH, GRAMS = 200, (32, 64, 128, 200)
#: An index takes segments up to so many bytes; places then have 21 bits, so three ranks fit into one key.
INDEX_BYTES = 1_800_000
GROUP_BYTES = 8 << 20
_GRAM = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15


def text_key(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def segments(data: bytes, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seed, start and end (of its bytes) of each segment of a text."""
    if len(data) < length:
        z = np.zeros(0, np.int64)
        return z, z, z
    # hashes of 1, 2, 4 bytes and so on; those that add up to a gram are put together
    power, s, h, done = _GRAM[np.frombuffer(data, np.uint8)], 1, None, 0
    while True:
        if gram & s:
            h = power if h is None else h[: len(power) - done] * np.uint64(pow(_STEP, s, 1 << 64)) + power[done : done + len(h)]
            done += s
            h = h[: len(data) - done + 1]
        if s * 2 > gram:
            break
        power = power[:-s] * np.uint64(pow(_STEP, s, 1 << 64)) + power[s:]
        s *= 2
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: done - width], low[width - done :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.concatenate([start[1:], [len(at)]]) + length - 1
    return h[at[start]].view(np.int64), start, end


@dataclass
class RunLengthIndex:
    """Index of texts. heads, chars: first row and byte + 1 of each run of the transform (0: a text's end); before: how
    often a run's byte stands in earlier runs; first: rows of suffixes that begin with a smaller byte; at_head, at_last:
    places of the suffixes at each run's first and last row; above, below: nearest runs of the same byte, -1 if none;
    eight: eight bytes from each place on; ends: places of the texts' ends; lasts: last row of each run; run_of: run of
    each row; left: bytes from each place to its text's end (these two spare a search in heads and in ends at each step)."""

    heads: np.ndarray
    chars: np.ndarray
    before: np.ndarray
    first: np.ndarray
    at_head: np.ndarray
    at_last: np.ndarray
    above: np.ndarray
    below: np.ndarray
    eight: np.ndarray
    ends: np.ndarray
    lasts: np.ndarray
    run_of: np.ndarray
    left: np.ndarray
    rows: int
    depth: int

    @classmethod
    def build(cls, texts: list[bytes], depth: int = LENGTH) -> RunLengthIndex:
        """Suffixes are ordered by prefix doubling; those alike up to their texts' ends by the texts' order. depth: how far
        matches are followed."""
        sizes = np.array([len(t) + 1 for t in texts])
        stop = np.cumsum(sizes)
        # 32 bits where they do: an index of GROUP_BYTES is the most that a task holds
        flat = np.zeros(stop[-1], np.int16)
        joined = np.frombuffer(b"".join(texts), np.uint8)
        inside = np.ones(stop[-1], bool)
        inside[stop - 1] = False
        flat[inside] = joined.astype(np.int16) + 1
        n = len(flat)
        limit = np.repeat(stop.astype(np.int32), sizes)  # where the text of a place ends
        places = np.arange(n, dtype=np.int32)
        left = limit - places

        def shifted(of, by):
            out = np.zeros(n, of.dtype)
            m = max(0, n - by)
            np.multiply(of[by:], left[:m] > by, out=out[:m])
            return out

        # seven bytes at first (9 bits each), then two or three times as many each time
        one = flat.astype(np.int64)
        two = one << 9 | shifted(one, 1)
        key = (two << 18 | shifted(two, 2)) << 27 | shifted(two, 4) << 9 | shifted(one, 6)
        reach, longest = 7, int(sizes.max())

        def fresh(key):
            new = np.ones(len(key) + 1, bool)
            np.not_equal(key[1:], key[:-1], out=new[1:-1])
            return new

        # a rank is the row, from 1 on, at which the suffixes that are alike so far begin; only those are sorted again
        order = np.argsort(key).astype(np.int32)
        at, new = np.arange(n, dtype=np.int32), fresh(key[order])
        live, rank = order, np.empty(n, np.int32)
        # three ranks in a key where they fit, so that each round triples what is compared; else two
        times = 3 if 3 * n.bit_length() <= 63 else 2
        width = n.bit_length() if times == 3 else 31
        while True:
            begin = np.flatnonzero(new[:-1])
            rank[live] = np.repeat(at[begin] + np.int32(1), np.diff(begin, append=len(live)))
            alike = np.flatnonzero(~(new[:-1] & new[1:]))
            live, at = live[alike], at[alike]
            if reach >= longest or not len(live):
                break
            key, room = rank[live].astype(np.int64), left[live]
            for k in range(1, times):
                key = (key << width) | rank.take(live + np.int32(k * reach), mode="clip") * (room > k * reach)
            by = np.argsort(key)
            live, new = live[by], fresh(key[by])
            order[at] = live
            reach *= times
        # suffixes alike up to their texts' ends, by place
        order[at] = np.sort((rank[live].astype(np.int64) << 31) | live) & ((1 << 31) - 1)
        order = order.astype(np.int64)
        # the first byte before each suffix
        begin = np.concatenate([[0], stop[:-1]])
        last = flat[np.maximum(order - 1, 0)].astype(np.int64)
        starts = np.zeros(n, bool)
        starts[begin] = True
        last[starts[order]] = 0
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        chars, runs = last[heads], np.diff(np.concatenate([heads, [n]]))
        by = np.argsort(chars, kind="stable")
        total = np.cumsum(runs[by]) - runs[by]
        counts = np.bincount(chars, runs, 257).astype(np.int64)
        before_char = np.concatenate([[0], np.cumsum(counts)[:-1]])
        before = np.empty(len(heads), np.int64)
        before[by] = total - before_char[chars[by]]
        # the ends of texts are the first rows, in the texts' order
        first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=257))[:-1]])
        above, below = np.full(len(heads), -1), np.full(len(heads), -1)
        same = chars[by[1:]] == chars[by[:-1]]
        above[by[1:][same]], below[by[:-1][same]] = by[:-1][same], by[1:][same]
        # the first byte lowest
        eight = np.zeros(n + 8, np.uint64)
        eight[:n] = np.maximum(flat, 1) - 1
        for k in (1, 2, 4):
            eight[: n + 8 - k] |= eight[k:] << np.uint64(8 * k)
        lasts = np.append(heads[1:], n) - 1
        run_of = np.repeat(np.arange(len(heads), dtype=np.int32), lasts - heads + 1)
        return cls(heads, chars, before, first, order[heads], order[lasts], above, below, eight, stop - 1, lasts, run_of, left - 1, n, depth)

    def step(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LF: the run of each row, and the row of the suffix one byte longer."""
        run = self.run_of[row]
        return run, self.first[self.chars[run]] + self.before[run] + row - self.heads[run]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes from places a and b on are alike, up to depth and to the texts' ends."""
        most = np.minimum(np.minimum(self.left[a], self.left[b]), self.depth)
        same, open_ = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        x, y, room, k = a[open_], b[open_], most[open_], 0
        while len(open_):
            d = self.eight[x + k] ^ self.eight[y + k]
            # zero bits below the lowest one, all 64 where there is none
            same[open_] = k + (np.bitwise_count(~d & (d - np.uint64(1))) >> 3)
            k += 8
            on = np.flatnonzero((d == 0) & (room > k))
            open_, x, y, room = open_[on], x[on], y[on], room[on]
        return np.minimum(same, most)

    def repeated(self, which: np.ndarray) -> list[np.ndarray]:
        """For each of the texts, whether the matching statistic of each of its places reaches depth: whether the bytes
        there stand at any other place as well. All texts are streamed at once, from their ends."""
        sizes = np.diff(self.ends, prepend=-1)[which] - 1
        by_size = np.argsort(-sizes, kind="stable")
        left, place = sizes[by_size], self.ends[which][by_size]
        row = which[by_size].copy()
        # matches with the suffixes of the rows above and below, a text's end with none
        up, down = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        n = np.maximum(sizes - self.depth + 1, 0)
        base = np.concatenate([[0], np.cumsum(n)])
        found = np.zeros(int(base[-1]), bool)
        to = base[by_size] + left  # one past the place in found of a text's next byte
        for k in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-left, -k, "right"))
            row, up, down, place = row[:live], up[:live], down[:live], place[:live]
            run, longer = self.step(row)
            for match, border, near, sample in ((up, row == self.heads[run], self.above, self.at_last), (down, row == self.lasts[run], self.below, self.at_head)):
                match += 1
                at = np.flatnonzero(border)
                other = near[run[at]]
                match[at] = 0
                at, other = at[other >= 0], other[other >= 0]
                match[at] = 1 + self.common(place[at], sample[other])
            place = place - 1
            if k >= self.depth:
                found[to[:live] - k] = np.maximum(up, down) >= self.depth
            row = longer
        return np.split(found, base[1:-1])


def repeats_in(texts: list[bytes], weights: list[int], depth: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of each of the different texts the ranges (first, last + 1) of places whose `depth` bytes occur twice or more in all
    texts. A text that occurs more than once is one such range."""
    out = [[(0, len(t) - depth + 1)] if w > 1 and len(t) >= depth else [] for t, w in zip(texts, weights)]
    once = np.flatnonzero(np.array(weights) == 1)
    if len(once):
        for k, f in zip(once.tolist(), RunLengthIndex.build(texts, depth).repeated(once)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
            out[k] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


_PLACES = pa.schema([("seed", pa.int64()), ("segment", pa.int64()), ("text", pa.int64()), ("size", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
_RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def places(docs: DataFrame) -> DataFrame:
    """seed, segment digest, text hash and size, start and length of every segment of every row."""

    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            for at in range(0, b.num_rows, 500):
                cols = [[], [], [], [], [], []]
                for data in text_bytes(b.column(0).slice(at, 500)):
                    seed, start, end = segments(data)
                    if len(seed):
                        cols[0].append(seed)
                        cols[1].append(np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(start.tolist(), end.tolist())], np.uint64).view(np.int64))
                        cols[2].append(np.full(len(seed), text_key(data), np.int64))
                        cols[3].append(np.full(len(seed), len(data), np.int32))
                        cols[4].append(start.astype(np.int32))
                        cols[5].append((end - start).astype(np.int32))
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], schema=_PLACES)

    return docs.select("text").mapInArrow(run, "seed long, segment long, text long, size int, start int, length int")


def _fetched(docs: DataFrame, wanted: DataFrame, copies: DataFrame) -> DataFrame:
    """seed, segment, weight and bytes of the wanted(seed, segment, weight, text, size, start, length), each from one text
    or a few copies of it. copies: text, size and n of texts that occur more than once."""
    by_text = wanted.groupBy("text", "size").agg(F.collect_list(F.struct("seed", "segment", "weight", "start", "length")).alias("list"))
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    keyed = texts.mapInArrow(_with_key, "data binary, text long, size int, turn int")
    met = join_salted(keyed, by_text, ["text", "size"], copies, F.col("turn"))

    def run(batches):
        done: set[tuple[int, int]] = set()
        for b in batches:
            for data, items, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if key in done:  # a copy of a text that this task has had
                    continue
                done.add(key)
                rows = [(x["seed"], x["segment"], x["weight"], data[x["start"] : x["start"] + x["length"]]) for x in items]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["seed", "segment", "weight", "data"]).cast(pa.schema([("seed", pa.int64()), ("segment", pa.int64()), ("weight", pa.int64()), ("data", pa.binary())]))

    return met.select("data", "list", "text", "size").mapInArrow(run, "seed long, segment long, weight long, data binary")


def _turns(n: int) -> pa.Array:
    """Numbers that deal copies out: rows in turn."""
    return pa.array(np.arange(n, dtype=np.int32))


def _with_key(batches):
    for b in batches:
        data = [x or b"" for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_key(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int32()), _turns(len(data))], names=["data", "text", "size", "turn"])


def _indexed(batches):
    """Ranges of each segment by run-length indexes over whole seeds; rows come sorted by seed and segment."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def answer():
        # the same segment may come from several texts that share a hash and rows that are repeated
        distinct = list({(s, g): (s, g, w, d) for s, g, w, d in held}.values())
        ranges = repeats_in([d for *_, d in distinct], [w for _, _, w, _ in distinct])
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in distinct], pa.int64()), pa.array([x[1] for x in distinct], pa.int64()), pa.array([[{"first": i, "last": j} for i, j in r] for r in ranges], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
            names=["seed", "segment", "ranges"],
        )

    np.seterr(over="ignore")
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if size >= INDEX_BYTES and row[0] != held[-1][0]:
                yield answer()
                held, size = [], 0
            held.append(row)
            size += len(row[3]) + 1
    if held:
        yield answer()


def _finer(gram: int):
    """A function of segments' bytes (seed, segment, data) that gives their segments by longer grams: offset and length in
    them, the finer seed and the finer segment's digest."""

    def run(batches):
        np.seterr(over="ignore")
        for b in batches:
            for seed, segment, data in zip(*(c.to_pylist() for c in b.columns)):
                fine, start, end = segments(data, LENGTH, gram)
                digests = np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(start.tolist(), end.tolist())], np.uint64).view(np.int64)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, seed, np.int64)), pa.array(np.full(n, segment, np.int64)), pa.array(fine), pa.array(digests), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))],
                    names=["seed", "segment", "fine", "part", "offset", "part_length"],
                )

    return run


def _level(docs: DataFrame, found: DataFrame, copies: DataFrame, gram: int, finer: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Of places of segments by one length of gram the ranges of repeats (text, size, start, length and ranges), and the
    places of the finer segments of seeds that are too large."""
    often = cut(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "substrings-often")
    met = cut(join_salted(found, often.select("seed"), ["seed"], often, F.xxhash64("segment", "text", "start")), "substrings-met")
    kinds = cut(met.groupBy("seed", "segment").agg(F.count("*").alias("weight"), F.min(F.struct("text", "size", "start", "length")).alias("one")), "substrings-segments")
    several = cut(kinds.groupBy("seed").agg(F.count("*").alias("kinds"), F.sum("one.length").alias("bytes")).where("kinds > 1"), "substrings-several")
    large = F.col("bytes") > GROUP_BYTES if finer else F.lit(False)
    mixed = join_salted(kinds, several, ["seed"], several.select("seed", F.col("kinds").alias("n")), F.col("segment")).select("seed", "segment", "weight", "one.*", large.alias("large"))
    mixed = cut(mixed, "substrings-mixed")
    usual = _fetched(docs, mixed.where("not large"), copies)
    ranges = usual.repartition("seed").sortWithinPartitions("seed", "segment").mapInArrow(_indexed, T.StructType([T.StructField("seed", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("ranges", _RANGES)]))
    # segments that occur twice or more are repeats from end to end; those of seeds without others need no index
    whole = F.array(F.struct(F.lit(0).cast("int").alias("first"), (F.col("one.length") - LENGTH + 1).cast("int").alias("last")))
    alone = kinds.where("weight > 1").join(several.select("seed"), "seed", "left_anti").select("seed", "segment", whole.alias("ranges"))
    ranges = cut(ranges.where(F.size("ranges") > 0).unionByName(alone), "substrings-ranges")
    of_segment = kinds.select("seed", "segment", F.col("weight").alias("n"))
    places_of = met.select("seed", "segment", "text", "size", "start").distinct()
    spans = join_salted(places_of, ranges, ["seed", "segment"], of_segment, F.xxhash64("text", "start")).select("text", "size", "start", "ranges")
    if not finer or not mixed.where("large").limit(1).count():
        return spans, None
    bytes_of = _fetched(docs, mixed.where("large"), copies).dropDuplicates(["seed", "segment"]).select("seed", "segment", "data")
    parts = cut(bytes_of.mapInArrow(_finer(finer), "seed long, segment long, fine long, part long, offset int, part_length int"), "substrings-finer")
    # a segment of LENGTH-byte windows has few parts, so they go with it as one row
    lists = parts.groupBy("seed", "segment").agg(F.collect_list(F.struct("fine", "part", "offset", "part_length")).alias("parts"))
    again = join_salted(met, lists, ["seed", "segment"], of_segment, F.xxhash64("text", "start")).select("text", "size", "start", F.explode("parts").alias("p"))
    return spans, cut(again.select(F.col("p.fine").alias("seed"), F.col("p.part").alias("segment"), "text", "size", (F.col("start") + F.col("p.offset")).alias("start"), F.col("p.part_length").alias("length")), "substrings-places")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """text hash and size with spans (start, end) of the bytes to remove, of the texts that have any; and the texts that
    occur more than once (text, size, n), of those that have a window."""
    found = cut(places(docs), "substrings-places")
    # the first segment of every text begins at 0
    copies = cut(found.where("start = 0").groupBy("text", "size").agg(F.count("*").alias("n")).where("n > 1"), "substrings-copies")
    spans: DataFrame | None = None
    for gram, finer in zip(GRAMS, [*GRAMS[1:], None]):
        here, found = _level(docs, found, copies, gram, finer)
        spans = here if spans is None else spans.unionByName(here)
        if found is None:
            break
    spans = spans.select("text", "size", F.explode(F.transform("ranges", lambda r: F.struct((F.col("start") + r["first"]).alias("start"), (F.col("start") + r["last"] - 1 + LENGTH).alias("end")))).alias("span"))
    return spans.groupBy("text", "size").agg(F.array_sort(F.collect_list("span")).alias("spans")), copies


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans (start, end) removed, of each row."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        gone, copies = removals(docs)
        gone, copies = keep(cut(gone, "substrings-removals")), keep(copies)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    id_kind = docs.schema["doc_id"]
    keyed = rows.mapInArrow(_row_keys, T.StructType([id_kind, T.StructField("data", T.BinaryType()), T.StructField("text", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("turn", T.IntegerType())]))
    met = join_salted(keyed, gone, ["text", "size"], copies, F.col("turn"), "left").select("doc_id", "data", "spans")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                merged: list[list[int]] = []
                for s in spans or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                h, at = hashlib.sha256(), 0
                for i, j in merged:
                    h.update(data[at:i])
                    at = j
                h.update(data[at:])
                for c, v in zip(cols, (len(data), sum(j - i for i, j in merged), len(merged), h.hexdigest(), [{"start": i, "end": j} for i, j in merged])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return met.mapInArrow(run, T.StructType([id_kind, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]))


def _row_keys(batches):
    for b in batches:
        data = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text_key(x) for x in data], pa.int64()), pa.array([len(x) for x in data], pa.int32()), _turns(len(data))], names=["doc_id", "data", "text", "size", "turn"])
