"""Language-model scoring by online logistic context mixing.

A text's tokens (words in lower case, then one end) are coded as bits: a token of the vocabulary (the VOCABULARY most
frequent ones) by its whole Huffman code, any other by the code of an escape and then byte by byte with codes that depend
on the byte before. Each bit of a code is predicted in several contexts (the code's node alone, with one, two and three
tokens before), whose counts come from all training texts.
Predictions are mixed in the logistic domain by weights that a gate picks from the contexts' counts. The
mixing is online: bits stream past, STEP_BITS at a time are mixed by the weights of their gates as they are and, where
their text is learned from, refine them then. As in any online model no bit is predicted by itself: a training token takes itself out
of the counts that predict it, so texts that are learned from and held-out texts are scored alike, and a text that
occurs twice is predicted by its copy. Bits of spelling are mixed over the contexts of one, two and three bytes before,
by weights that were refined over all training words outside of the vocabulary.

The contexts' counts are exact and grow with the input, so no task holds them all: tokens are dealt out by the token
before, about PART_TOKENS to a part; each part counts its own contexts, mixes and costs its tokens, and the
costs go back to the texts' blocks, where they are summed. Tokens of a context that is more frequent than half a part are
dealt out further, by the second token before, by the third, by the texts' block, so no single context's gather in one
task. The counts of such a context are summed beside that, by symbol, and come to all parts that hold tokens of it: how
tokens are dealt changes no count. Costs travel in steps of 1 / STEPS bit.
Bytes of words outside of the vocabulary are predicted by hashed contexts, counted over all distinct training words
outside of the vocabulary; the tables grow with the number of these words, up to BYTE_DOUBLINGS times.
Total bits over bytes are given as bits_per_byte.

Learning covers every row with crc32(doc_id as text) mod 10 other than 0. The base score uses the exact counts of all
training tokens: those of the COUNTED most frequent words (a bounded table) where the text is read, of others by a join.

Defined results: null and empty texts are the end alone; very long texts are scored whole; repeated rows count each and
have equal scores as long as they are not dealt out by block, where weights may differ; rows without doc_id are training rows that are scored as
well; an empty table gives an empty result; columns beside doc_id and text are not read. Without training rows base
counts are 0 and bits come from flat codes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, doc_bucket, scratch

VOCABULARY, LEAST_COUNT, COUNTED = 400_000, 3, 400_000
#: Tokens of a part of the counts, about, and the most tasks that the parts are dealt to.
PART_TOKENS, TASKS = 1 << 18, 4096
#: Tokens of a part that are mixed at a time, about; weights go on from one such piece to the next.
PIECE_TOKENS = 1 << 15
#: Text bytes of a block at least; blocks grow with the parts, so that a block has tokens enough for each.
BLOCK_BYTES = 1 << 21
#: Text bytes whose words are parted and looked for at once, where blocks are smaller.
LOOKED_FOR = 1 << 23
#: Steps of a token's cost that travels, in a bit.
STEPS = 128
#: log2 of the least slots of the tables of bytes by 2 and 3 before, and how many times over they may double.
BYTE_BITS, BYTE_DOUBLINGS = (15, 17), 6
#: Of so many training tokens one shows which pairs and triples are frequent; that decides how they are dealt alone.
SAMPLED = 256
#: Frequent contexts' counts are summed in so many shares.
SHARES = 16
_ZSTD = pa.Codec("zstd", 1)
#: Pseudo-counts of the shorter context in that of one token, of two, of three; of two and three bytes.
BACKOFF, BYTE_BACKOFF = (4.0, 1.0, 2.0), (8.0, 4.0)
#: Bits that are mixed before they refine the weights, share of the mean of what they ask for that is done, and how many
#: bits of a gate half of that takes.
STEP_BITS, RATE, STEADY, BIAS = 8192, 0.05, 8.0, 0.3
#: Counts and counts of ones share a number: ones above so many bits.
ALL = 32
END = b""
EOW = 256
#: First weights of the predictions, shorter contexts first, then the bias.
FIRST_WEIGHTS, FIRST_BYTE_WEIGHTS = (0.0, 0.7, 0.4, 0.0), (0.1, 0.3, 0.6, 0.0)


@dataclass
class Code:
    """Whole codes of symbols: nodes and bits of each, their number, each node's chance of a one, and the symbols' places
    from one end of the tree to the other."""

    node: np.ndarray
    bit: np.ndarray
    length: np.ndarray
    one: np.ndarray
    rank: np.ndarray
    tree: tuple[np.ndarray, np.ndarray] | None = None
    steps: list[np.ndarray] = field(default_factory=list)
    begin: np.ndarray | None = None
    flat: np.ndarray | None = None
    zero: np.ndarray | None = None
    spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def huffman(cls, weights: list[int]) -> Code:
        n = len(weights)
        # leaves by weight in one row, inner nodes in another: the lightest is at the head of either
        leaves = sorted(range(n), key=weights.__getitem__)
        total, left, right = list(weights), [0] * n, [0] * n
        leaf = inner = 0

        def lightest() -> int:
            nonlocal leaf, inner
            if leaf < n and (n + inner >= len(total) or weights[leaves[leaf]] <= total[n + inner]):
                leaf += 1
                return leaves[leaf - 1]
            inner += 1
            return n + inner - 1

        for _ in range(n - 1):
            i, j = lightest(), lightest()
            left.append(i)
            right.append(j)
            total.append(total[i] + total[j])
        # from the leaves up: inner nodes are numbered from the root on
        size, sums = len(total), np.array(total, np.float64)
        up, right_of = np.full(size, -1), np.zeros(size, np.int8)
        inner_nodes = np.arange(n, size)
        up[left[n:]] = up[right[n:]] = inner_nodes
        right_of[right[n:]] = 1
        one = (sums[right[n:]] / sums[n:])[::-1].astype(np.float32)
        return cls.of_tree(up.astype(np.int32), right_of, one if n > 1 else np.array([0.5], np.float32))

    @classmethod
    def of_tree(cls, up: np.ndarray, right_of: np.ndarray, one: np.ndarray) -> Code:
        """Codes of a tree: the node above each leaf and inner node (-1: none), which are ones, and the inner nodes' chances
        from the root on. That is all that travels of a large code."""
        size = len(up)
        n = (size + 1) // 2
        length, at = np.zeros(n, np.int32), np.arange(n)
        trail = []
        while True:
            above = up[at]
            if (above < 0).all():
                break
            length += above >= 0
            trail.append((above, right_of[at]))
            at = np.where(above < 0, at, above)
        depth = len(trail)
        node, bit = np.zeros((n, depth), np.int32), np.zeros((n, depth), np.int8)
        for k, (above, side) in enumerate(trail):
            here = np.flatnonzero(above >= 0)
            node[here, length[here] - 1 - k], bit[here, length[here] - 1 - k] = size - 1 - above[here], side[here]
        rank = np.empty(n, np.int32)
        rank[np.lexsort(bit.T[::-1])] = np.arange(n)
        return cls(node, bit, length, one, rank, (up, right_of))

    def in_a_row(self) -> np.ndarray:
        """Node and bit in one number, of all codes in one row; the same by symbol and depth is given back."""
        both = self.node * 2 + self.bit
        self.begin = np.cumsum(self.length, dtype=np.int64) - self.length
        self.flat = both[np.arange(both.shape[1]) < self.length[:, None]]
        return both

    def bits(self, symbol: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and bits of symbols' codes in one row; length, first: number and place of each symbol's bits."""
        at = np.repeat((self.begin[symbol] - first).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        x = self.flat.take(at)
        return x >> 1, x & 1

    def lay_out(self) -> None:
        """Node and bit in one number: by depth of the code, and of all codes in one row."""
        self.steps = list(np.ascontiguousarray(self.in_a_row().T))
        np.clip(self.one, 1e-6, 1 - 1e-6, out=self.one)
        self.zero = 1 - self.one
        # of each node the first place of its symbols, of those with a one, and the place after the last
        first, ones, after = (np.zeros(len(self.one), np.int32) for _ in range(3))
        line = np.argsort(self.rank)
        for d, step in enumerate(self.steps):
            here = np.flatnonzero(self.length[line] > d)
            x = step[line[here]]
            begin = np.flatnonzero(np.diff(x, prepend=-1))
            node, bit, stop = x[begin] >> 1, x[begin] & 1, np.append(here[begin[1:] - 1], here[-1:]) + 1
            zeros = bit == 0
            first[node[zeros]], ones[node[zeros]] = here[begin[zeros]], stop[zeros]
            after[node[~zeros]] = stop[~zeros]
        self.spans = first, ones, after


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = (context + node * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64)


class Coder:
    """The vocabulary and its codes; the same for training and scoring."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int):
        """words: by falling count, the end among them. total: of all training tokens, distinct: of different ones."""
        self.index = {w: k for k, w in enumerate(words)}
        self.counts = np.array([*counts, 0], np.int64)
        self.known = min(sum(n >= LEAST_COUNT for n in counts), VOCABULARY)
        head = counts[: self.known]
        self.escape = self.known
        # the end has a code even if nothing was learned
        self.end = self.index.get(END, self.known + 1)
        self.end = self.end if self.end < self.known else self.known + 1
        weights = [*head, max(1, total - sum(head))] + ([1] if self.end == self.known + 1 else [])
        self.tokens = Code.huffman(weights if len(weights) > 1 else [1, 1])
        self.tokens.lay_out()
        #: how often a token before comes in training
        often = np.zeros(self.known + 2, np.int64)
        often[: self.known] = head
        often[self.escape] = total - sum(head)
        self.often = often
        # as many times wider as the words outside of the vocabulary are more than 2^16
        wider = min(BYTE_DOUBLINGS, max(0, (max(0, distinct - self.known) >> 16).bit_length()))
        self.byte_table_bits = [b + wider for b in BYTE_BITS]
        self.offsets = np.concatenate([[0], np.cumsum([2 << b for b in self.byte_table_bits])])
        # every byte after the one before, over all counted words with an end of word around each
        sizes = np.array([len(w) + 1 for w in words if w], np.int64)
        line = np.full(int(sizes.sum()) + 1, EOW, np.int64)
        inside = np.ones(len(line), bool)
        inside[np.concatenate([[0], np.cumsum(sizes)])] = False
        line[inside] = np.frombuffer(b"".join(words), np.uint8)
        pairs = 1 + 8 * np.bincount(line[:-1] * 257 + line[1:], minlength=257 * 257).reshape(257, 257)
        codes = [Code.huffman(row) for row in pairs.tolist()]
        base = np.concatenate([[0], np.cumsum([len(c.one) for c in codes])[:-1]])
        depth = max(c.node.shape[1] for c in codes)
        wide = lambda x: np.pad(x, ((0, 0), (0, depth - x.shape[1])))
        self.bytes = Code(
            np.concatenate([wide(c.node + b) for c, b in zip(codes, base)]).astype(np.int32), np.concatenate([wide(c.bit) for c in codes]), *[np.concatenate([getattr(c, k) for c in codes]) for k in ("length", "one", "rank")]
        )
        self.bytes.in_a_row()
        self.bytes.node = self.bytes.bit = None

    def __getstate__(self) -> dict:
        tree = (*self.tokens.tree, self.tokens.one)
        return {**{k: v for k, v in self.__dict__.items() if k != "tokens"}, "travelled": tree, "index": list(self.index)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.index = {w: k for k, w in enumerate(state["index"])}

    @cached_property
    def tokens(self) -> Code:
        """The tokens' codes where the coder has travelled: most of its bytes, laid out only by who asks."""
        code = Code.of_tree(*self.travelled)
        code.lay_out()
        code.node = code.bit = None
        return code

    def without_words(self) -> Coder:
        """The codes alone, for those who meet no words, or only words outside of the vocabulary."""
        light = Coder.__new__(Coder)
        light.__dict__ |= {**self.__dict__, "index": {}, "counts": self.counts[:0], "often": self.often[:0]}
        return light

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def symbols(self, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The vocabulary symbols of documents' tokens. sizes: tokens of each document, its end the last."""
        symbol = np.where((number >= 0) & (number < self.known), number, self.escape)
        symbol[np.cumsum(sizes) - 1] = self.end
        return symbol

    def contexts(self, symbol: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The token before each, the one before that, and the one before those. begin: documents' first tokens."""
        out, now = [], symbol
        for _ in range(3):
            now = np.concatenate([[self.end], now[:-1]])
            now[begin] = self.end
            out.append(now)
        return tuple(out)

    def token_bits(self, symbol: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and bits of all tokens' codes in one row; length, first: number and place of each token's bits."""
        return self.tokens.bits(symbol, length, first)

    def byte_bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The same for words spelled by bytes, with the bits of each word."""
        sizes = np.array([len(w) + 1 for w in words])
        stop = np.cumsum(sizes)
        flat = np.full(int(stop[-1]), EOW, np.int64)
        inside = np.ones(len(flat), bool)
        inside[stop - 1] = False
        flat[inside] = np.frombuffer(b"".join(words), np.uint8)
        begin = stop - sizes
        back = [np.concatenate([np.full(1, EOW), flat[:-1]])]
        back[0][begin] = EOW
        for _ in range(2):
            x = np.concatenate([np.full(1, EOW), back[-1][:-1]])
            x[begin] = EOW
            back.append(x)
        sym = back[0] * 257 + flat
        n = self.bytes.length[sym]
        node, bit = self.bytes.bits(sym, n, np.cumsum(n) - n)
        u, context, slots = node.astype(np.uint32), np.zeros(len(flat), np.uint32), []
        # the nodes are of the byte before already
        for b, bits in zip(back[1:], self.byte_table_bits):
            context = (context + b.astype(np.uint32) + np.uint32(1)) * np.uint32(0x27D4EB2F)
            slots.append(_slots(np.repeat(context, n), u, bits))
        return node, bit, slots, np.add.reduceat(n, begin)


class Dealing:
    """Which part each token goes to. Tokens of a frequent token before have several slots: that of the second token
    before, from there on those of the third where the pair is frequent, from there on those of the block where the
    triple is. A context of all tokens of which no slot holds has a number: level << LEVEL and its place."""

    LEVEL = 28

    def __init__(self, often: np.ndarray, pairs: dict[tuple[int, int], int], triples: dict[tuple[int, int, int], int], parts: int):
        """often: of tokens before; pairs, triples: about how often frequent ones come, the token before first."""
        half, self.parts = max(1, PART_TOKENS // 2), parts
        self.slots = np.maximum(1, -(-often // half))
        share = lambda most, n: min(int(most), -(-n // half))
        held = sorted((b << 20 | s, share(self.slots[b], n)) for (b, s), n in pairs.items() if n > half and self.slots[b] > 1)
        self.pairs, self.pair_slots = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        place = {k: i for i, (k, _) in enumerate(held)}
        at = [(place.get(b << 20 | s), t, n) for (b, s, t), n in triples.items() if n > half]
        held = sorted((pair << 20 | t, share(self.pair_slots[pair], n)) for pair, t, n in at if pair is not None)
        self.triples, self.triple_slots = (np.array([x[k] for x in held], np.int64) for k in (0, 1))

    @property
    def any(self) -> bool:
        return bool((self.slots > 1).any())

    @staticmethod
    def _find(held: np.ndarray, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(held, key), len(held) - 1)
        return np.where(held[at] == key, at, -1)

    def marks(self, before: np.ndarray, second: np.ndarray, third: np.ndarray) -> list[np.ndarray]:
        """Of each token the places of its contexts of one, two and three tokens among the frequent ones, -1 for others."""
        out = [np.where(self.slots[before] > 1, before, -1).astype(np.int64)]
        for held, last in ((self.pairs, second), (self.triples, third)):
            mark = np.full(len(before), -1, np.int64)
            here = np.flatnonzero(out[-1] >= 0) if len(held) else []
            if len(here):
                mark[here] = self._find(held, out[-1][here] << 20 | last[here])
            out.append(mark)
        return out

    def part(self, before: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return _mixed_bits(before + (slot % self.slots[before] + 1) * 1_000_003) % self.parts

    def deal(self, before: np.ndarray, second: np.ndarray, third: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Part of each token, and its marks."""
        marks = self.marks(before, second, third)
        slot = np.zeros(len(before), np.int64)
        here = np.flatnonzero(marks[0] >= 0)
        slot[here] = _mixed_bits(second[here]) % self.slots[before[here]]
        # a pair's slots follow each other, and those of a triple lie among the pair's
        here = np.flatnonzero(marks[1] >= 0)
        many = self.pair_slots[marks[1][here]]
        turn, of_triple = _mixed_bits(third[here]) % many, np.flatnonzero(marks[2][here] >= 0)
        turn[of_triple] += int(_mixed_bits(np.array([block]))[0]) % self.triple_slots[marks[2][here[of_triple]]]
        slot[here] += turn % many
        return self.part(before, slot), marks

    def counted(self, marks: list[np.ndarray], symbol: np.ndarray, taught: np.ndarray) -> dict[int, np.ndarray]:
        """Of learned tokens how often each symbol comes in each frequent context, by the part that sums it: rows of
        context, symbol and count."""
        found = []
        for level, mark in enumerate(marks):
            here = np.flatnonzero((mark >= 0) & taught)
            key, n = np.unique((level << self.LEVEL | mark[here]) << 20 | symbol[here], return_counts=True)
            found.append(np.stack([key >> 20, key & 0xFFFFF, n]))
        rows = np.concatenate(found, 1).astype(np.int32)
        to = _mixed_bits(rows[0].astype(np.int64) * SHARES + rows[1] % SHARES) % self.parts
        order = np.argsort(to, kind="stable")
        edge = np.flatnonzero(np.diff(to[order], prepend=-1))
        return {int(to[order[a]]): rows[:, order[a:b]] for a, b in zip(edge, np.append(edge[1:], len(order)))}

    def holders(self, context: int) -> list[int]:
        """The parts that may hold tokens of a frequent context."""
        level, place = context >> self.LEVEL, context & ((1 << self.LEVEL) - 1)
        if level == 0:
            before, slot = place, np.arange(self.slots[place])
        else:
            pair = place if level == 1 else int(self.triples[place] >> 20)
            before, second = int(self.pairs[pair] >> 20), self.pairs[pair : pair + 1] & 0xFFFFF
            many = self.pair_slots[pair]
            turn = np.arange(many)
            if level == 2:
                turn = (_mixed_bits(self.triples[place : place + 1] & 0xFFFFF) % many + np.arange(self.triple_slots[place])) % many
            slot = _mixed_bits(second) % self.slots[before] + turn
        return np.unique(self.part(np.full(len(slot), before), slot)).tolist()


def summed_rows(found: list[np.ndarray]) -> np.ndarray:
    """Rows of context, symbol and count with equal ones summed, in order."""
    rows = np.concatenate(found, 1).astype(np.int64) if found else np.zeros((3, 0), np.int64)
    key = rows[0] << 20 | rows[1]
    order = np.argsort(key)
    edge = np.flatnonzero(np.diff(key[order], prepend=-1))
    n = np.add.reduceat(rows[2][order], edge) if len(edge) else rows[2]
    return np.stack([key[order][edge] >> 20, key[order][edge] & 0xFFFFF, n])


def path_counts(code: Code, context: np.ndarray, symbol: np.ndarray, taught: np.ndarray, counts: np.ndarray, first: np.ndarray, less: np.ndarray | None = None) -> None:
    """For each bit of the tokens' codes in one row: how often training tokens of the same context came to its node and had
    a one there; both in one number of counts, ones above ALL. counts holds what a token counts by itself before. taught:
    training tokens that each of the rows stands for; first: place of each token's first bit; less: tokens of each row that
    don't count for itself, taken off already where it counts by itself."""
    # in order of context and place in the tree the tokens of a node lie side by side
    order = np.argsort(context << 20 | code.rank[symbol])
    s, c, t, at = symbol.take(order), context.take(order), taught.take(order), first.take(order)
    off = less.take(order) if less is not None else None
    fresh = np.ones(len(s) + 1, bool)
    np.not_equal(c[1:], c[:-1], out=fresh[1:-1])
    for d, step in enumerate(code.steps):
        x = step.take(s)
        if d:
            fresh[1:-1] |= (x[1:] ^ x[:-1]) > 1
        # a token alone at a node is alone at all below; one whose code ends here goes as well
        # (the root is the only node 0, beyond its end a code has zeros)
        live = ~(fresh[:-1] & fresh[1:])
        if d:
            live &= x > 1
        kept = np.flatnonzero(live)
        if not len(kept):
            break
        if len(kept) < len(s):
            group = np.cumsum(fresh[:-1], dtype=np.int32).take(kept)
            s, t, at, x = s.take(kept), t.take(kept), at.take(kept), x.take(kept)
            off = off.take(kept) if off is not None else None
            fresh = np.ones(len(s) + 1, bool)
            np.not_equal(group[1:], group[:-1], out=fresh[1:-1])
        begin = np.flatnonzero(fresh[:-1])
        # a token of the bit in both counts, of ones and of all
        unit = (x & 1).astype(np.int64) << ALL
        unit += 1
        sums = np.repeat(np.add.reduceat(t * unit, begin), np.diff(begin, append=len(s)))
        if off is not None:
            sums -= off * unit
        counts[at + d] = sums


def refined(x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weights: np.ndarray, learn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each bit, and the weights of each gate in the end. Bits are mixed STEP_BITS at a time by the weights of
    their gates, which they then refine: by the mean of what each asks for (nothing, where learn is given and 0). x: the
    predictions, but for the bias."""
    n, gates, bias = len(bit), len(weights), np.float32(BIAS)
    cost, w = np.empty(n, np.float32), [v.copy() for v in weights.T.astype(np.float32)]
    which, one = gate.astype(np.intp), bit.astype(np.float32)
    for k in range(0, n, STEP_BITS):
        at = slice(k, min(n, k + STEP_BITS))
        g, xs, b = which[at], [v[at] for v in x], one[at]
        z = w[-1].take(g)
        z *= bias
        for v, u in zip(xs, w):
            z += v * u.take(g)
        np.minimum(z, _MOST, out=z)
        np.maximum(z, -_MOST, out=z)
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += np.float32(1)
        np.reciprocal(z, out=z)
        e = b - z
        # the chance that was given to the bit as it came
        np.abs(e, out=z)
        np.log2(np.float32(1) - z, out=cost[at])
        if learn is not None:
            e *= learn[at]
        step = RATE / (np.bincount(g, learn[at] if learn is not None else None, gates) + STEADY)
        for v, u in zip(xs, w):
            u += np.bincount(g, e * v, gates) * step
        w[-1] += np.bincount(g, e, gates) * (step * BIAS)
    return np.negative(cost, out=cost), np.stack(w, 1)


def first_weights() -> np.ndarray:
    return np.tile(np.array(FIRST_WEIGHTS, np.float32), (36, 1))


def mixed(x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Cost of each bit by given weights of its gate."""
    *w, bias = np.ascontiguousarray(weights.T)
    gate = gate.astype(np.intp)
    z = bias.take(gate) * np.float32(BIAS)
    for v, u in zip(x, w):
        z += v * u.take(gate)
    np.minimum(z, _MOST, out=z)
    np.maximum(z, -_MOST, out=z)
    # towards the bit as it came
    np.negative(z, out=z, where=bit.astype(bool))
    np.exp(z, out=z)
    z += np.float32(1)
    return np.log2(z, out=z)


def token_costs(coder: Coder, before: np.ndarray, second: np.ndarray, third: np.ndarray, kind: np.ndarray, symbol: np.ndarray, taught: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each token without spelling, and the refined weights. kind: class of the context, 40 bits at most; all tokens of a token before and
    class must be given together."""
    order = np.lexsort((kind, before))
    new = np.ones(len(order), bool)
    new[1:] = (before[order][1:] != before[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    one = np.empty(len(order), np.int64)
    one[order] = np.cumsum(new) - 1
    two, last = _numbered(one << 20 | second), _numbered(one << 32 | third)
    order = np.lexsort((last, two << 21 | symbol.astype(np.int64) << 1 | taught))
    one, two, last, symbol, taught = (a.astype(np.int64)[order] for a in (one, two, last, symbol, taught))
    new = np.ones(len(order), bool)
    new[1:] = (two[1:] != two[:-1]) | (last[1:] != last[:-1]) | (symbol[1:] != symbol[:-1]) | (taught[1:] != taught[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(begin, append=len(order))
    cost, weights = row_costs(coder, [x[begin] for x in (one, two, last)], symbol[begin], taught[begin], times, weights)
    out = np.empty(len(order))
    out[order] = np.repeat(cost, times)
    return out, weights


def row_costs(
    coder: Coder, contexts: list[np.ndarray], symbol: np.ndarray, taught: np.ndarray, times: np.ndarray, weights: np.ndarray, marks: list[np.ndarray] | None = None, given: Given | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each row, and the refined weights. A row: times tokens alike in all; contexts: numbers of theirs of one, two
    and three tokens. marks: numbers of contexts whose counts are given, or -1. Rows have an order of their own, so that neither blocks nor partitions change what the weights see, and
    are shuffled here."""
    shuffle = np.random.default_rng(5).permutation(len(symbol))
    symbol, taught, times = symbol.take(shuffle).astype(np.int32), taught.take(shuffle).astype(np.int32), times.take(shuffle).astype(np.int32)
    length = coder.tokens.length.take(symbol)
    stop = np.cumsum(length)
    first = (stop - length).astype(np.int32)
    node, bit = coder.token_bits(symbol, length, first)
    learn = np.repeat(taught.astype(np.float32), length)
    # a token alone in its context is predicted by its copies: a bit is not to be predicted by itself
    t = times * taught
    more = np.zeros(len(node), np.int64)
    again = np.flatnonzero(np.repeat(t > taught, length)) if (t > taught).any() else []
    if len(again):
        more[again] = np.repeat(t - taught, length)[again] * (1 + (bit[again].astype(np.int64) << ALL))
    # chances of a one and of a zero
    p, q, gate, x = coder.tokens.one.take(node), coder.tokens.zero.take(node), None, []
    for k, context in enumerate(contexts):
        context, counts = context.take(shuffle), more.copy()
        # a row alone in its context counts by itself
        number = context - context.min()
        counted = np.bincount(number).take(number) > 1
        if marks is not None and (marks[k] >= 0).any():
            mark = marks[k].take(shuffle)
            for m in np.unique(mark[mark >= 0]).tolist():
                rows = np.flatnonzero(mark == m)
                at = np.repeat(first.take(rows) - (np.cumsum(length.take(rows)) - length.take(rows)), length.take(rows)) + np.arange(int(length.take(rows).sum()))
                mine = np.repeat(taught.take(rows).astype(np.int64), length.take(rows))
                counts[at] = given.nodes(m).take(node.take(at)) - mine - ((mine * bit.take(at)) << ALL)
            counted &= mark < 0
        kept = np.flatnonzero(counted)
        path_counts(coder.tokens, number.take(kept), symbol.take(kept), t.take(kept), counts, first.take(kept), taught.take(kept))
        seen, ones = (half.astype(np.float32) for half in _halves(counts))
        if k < 2:
            gate = _level(seen) if k == 0 else gate * np.int8(6) + _level(seen)
        # contexts of more tokens fall back on that of one
        seen -= ones
        ones += np.float32(BACKOFF[k]) * p
        seen += np.float32(BACKOFF[k]) * q
        if k == 0:
            p = ones / (ones + seen)
            q = np.float32(1) - p
            np.maximum(q, np.float32(1e-6), out=q)
        ones /= seen
        x.append(np.log(ones, out=ones))
    cost, weights = refined(x, gate, bit, weights, learn)
    out = np.empty(len(symbol))
    out[shuffle] = np.add.reduceat(cost, first) if len(cost) else 0.0
    return out, weights


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All and ones of counts, without a copy."""
    both = counts.view(np.uint32).reshape(-1, 2)
    return (both[:, 0], both[:, 1]) if np.little_endian else (both[:, 1], both[:, 0])


class Given:
    """The counts of frequent contexts that have come from all parts: rows of context, symbol and count, in order."""

    def __init__(self, code: Code, rows: np.ndarray):
        self.code, self.rows = code, rows
        self.held: dict[int, tuple[int, np.ndarray]] = {}

    def nodes(self, context: int) -> np.ndarray:
        """Counts of every node of the code in a context, all and ones in one number. The last context of each level stays."""
        level = context >> Dealing.LEVEL
        if self.held.get(level, (None,))[0] != context:
            a, b = np.searchsorted(self.rows[0], [context, context + 1])
            line = np.zeros(len(self.code.rank) + 1, np.int64)
            line[self.code.rank[self.rows[1, a:b]] + 1] = self.rows[2, a:b]
            np.cumsum(line, out=line)
            first, ones, after = (line.take(x) for x in self.code.spans)
            self.held[level] = context, after - first + ((after - ones) << ALL)
        return self.held[level][1]


def _numbered(key: np.ndarray) -> np.ndarray:
    """Numbers from 0 of distinct keys, in their order."""
    order = np.argsort(key)
    held = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], held[1:] != held[:-1]]))
    return out


class Model:
    """Counts of ones and of all in every slot of the tables of bytes, as the parts of complex numbers."""

    def __init__(self, coder: Coder, counts: np.ndarray):
        self.coder = coder
        self.weights = np.tile(np.array(FIRST_BYTE_WEIGHTS, np.float32), (36, 1))
        self.spelled = np.zeros(0)
        pairs = [counts[a:b].reshape(-1, 2) for a, b in zip(coder.offsets, coder.offsets[1:])]
        self.pairs = [(p[:, 1] + 1j * p.sum(1)).astype(np.complex64) for p in pairs]

    def learned(self, weights: np.ndarray) -> None:
        """Takes the weights of bytes; then the bits of spelling the counted words beyond the vocabulary are known."""
        self.weights = weights
        rest = list(self.coder.index)[self.coder.known :]
        self.spelled = np.concatenate([self.word_bits(rest[k : k + 20_000]) for k in range(0, len(rest), 20_000)] or [np.zeros(0)])

    def byte_given(self, node: np.ndarray, bit: np.ndarray, slots: list[np.ndarray], alone: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Predictions of bits of bytes and their gates; alone: without the bits themselves, which were counted."""
        p, out, levels = self.coder.bytes.one[node], [], []
        out.append(_stretch(p))
        for pairs, at, b in zip(self.pairs, slots, BYTE_BACKOFF):
            # ones and all of a slot lie side by side, read at once
            both = pairs.take(at, mode="clip")
            ones, n = both.real, both.imag
            if alone:
                ones, n = np.maximum(ones - bit, 0), np.maximum(n - 1, 0)
            p = (ones + np.float32(b) * p) / (n + np.float32(b))
            out.append(_stretch(p))
            levels.append(_level(n).astype(np.int32))
        return out, levels[0] * 6 + levels[1]

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Bits of spelling each word."""
        node, bit, slots, n = self.coder.byte_bits(words)
        cost = mixed(*self.byte_given(node, bit, slots, False), bit, self.weights)
        # every word has bits: no code of a byte row is empty
        return np.add.reduceat(cost, np.cumsum(n) - n).astype(np.float64)

    def spelling_bits(self, words: list[bytes], word: np.ndarray, sizes: np.ndarray, number: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each document's words outside of the vocabulary. word: each token's place among words."""
        begin = np.cumsum(sizes) - sizes
        escaped = symbol == self.coder.escape
        counted = np.flatnonzero(escaped & (number >= 0))
        doc = lambda places: np.searchsorted(begin, places, "right") - 1
        total = np.bincount(doc(counted), self.spelled[number[counted] - self.coder.known], len(sizes)).astype(np.float64)
        others = np.flatnonzero(escaped & (number < 0))
        if len(others):
            distinct, which = np.unique(word[others], return_inverse=True)
            total += np.bincount(doc(others), self.word_bits([words[k] for k in distinct.tolist()])[which], len(sizes))
        return total


def _pack(x: np.ndarray) -> bytes:
    """Rows of numbers as one short string: bytes of equal weight together, compressed."""
    x = np.ascontiguousarray(x)
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, x.itemsize).transpose(0, 2, 1)).tobytes()
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)


def _planes(data: bytes, n: int) -> np.ndarray:
    """The rows of numbers that _pack was given."""
    return np.ascontiguousarray(_unpack(data).reshape(n, 4, -1).transpose(0, 2, 1)).view(np.int32)[:, :, 0]


def pack_costs(doc: np.ndarray, cost: np.ndarray) -> bytes:
    """Costs summed by document of a block."""
    total = np.bincount(doc, cost)
    met = np.flatnonzero(np.bincount(doc))
    return _pack(np.stack([np.diff(met, prepend=0), total[met].astype(np.int64)]).astype(np.int32))


def add_costs(total: np.ndarray, data: bytes) -> None:
    """Adds packed costs to a block's documents."""
    met, cost = _planes(data, 2)
    total[np.cumsum(met)] += cost


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5))
    return np.log(p / (1 - p))


#: A mixed prediction is kept so far from certainty that a bit costs 17 at most.
_MOST = np.float32(math.log(2**17 - 1))


def _level(n: np.ndarray) -> np.ndarray:
    """0: nothing seen, 1, 2, 3: up to 8, 4: up to 64, 5: more."""
    out = (n > 0).view(np.int8) + (n > 1).view(np.int8)
    for least in (2, 8, 64):
        out += (n > least).view(np.int8)
    return out


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Tokens of texts: the distinct words in lower case, the place of each token among these (an end's is behind them), and
    the tokens of each text."""
    # Arrow's kernels for ASCII take bytes as they are, and part at the same ones as bytes.split()
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    flat, edge = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    kept = pc.binary_length(flat).to_numpy() > 0
    # white space at a text's ends leaves empty words there
    if not kept.all():
        flat, edge = flat.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[edge]
    found = flat.dictionary_encode()
    sizes = np.diff(edge) + 1
    token = np.full(int(sizes.sum()), len(found.dictionary), np.int64)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = found.indices.to_numpy()
    return found.dictionary.view(pa.binary()), token, sizes


def _bytes_of(words: pa.Array) -> list[bytes]:
    """to_pylist() of many short words, none of them null."""
    stops = pc.binary_length(words).to_numpy().cumsum().tolist()
    data = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"")[0].as_py()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


def _slices(texts: pa.Array, most: int):
    """First row, the row after the last and bytes of each row, of rows of about `most` bytes together."""
    sizes = pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_pylist()
    first = size = 0
    for row, n in enumerate(sizes):
        size += n + 64
        if size >= most or row + 1 == len(sizes):
            yield first, row + 1, sizes[first : row + 1]
            first, size = row + 1, 0


def _groups(b: pa.RecordBatch, k: int, numbers: Callable[[list[bytes]], np.ndarray], most: int = 1 << 20):
    """(first row, distinct words, their numbers, each token's place among them, tokens and bytes of each row) of rows of
    about `most` bytes together. Words are looked for in some of these at once."""
    held: list[tuple[int, int, list[int]]] = []
    for of_rows in _slices(b.column(k), most):
        held.append(of_rows)
        start, stop = held[0][0], of_rows[1]
        if sum(sum(n) for *_, n in held) >= LOOKED_FOR or stop == b.num_rows:
            distinct, token, sizes = tokens_of(b.column(k).slice(start, stop - start))
            words, edge = [*_bytes_of(distinct), END], np.concatenate([[0], np.cumsum(sizes)])
            number = numbers(words)
            for first, after, n_bytes in held:
                o = slice(first - start, after - start)
                yield first, words, number, token[edge[o.start] : edge[o.stop]], sizes[o], n_bytes
            held = []


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(doc_bucket(F.col("doc_id"), 10) != 0, F.lit(True)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over the training rows; the empty word is the end. Of every SAMPLED th token the three before it are
    a row as well, the nearest last, with spaces between."""

    def run(batches):
        held: list[pa.Table] = []
        skip = 0

        def merged():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for b in batches:
            for start, stop, _ in _slices(b.column(0), LOOKED_FOR):
                words, token, sizes = tokens_of(b.column(0).slice(start, stop - start))
                begin = np.cumsum(sizes) - sizes
                at = np.arange(skip, len(token), SAMPLED)
                skip = (skip - len(token)) % SAMPLED
                within = at - begin[np.searchsorted(begin, at, "right") - 1]
                words = pa.concat_arrays([words, pa.array([END], pa.binary())])
                before = [words.take(pa.array(np.where(within >= back, token[at - back], len(words) - 1))) for back in (3, 2, 1)]
                held.append(pa.table([words, np.bincount(token, minlength=len(words))], names=["word", "n"]))
                held.append(pa.table([pc.binary_join_element_wise(*before, b" "), np.ones(len(at), np.int64)], names=["word", "n"]))
                if sum(x.num_rows for x in held) > 600_000:
                    held = [merged()]
                    if held[0].num_rows > 300_000:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held = []
        if held:
            yield from merged().to_batches(max_chunksize=1 << 16)

    return _training(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealing(sampled: DataFrame, shared: Shared, often: np.ndarray, parts: int) -> Dealing:
    """sampled: rows of word_counts with spaces."""
    if not (often > max(1, PART_TOKENS // 2)).any():
        return Dealing(often, {}, {}, parts)
    words = shared.coder

    def run(batches):
        c = words.value
        for b in batches:
            of = [w.split(b" ") for w in b.column(0).to_pylist()]
            symbol = lambda w: c.end if w == END else min(c.index.get(w, c.escape), c.escape)
            yield pa.RecordBatch.from_arrays([*(pa.array([symbol(w[k]) for w in of], pa.int32()) for k in (2, 1, 0)), b.column(1)], names=["b", "s", "t", "n"])

    found = cut(sampled.mapInArrow(run, "b int, s int, t int, n long").groupBy("b", "s", "t").agg(F.sum("n").alias("n")), "lm-frequent")
    least = max(1, PART_TOKENS // 2) // SAMPLED
    pairs, triples = (found.groupBy(*keys).agg((F.sum("n") * SAMPLED).alias("n")).where(F.col("n") > least * SAMPLED).collect() for keys in (("b", "s"), ("b", "s", "t")))
    return Dealing(often, {(r.b, r.s): r.n for r in pairs}, {(r.b, r.s, r.t): r.n for r in triples}, parts)


def _slot_rows(held: np.ndarray):
    for k in range(0, len(held), 1 << 16):
        at = np.flatnonzero(held[k : k + (1 << 16)])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at + k).astype(np.int32)), pa.array(held[k + at].astype(np.int64))], names=["slot", "n"])


class Shared:
    """The model in parts, each of which goes to the workers once and only to those that use it: the words with the codes,
    the codes alone, the tables of bytes, their weights."""

    def __init__(self, coder: Broadcast, codes: Broadcast, pairs: Broadcast | None = None, rest: Broadcast | None = None):
        self.coder, self.codes, self.pairs, self.rest = coder, codes, pairs, rest

    def model(self) -> Model:
        m = Model.__new__(Model)
        m.coder, m.pairs = (self.coder or self.codes).value, self.pairs.value
        m.weights, m.spelled = self.rest.value if self.rest else (np.tile(np.array(FIRST_BYTE_WEIGHTS, np.float32), (36, 1)), np.zeros(0))
        return m


def learn(counts: DataFrame) -> tuple[Shared, int, int]:
    """The codes and the tables of bytes, the number of training tokens and of distinct ones. Only the COUNTED most
    frequent words and the sums of the tables of bytes come to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(COUNTED).toArrow()
    coder = Coder(top["word"].to_pylist(), top["n"].to_pylist(), int(total), int(distinct))
    context = counts.sparkSession.sparkContext
    codes = context.broadcast(coder.without_words())
    # words outside of the vocabulary, which is the first words by falling count: workers need no list of it
    beyond = F.length("word") > 0
    if coder.known:
        n, word = top["n"][coder.known - 1].as_py(), top["word"][coder.known - 1].as_py()
        beyond &= (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(word)))
    spelled = counts.where(beyond).select("word")

    def spell(batches):
        np.seterr(over="ignore")
        c = codes.value
        # of the worker's large arrays only this one is as long as the tables
        held = np.zeros(c.offsets[-1], np.int32)
        for b in batches:
            words, at = b.column(0).to_pylist(), 0
            while at < len(words):
                size, to = 0, at
                while to < len(words) and size < 1 << 18:
                    size, to = size + len(words[to]) + 1, to + 1
                _, bit, slots, _ = c.byte_bits(words[at:to])
                for k, s in enumerate(slots):
                    np.add.at(held[c.offsets[k] : c.offsets[k + 1]], s.astype(np.intp) * 2 + bit, np.int32(1))
                at = to
        yield from _slot_rows(held)

    # words outside of the vocabulary teach their spelling once each
    rows = spelled.mapInArrow(spell, "slot int, n long")
    sums = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(coder.offsets[-1], np.float32)
    table[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    model = Model(coder, table)
    # a task that uses a part of these takes that alone along
    parts = Shared(context.broadcast(coder), codes, context.broadcast(model.pairs))
    without_words = Shared(None, codes, parts.pairs)

    def weigh(batches):
        np.seterr(over="ignore")
        m, held, size = without_words.model(), [], 0

        def row():
            node, bit, slots, _ = m.coder.byte_bits(held)
            x, gate = m.byte_given(node, bit, slots, True)
            used = np.bincount(gate, minlength=36)
            w = refined(x, gate, bit, m.weights)[1] * used[:, None]
            return pa.RecordBatch.from_arrays([pa.array(range(36), pa.int32()), pa.array(used), *(pa.array(w[:, k].astype(np.float64)) for k in range(4))], names=["gate", "used", "a", "b", "c", "d"])

        for b in batches:
            for w in b.column(0).to_pylist():
                held.append(w)
                size += len(w) + 1
                if size > 1 << 19:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    # the gates' weights, averaged by how often each was used
    rows = spelled.mapInArrow(weigh, "gate int, used long, a double, b double, c double, d double")
    weights = model.weights.copy()
    for r in rows.groupBy("gate").agg(*[F.sum(k).alias(k) for k in ("used", "a", "b", "c", "d")]).where("used > 0").collect():
        weights[r.gate] = np.array([r.a, r.b, r.c, r.d]) / r.used
    model.learned(weights)
    parts.rest = context.broadcast((model.weights, model.spelled.astype(np.float32)))
    return parts, int(total), int(distinct)


def _runs(batches):
    """(key, rows of the other columns) of rows in order of their first column."""
    key, held = None, []
    for b in batches:
        for k, *row in zip(*[x.to_pylist() for x in b.columns]):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def part_costs(coder: Coder, deal: Dealing, tokens: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """Cost of each token of a part in steps. tokens: before, second, third, symbol and whether they are learned from;
    given: summed rows of the frequent contexts."""
    before, second, third, symbol, taught = tokens
    context = before.astype(np.int64) << 40 | second.astype(np.int64) << 20 | third
    order = np.argsort(context)
    context = context[order]
    new = np.ones(len(order), bool)
    np.not_equal(context[1:], context[:-1], out=new[1:])
    # tokens alike in all are one row, in the order of their contexts
    key = np.cumsum(new) << 21 | (symbol[order].astype(np.int64) << 1 | taught[order])
    again = np.argsort(key)
    key, order = key[again], order[again]
    np.not_equal(key[1:], key[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    times = np.diff(begin, append=len(order))
    context, key = context[begin], key[begin]
    symbol, taught, three = key >> 1 & 0xFFFFF, key & 1, key >> 21
    marks = deal.marks(context >> 40, context >> 20 & 0xFFFFF, context & 0xFFFFF)
    numbers = [np.cumsum(np.diff(context >> shift, prepend=-1) != 0) for shift in (40, 20)] + [three]
    # contexts whose counts are not given stay whole, about PIECE_TOKENS are mixed at a time
    new = np.diff(numbers[0], prepend=-1) != 0
    for mark, of in zip(marks, (*numbers[1:], key)):
        new |= (mark >= 0) & (np.diff(of, prepend=-1) != 0)
    edge = np.flatnonzero(new)
    starts, ends = begin[edge], np.append(begin[edge[1:]], len(order))
    stops, rows = np.append(edge[1:], len(begin)), np.empty(len(begin), np.uint16)
    marks = [np.where(mark >= 0, level << deal.LEVEL | mark, -1) for level, mark in enumerate(marks)]
    at, weights, known, counts = 0, first_weights(), deal.any, Given(coder.tokens, given)
    while at < len(edge):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_TOKENS, "right")))
        o = slice(edge[at], stops[to - 1])
        got, weights = row_costs(coder, [x[o] for x in numbers], symbol[o], taught[o], times[o], weights, [m[o] for m in marks] if known else None, counts)
        rows[o] = np.minimum(np.rint(got * STEPS), 65535)
        at = to
    cost = np.empty(len(order), np.uint16)
    cost[order] = np.repeat(rows, times)
    return cost


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(cut(_scored(docs), "lm-result"))


def _scored(docs: DataFrame) -> DataFrame:
    found = cut(word_counts(docs), "lm-counts")
    alone = ~F.contains("word", F.lit(b" "))
    counts = found.where(alone)
    shared, total, distinct = learn(counts)
    codes = shared.codes
    parts = max(1, -(-total // PART_TOKENS))
    deal = dealing(found.where(~alone), shared, shared.coder.value.often, parts)
    how = docs.sparkSession.sparkContext.broadcast(deal)
    tasks = min(parts, TASKS)
    block_bytes = BLOCK_BYTES * min(16, max(1, tasks // 256))
    floor = math.log10(total + 0.1 * (distinct + 1))
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.LongType())]))
    fields = [("row", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("spelling", T.DoubleType()), ("n_bytes", T.LongType()), ("rare", rare)]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in fields]])

    def run(batches):
        from pyspark import TaskContext

        np.seterr(over="ignore")
        m, block = shared.model(), TaskContext.get().partitionId() << 20
        c = m.coder
        logs = np.log10(c.counts + 0.1)
        for b in batches:
            for first, words, numbers, token, sizes, n_bytes in _groups(b, 2, c.numbers, block_bytes):
                number = numbers.take(token)
                symbol = c.symbols(number, sizes)
                spelling = m.spelling_bits(words, token, sizes, number, symbol)
                begin = np.cumsum(sizes) - sizes
                here = number >= 0
                base = np.add.reduceat(np.where(here, logs[number], 0.0), begin)
                known = np.add.reduceat(here.astype(np.int64), begin)
                # tokens whose counts are not in the bounded table, by document
                missing = np.flatnonzero(~here)
                owner = np.searchsorted(begin, missing, "right") - 1
                lists: list[Counter] = [Counter() for _ in n_bytes]
                for k, t in zip(owner.tolist(), token[missing].tolist()):
                    lists[k][words[t]] += 1
                n, row = len(n_bytes), block << 20
                of_docs = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(range(row, row + n), pa.int64()), b.column(1).slice(first, n), pa.array(sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(spelling), pa.array(n_bytes, pa.int64()),
                     pa.array([[{"word": w, "tf": k} for w, k in x.items()] for x in lists], pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))],
                    names=schema.names,
                )
                # the tokens by part: the tokens before, the token, its document and whether it is learned from
                before, second, third = c.contexts(symbol, begin)
                part, marks = how.value.deal(before, second, third, block)
                order = np.argsort(part << 40 | before << 20 | second)
                held = b.column(1).slice(first, n).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(n) * 2 + ~held, sizes)
                rows = np.stack([x.astype(np.int32).take(order) for x in (before, second, third, symbol, doc)])
                stops = np.cumsum(np.bincount(part, minlength=parts))
                counted = {k: _pack(x) for k, x in how.value.counted(marks, symbol, np.repeat(~held, sizes)).items()} if how.value.any else {}
                filled = sorted({*np.flatnonzero(np.diff(stops, prepend=0)).tolist(), *counted})
                blobs = []
                for k in filled:
                    of_part = slice(stops[k - 1] if k else 0, stops[k])
                    blobs.append(_pack(rows[:, of_part]) if of_part.start < of_part.stop else None)
                # the documents' row of the block goes along
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, of_docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(of_docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*filled, block % parts], pa.int32()), pa.array([row] * (len(filled) + 1), pa.int64()), pa.array([False] * len(filled) + [True]), pa.array([*blobs, sink.getvalue().to_pybytes()], pa.binary()),
                     pa.array([*(counted.get(k) for k in filled), None], pa.binary())], names=["part", "block", "docs", "data", "counts"]
                )
                block += 1

    def sum_up(batches):
        found, size = [], 0
        for b in batches:
            for data in b.column(0).drop_null().to_pylist():
                found.append(_planes(data, 3))
                size += found[-1].shape[1]
            if size > 1 << 22:
                found = [summed_rows(found)]
                size = 0
        rows = summed_rows(found)
        edge = np.flatnonzero(np.diff(rows[0], prepend=-1))
        for a, b in zip(edge.tolist(), np.append(edge[1:], rows.shape[1]).tolist()):
            to, data = how.value.holders(int(rows[0, a])), _pack(rows[:, a:b].astype(np.int32))
            for k in range(0, len(to), 64):
                n = len(to[k : k + 64])
                yield pa.RecordBatch.from_arrays([pa.array(to[k : k + 64], pa.int32()), pa.array([data] * n, pa.binary())], names=["part", "counts"])

    costs = pa.schema([("block", pa.int64()), ("docs", pa.bool_()), ("data", pa.binary())])

    def predict(rows: pa.Table, given: pa.Table | None = None) -> pa.Table:
        whole = rows.filter(rows["docs"]).select(costs.names).cast(costs)
        rows = rows.filter(pc.is_valid(pc.if_else(rows["docs"], None, rows["data"]))).sort_by("block")
        ids, planes = rows["block"].to_pylist(), [_planes(x, 5) for x in rows["data"].to_pylist()]
        if not ids:
            return whole
        sizes = np.array([x.shape[1] for x in planes])
        before, second, third, symbol, doc = np.concatenate(planes, 1)
        counts = summed_rows([_planes(x, 3) for x in given["counts"].to_pylist()] if given is not None else [])
        cost = part_costs(codes.value, how.value, [before, second, third, symbol, doc & 1], counts)
        stops = np.cumsum(sizes).tolist()
        out = [pack_costs(doc[a:b] >> 1, cost[a:b]) for a, b in zip([0, *stops], stops)]
        return pa.concat_tables([whole, pa.table([pa.array(ids, pa.int64()), pa.array([False] * len(out)), pa.array(out, pa.binary())], schema=costs)])

    def predict_each(batches):
        for _, of in _runs(batches):
            part = pa.table([pa.array(x, t) for x, t in zip(zip(*of), costs.types)], schema=costs)
            yield from predict(part).to_batches(max_chunksize=64)

    def summed(batches):
        for _, of in _runs(batches):
            (of_docs,) = [pa.ipc.open_stream(data).read_next_batch() for docs, data in of if docs]
            total = np.zeros(of_docs.num_rows, np.int64)
            for docs, data in of:
                if not docs:
                    add_costs(total, data)
            yield of_docs.append_column("mixed", pa.array(total / STEPS))

    # a part's counts, then a block's costs, are in one task each
    rows = docs.select("doc_id", F.coalesce(doc_bucket(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "text")
    dealt = rows.mapInArrow(run, "part int, block long, docs boolean, data binary, counts binary").repartition(tasks, "part")
    if deal.any:
        # one exchange of tokens, read for the counts and, with their sums, for the costs: both name all columns, or they are two
        sums = dealt.select("counts", "part", "block", "docs", F.octet_length("data")).mapInArrow(sum_up, "part int, counts binary").repartition(tasks, "part")
        predicted = dealt.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(predict, "block long, docs boolean, data binary")
    else:
        predicted = dealt.select("part", "block", "docs", "data").sortWithinPartitions("part").mapInArrow(predict_each, "block long, docs boolean, data binary")
    back = predicted.repartition(tasks, "block").sortWithinPartitions("block")
    found = cut(back.mapInArrow(summed, T.StructType([*schema, T.StructField("mixed", T.DoubleType())])), "lm-scores")
    # the other words' counts, summed by row; their logarithms are added in the order of words
    tokens = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(counts, "word", "left")
    more = tokens.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("base2"))
    bits = F.col("spelling") + F.col("mixed")
    out = found.drop("rare").join(more, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (-bits * F.lit(math.log10(2))).alias("score"), F.try_divide(bits, F.col("n_bytes")).alias("bits_per_byte"),
    )
