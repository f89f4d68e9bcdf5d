"""Byte-level BPE: pre-tokens are cut from byte arrays, looked up by a minimal perfect hash, and merged by a heap.

Tier 1 is a minimal perfect hash over the vocabulary (hash and displace, Belazzougui et al. 2009): a pre-token that is
in the vocabulary as a whole gets its id by two array reads. Tier 2 takes the others: the bytes of a pre-token are a
linked list, a heap holds its adjacent pairs by rank, and the least pair is merged until none has a rank.
Distinct pre-tokens are resolved once and kept in a bounded memory of each worker.

The cutting follows the public pattern (public_tokenizers.PATTERN), worked out on classes of code points:
letters, numbers, white space and the rest. Defined cases: null and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .shared import bare, small_batches

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What may follow an apostrophe as a token of its own in the public pattern.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Distinct pre-tokens that a worker keeps; beyond that it starts anew.
KEPT = 1_200_000

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        first = {"L": LETTER, "N": NUMBER}
        _classes = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        _classes[list(WHITE_SPACE)] = SPACE
    return _classes


def pretokens(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Start of each pre-token in the block's bytes (they leave no gaps), and the index of each row's first one."""
    data, off, n = block.data, block.off, len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
    table = classes()
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        head = data[lead]
        b0, b1, b2, b3 = head.astype(np.int64), *(pad[lead + k].astype(np.int64) & 63 for k in (1, 2, 3))
        width = 2 + (head >= 0xE0) + (head >= 0xF0)
        point = np.where(width == 2, (b0 & 31) << 6 | b1, np.where(width == 3, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        of = table[np.minimum(point, 0x10FFFF)]
        kind[lead] = of
        for k in (1, 2, 3):
            m = (width > k) & (lead + k < n)
            kind[lead[m] + k] = of[m]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[off] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something else: its last character stands alone, or goes with what follows if it is a blank
    follows = np.flatnonzero(start & (kind != SPACE) & ~edge[:n])
    follows = follows[kind[follows - 1] == SPACE]
    last = follows - 1
    deep = (data[last] & 0xC0) == 0x80
    while deep.any():
        last[deep] -= 1
        deep = (data[last] & 0xC0) == 0x80
    start[last] = True
    start[follows[data[last] == 32]] = False
    # an apostrophe that begins a pre-token, with the letters that may belong to it
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[start[quote + 1] & (kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        for tail in CONTRACTIONS:
            hit = pad[quote + 1] == tail[0]
            if len(tail) == 2:
                hit &= (pad[quote + 2] == tail[1]) & ~edge[np.minimum(quote + 2, n)]
            q = quote[hit]
            start[q + 1] = False
            rest = q + 1 + len(tail)
            start[rest[rest < n]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, off)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, or of a byte-level BPE .json whose ids are its ranks."""
    if path.endswith(".json"):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        special = {x["content"] for x in loaded.get("added_tokens", [])}
        return {bytes(letter[c] for c in token): rank for token, rank in loaded["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings: as many slots as keys. Other strings are told apart by their 64-bit hash; the encoder compares the bytes."""

    def __init__(self, keys: list[bytes], values: list[int]):
        data = np.frombuffer(b"".join(keys), np.uint8)
        length = np.array([len(k) for k in keys], np.int64)
        h = A.hash_spans(data, np.cumsum(length) - length, length)
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        bucket = (h % A.U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        slot_of, taken = np.full(n, -1, np.int64), np.zeros(n, bool)
        sizes = np.diff(bounds)
        steps = np.arange(1, 2049, dtype=A.U64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, base, tries = order[bounds[b] : bounds[b + 1]], 0, steps[:32]
            while True:
                slots = (A.mix(h[own][None, :] + (tries + A.U64(base)) * A.U64(0x9E3779B97F4A7C15)) % A.U64(n)).astype(np.int64)
                ok = ~taken[slots].any(axis=1)
                ok &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    break
                base, tries = base + len(tries), steps
            self.shift[b], slot_of[own] = base + k + 1, slots[k]
            taken[slots[k]] = True
        free = np.flatnonzero(~taken)
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - free[: len(alone)]  # a bucket of one key names its slot
        slot_of[order[bounds[alone]]] = free[: len(alone)]
        self.key, self.value = np.zeros(n, A.U64), np.zeros(n, np.int64)
        self.key[slot_of], self.value[slot_of] = h, values

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where it is not a key's."""
        shift = self.shift[(h % A.U64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, (A.mix(h + shift.astype(A.U64) * A.U64(0x9E3779B97F4A7C15)) % A.U64(self.n)).astype(np.int64))
        return np.where(self.key[slot] == h, self.value[slot], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of adjacent pairs over linked bytes."""
    n, rank_of, pop, push = len(piece), ranks.get, heapq.heappop, heapq.heappush
    end = list(range(1, n + 1))  # of the part that begins at i; 0: no part begins here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = pop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != j:
            continue  # one of the two parts has changed since
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            if (r := rank_of(piece[i : end[j]])) is not None:
                push(heap, (r, i, end[j]))
        if (p := before[i]) >= 0 and (r := rank_of(piece[p:j])) is not None:
            push(heap, (r, p, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(4)
def prepared(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    ranks = load_ranks(path)
    return ranks, PerfectHash(list(ranks), list(ranks.values()))


class Memory:
    """Ids of pre-tokens by hash: a few sorted arrays, merged when they get many."""

    def __init__(self, most: int = KEPT):
        self.most, self.levels = most, []

    def add(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if sum(len(x[0]) for x in self.levels) + len(h) > self.most:
            self.levels = []
        self.levels.append(self._sorted(h, size, flat))
        if len(self.levels) > 8:
            self.levels = [self._sorted(*(np.concatenate([x[k] for x in self.levels]) for k in (0, 2, 3)))]

    @staticmethod
    def _sorted(h, size, flat):
        order = np.argsort(h)
        begin = np.cumsum(size) - size
        size = size[order]
        return h[order], np.cumsum(size) - size, size, flat[spread(begin[order], size)]

    def find(self, h: np.ndarray):
        """For each array: which of h it has, and their begin and size in its ids; then those that none has."""
        left = np.arange(len(h))
        for key, begin, size, flat in reversed(self.levels):
            at = np.minimum(np.searchsorted(key, h[left]), len(key) - 1)
            hit = key[at] == h[left]
            yield left[hit], begin[at[hit]], size[at[hit]], flat
            left = left[~hit]
        yield left, None, None, None


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all members of the stretches [begin, begin + size), one stretch after the other."""
    upto = np.cumsum(size)
    out = np.arange(upto[-1] if len(upto) else 0)
    out += np.repeat(begin - (upto - size), size)
    return out


class Encoder:
    """Encodes blocks of rows. misses: another way to merge a pre-token that is not in the vocabulary.

    Pre-tokens are looked up by hash, and the result is proved: the ids of each pre-token must decode to its own bytes.
    A block where two pre-tokens clash is encoded again by a dictionary of bytes.
    """

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash | None = None, misses=None):
        self.ranks, self.table = ranks, table or PerfectHash(list(ranks), list(ranks.values()))
        self.misses = misses or (lambda piece: merge(piece, ranks))
        self.memory, self.decoder = Memory(), Decoder(ranks)

    def encode(self, block: A.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, uint32, and where each row's begin."""
        at, first = pretokens(block)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        length = np.diff(np.append(at, len(block.data)))
        ids, upto = self._looked_up(block, at, length)
        data, begin = self.decoder.decode(ids)
        if len(data) != len(block.data) or (begin[upto[:-1]] != at).any() or (data != block.data).any():
            ids, upto = self._exact(block, at, length)
        return ids, upto[first]

    def _exact(self, block: A.Block, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known: dict[bytes, list[int]] = {}
        out = []
        for s, n in zip(at.tolist(), length.tolist(), strict=True):
            piece = block.data[s : s + n].tobytes()
            if piece not in known:
                known[piece] = [self.ranks[piece]] if piece in self.ranks else self.misses(piece)
            out.append(known[piece])
        upto = np.zeros(len(at) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=upto[1:])
        return np.fromiter(chain.from_iterable(out), np.uint32, int(upto[-1])), upto

    def _looked_up(self, block: A.Block, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and where each one's begin."""
        h, where, back = A.distinct(A.hash_spans(block.data, at, length))
        whole = self.table.find(h)
        size = np.ones(len(h), np.int64)
        miss = np.flatnonzero(whole < 0)
        parts = []
        for k, begin, n, flat in self.memory.find(h[miss]):
            if flat is None and len(k):
                data, misses = block.data, self.misses
                lists = [misses(data[s:e].tobytes()) for s, e in zip(at[where[miss[k]]].tolist(), (at + length)[where[miss[k]]].tolist(), strict=True)]
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                flat, begin = np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), np.cumsum(n) - n
                new = (h[miss[k]], n, flat)
            else:
                new = None
            if len(k):
                size[miss[k]] = n
                parts.append((miss[k], begin, n, flat))
            if new:
                self.memory.add(*new)
        begin = np.cumsum(size) - size
        pool = np.empty(int(size.sum()), np.uint32)
        pool[begin[whole >= 0]] = whole[whole >= 0]
        for k, own, n, flat in parts:
            pool[spread(begin[k], n)] = flat[spread(own, n)]
        n = size[back]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return pool[spread(begin[back], n)], upto


class Decoder:
    """Ids to bytes, vectorised."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each id's begin (one more than ids)."""
        n = self.length[ids]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return self.pool[spread(self.begin[ids], n)], upto


def encode_and_decode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, ids_sha256, decoded_sha256. vocabulary: a file of ranks, of bounded size, read on the driver and broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(prepared(vocabulary))

    def run(batches):
        ranks, table = shared.value
        encoder = Encoder(ranks, table)
        for b in batches:
            count, sha, back = [], [], []
            for block in A.blocks(b.column(1)):
                ids, first = encoder.encode(block)
                data, upto = encoder.decoder.decode(ids)
                little = ids.astype("<u4").view(np.uint8)
                for k in range(block.n):
                    i, j = first[k], first[k + 1]
                    count.append(j - i)
                    sha.append(hashlib.sha256(little[4 * i : 4 * j]).hexdigest())
                    back.append(hashlib.sha256(data[upto[i] : upto[j]]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = bare(docs, id=id, text=text).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id)
