"""Vectorised text primitives over the byte buffers of Arrow string columns.

A *block* is a slice of rows whose texts lie one after the other in one uint8 array.
Null texts count as empty. A single text is never cut: a block holds at least one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1_500_000
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_SPAN = 1 << 16


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def factors(at: np.ndarray) -> np.ndarray:
    """The factor of each place: a random number drawn by the place, the same for all spans."""
    out = _NEAR[at & (_SPAN - 1)]
    far = np.flatnonzero(at >= _SPAN)
    if len(far):
        out[far] = mix(at[far].astype(U64) * _BASE + _BASE)
    return out


_NEAR = mix(np.arange(_SPAN, dtype=U64) * _BASE + _BASE)


@dataclass
class Block:
    rows: slice  # of the record batch
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, one more than rows

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column without copying its bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, raw = column.buffers()
    n = len(column)
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of the column of about size bytes."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Block(slice(lo, hi), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    start: np.ndarray  # of each word in the block's bytes
    length: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # index of each row's first word; one more than rows

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def cut(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each maximal run of True that stays in one row."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens = np.zeros(n + 1, bool)
    opens[1:n] = mask[:-1]
    opens[off] = False
    starts = np.flatnonzero(mask & ~opens[:n])
    shuts = np.zeros(n, bool)
    shuts[:-1] = mask[1:]
    inner = off[(off > 0) & (off <= n)] - 1
    shuts[inner] = False
    ends = np.flatnonzero(mask & ~shuts) + 1
    return starts, ends - starts


def hash_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they lie.

    Each byte is multiplied by the random factor of its place and the products are summed (multilinear hashing), so any
    two given spans clash with a probability of at most 2**-56, whatever their pattern; a polynomial modulo 2**64 would
    give equal hashes to some fixed pairs.
    """
    if not len(start):
        return np.zeros(0, U64)
    if len(start) > 1 and (start[1:] < start[:-1] + length[:-1]).any():
        raise ValueError("spans overlap")
    head = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=head[1:])
    at = np.arange(head[-1])
    at -= np.repeat(head[:-1], length)
    source = np.repeat(start, length)
    source += at
    value = (data[source].astype(U64) + U64(1)) * factors(at)
    full = length > 0
    out = np.zeros(len(start), U64)
    out[full] = np.add.reduceat(value, head[:-1][full]) if full.any() else 0
    return mix(out + length.astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of 64-bit hashes with index and inverse; the order is that of the high bits."""
    n = len(h)
    bits = max(1, n.bit_length())
    packed = (h >> U64(bits) << U64(bits)) | np.arange(n, dtype=U64)  # sorting values is faster than finding an order
    packed.sort()
    at = (packed & U64((1 << bits) - 1)).astype(np.int64)
    full = h[at]
    new = np.ones(n, bool)
    new[1:] = full[1:] != full[:-1]
    if n and ((packed[1:] >> U64(bits) == packed[:-1] >> U64(bits)) & new[1:]).any():  # equal high bits of unequal hashes
        return np.unique(h, return_index=True, return_inverse=True)
    back = np.empty(n, np.int64)
    back[at] = np.cumsum(new) - 1
    return full[new], at[new], back


def words(block: Block, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of every row; lower: A-Z count as a-z."""
    data = _LOWER[block.data] if lower else block.data
    start, length = cut(~_WHITE[data], block.off)
    return Words(start, length, hash_spans(data, start, length), np.searchsorted(start, block.off))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words that stay in one row, and each run's first word."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    fits = np.zeros(n, bool)
    first, last = w.first[:-1], w.first[1:] - size + 1
    mark = np.zeros(n + 1, np.int32)
    ok = last > first
    np.add.at(mark, first[ok], 1)
    np.add.at(mark, last[ok], -1)
    fits = np.cumsum(mark[:n]) > 0
    at = np.flatnonzero(fits)
    total = np.zeros(n - size + 1, U64)
    coefs = mix(np.arange(1, size + 1, dtype=U64)) | U64(1)
    for k in range(size):
        total += w.hash[k : n - size + 1 + k] * coefs[k]
    return mix(total[at]), at


def sets_of_shingles(block: Block, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, sorted within the row: (values, offsets).

    A row with fewer words than size has its whole sequence as the one shingle; one without words has none.
    """
    w = words(block, lower=True)
    value, at = windows(w, size)
    count = w.count
    row = np.repeat(np.arange(block.n), np.maximum(count - size + 1, 0))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), U64)
        for k, r in enumerate(short):
            lo, hi = w.first[r], w.first[r + 1]
            with np.errstate(over="ignore"):
                extra[k] = mix(np.array([np.sum(w.hash[lo:hi] * (mix(np.arange(101, 101 + hi - lo, dtype=U64)) | U64(1))) + U64(hi - lo)], U64))[0]
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(block.n + 1))
