"""Substring dedup by recompression: long word passages that an earlier document has are removed.

Recompression (Jez 2013) rewrites sequences in rounds. A round takes each maximal run of one symbol as (symbol, length), and
then joins pairs of a left and a right symbol; which are left and which right is drawn anew in each round. Here a round is
a Spark job over all documents:

* every part of the corpus lists the distinct runs and pairs that it has, once each, and sends the list, cut into ranges by a hash, as
  packed arrays;
* a table of names is made of them, range by range: each run or pair that two documents have gets a number of its own (letters, the
  words, are named in the same way before the first round);
* each part gets the names of its own runs and pairs back, packed likewise, and rewrites its sequences.

So equal names stand for equal sequences of words in the whole corpus (words are told apart by 64-bit hashes). Beside each symbol
goes how many words to the left and right its parse depends on; that far within a window, it occurs at the same place of every
equal window. A run or pair that only one document has gets no name, and no window that holds it, with what it depends on, can
occur elsewhere: such windows leave the state at once. After the letters and the first round little but true repeats is left.

When the rounds are over:

1. The longest interior symbol of a window of SPAN words is its anchor, of several the one with the least name (the window's own
   hash, where none is interior). Windows in a row with one anchor make a stretch, named by a hash of all its words.
2. Each part asks for its distinct stretches, and hears the least doc_id that has them. Documents with a larger one lose them.
3. Where an anchor has several stretches, these may agree in part: the windows of the documents with the least doc_id are asked for
   one by one, by a hash of all their words.
4. Words under a window that a smaller doc_id has are removed.

Whole documents with equal words are settled first, by a grouped minimum of their digests, and one of them takes part. A passage, pair
or window that any number of documents have is one row for each part that asks for it, however many they are.

Defined cases: null and blank texts have no words, kept_sha256 is that of the empty string; texts of fewer than SPAN
words are kept whole; rows with one doc_id never remove each other's words; a null doc_id counts as the largest long, so
larger than all others. Ids are only compared; words are cut by row.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .bytepair import spread
from .shared import among, bare, keyed, parts_of, scratch, small_batches, stored

#: Symbols grow to at most MOST words, so that windows hold some with all that they depend on.
SPAN, ROUNDS, MOST = 50, 6, 16
#: So many words or more to either side: too far to lie in a window, or not known.
FAR = 200
#: The id of rows without one.
LAST = (1 << 63) - 1
KEYS = ["a", "b", "c", "d"]
#: Keys of a range, on average; there are at most MOST_RANGES ranges. Packed bytes of a part of the state, on average.
RANGE_KEYS, MOST_RANGES, STATE_BYTES = 100_000, 4096, 2_000_000


# -- exact keys of several columns ------------------------------------------------------------------------------------


def _hashed(columns: list[np.ndarray], seed: int) -> np.ndarray:
    h = np.full(len(columns[0]), A.mix(np.array([seed], A.U64))[0], A.U64)
    for c in columns:
        h = A.mix(h ^ c.astype(np.int64).view(A.U64))
    return h


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A representative of each distinct key, and the group of each row. Groups are made by hash and compared; a clash draws another hash."""
    for seed in range(1, 100):
        _, first, back = A.distinct(_hashed(columns, seed))
        if all((c[first][back] == c).all() for c in columns):
            return first, back
    raise RuntimeError("no hash without a clash")


class Table:
    """Values of keys of several columns, exactly."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        for seed in range(1, 100):
            h = _hashed(columns, seed)
            order = np.argsort(h)
            h = h[order]
            if not (h[1:] == h[:-1]).any():
                break
        self.seed, self.h, self.columns, self.values = seed, h, [c[order] for c in columns], [v[order] for v in values]

    def find(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        if not len(self.h):
            return np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), bool)
        h = _hashed(columns, self.seed)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        for own, c in zip(self.columns, columns, strict=True):
            hit &= own[at] == c
        return at, hit


# -- the state: chunks of documents, one row each ---------------------------------------------------------------------


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in the least type that holds them, byte planes apart, compressed; the key `a` as steps, so it must be sorted as unsigned."""
    out = []
    for k, a in arrays.items():
        if k == "a":
            a = np.diff(a.view(A.U64), prepend=A.U64(0)) if len(a) else a.view(A.U64)
        a = a.astype(np.min_scalar_type(int(a.max()))) if len(a) and a.min() >= 0 else a
        out.append((k, a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""))
    raw = b"".join(x[3] for x in out)
    return pickle.dumps(([x[:3] for x in out], len(raw), pa.compress(raw, codec="zstd", asbytes=True)))


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    heads, size, z = pickle.loads(data)
    raw, at, out = pa.decompress(z, size, codec="zstd", asbytes=True), 0, {}
    for k, kind, n in heads:
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
        at += n * width
        out[k] = np.cumsum(a, dtype=A.U64).view(np.int64) if k == "a" else a.astype(np.int64)
    return out


def _live(doc: np.ndarray, base: np.ndarray, start: np.ndarray, ok: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows that are ok: (doc, first word, words). start: first word of each window, ascending within a doc."""
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    first = ok.copy()
    first[1:] &= ~(ok[:-1] & (base[1:] == base[:-1]))
    at = np.flatnonzero(first)
    size = np.add.reduceat(ok.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return doc[at], start[at], size + span - 1


def merged(c: dict[str, np.ndarray], r: int) -> dict[str, np.ndarray]:
    """A round's runs and pairs: for each symbol to be, its place `at` among the old ones, keys a, b, c, d, whether it is fresh,
    size, region, and the words lo and hi to its left and right that its parse depends on."""
    name, size, lo, hi = c["name"], c["len"], c["lo"], c["hi"]
    n = len(name)
    region = np.searchsorted(np.cumsum(c["size"]), np.cumsum(size) - size, "right")
    at = np.arange(n)
    live = name > 0
    for step in ("runs", "pairs"):
        joined = region[1:] == region[:-1]
        if step == "runs":
            glue = joined & (name[1:] == name[:-1]) & live[1:]
        else:
            right = (_hashed([name, length], 1000 + r) & A.U64(1)).astype(bool)
            glue = joined & ~right[:-1] & right[1:] & live[1:] & live[:-1] & (size[1:] + size[:-1] <= MOST)
        head = np.ones(len(name), bool)
        head[1:] = ~glue
        k = np.flatnonzero(head)
        end = np.append(k[1:], len(name))
        many = end - k > 1
        # what decides that nothing more was joined: the neighbours, with what they depend on
        need_lo, need_hi = live[k].copy(), live[k].copy()
        if step == "pairs":
            need_lo &= ~many & right[k]
            need_hi &= ~many & ~right[k]
        before, after = np.maximum(k - 1, 0), np.minimum(end, len(name) - 1)
        open_lo, open_hi = (k > 0) & np.append(False, joined)[k], (end < len(name)) & np.append(joined, False)[end - 1]
        new_lo, new_hi = lo[k], hi[end - 1]
        new_lo = np.where(need_lo, np.where(open_lo, np.maximum(new_lo, size[before] + lo[before]), FAR), new_lo)
        new_hi = np.where(need_hi, np.where(open_hi, np.maximum(new_hi, size[after] + hi[after]), FAR), new_hi)
        if step == "runs":
            length = end - k
        else:
            a, b, second = name[k], length[k], np.minimum(k + 1, len(name) - 1)
            out = {"a": a, "b": b, "c": np.where(many, name[second], 0), "d": np.where(many, length[second], 0), "fresh": many | (b > 1)}
        at, name, live, region = at[k], name[k], live[k], region[k]
        lo, hi, size = np.minimum(new_lo, FAR), np.minimum(new_hi, FAR), np.add.reduceat(size, k) if len(k) else size
    return out | {"at": at, "name": name, "size": size, "region": region, "lo": lo, "hi": hi}


def rewritten(c: dict[str, np.ndarray], m: dict[str, np.ndarray], name: np.ndarray, span: int = SPAN) -> dict[str, np.ndarray]:
    """The chunk after a round: name has a number for each symbol, 0 for fresh ones without name; windows that hold one of these are dropped."""
    begin = np.cumsum(c["size"]) - c["size"]  # of the regions, in words
    start = np.cumsum(m["size"]) - m["size"]
    # windows that hold a nameless symbol with all that it depends on
    lost = m["fresh"] & (name == 0) & (m["lo"] < FAR) & (m["hi"] < FAR) & (m["size"] + m["lo"] + m["hi"] <= span)
    first, last = start[lost] - m["lo"][lost], (start + m["size"] + m["hi"])[lost]
    g = m["region"][lost]
    total = int(c["size"].sum())
    mark = np.zeros(total + 1, np.int64)
    np.add.at(mark, np.maximum(last - span, begin[g]), 1)
    np.add.at(mark, first + 1, -1)
    windows = np.maximum(c["size"] - span + 1, 0)
    at = spread(begin, windows)
    of = np.repeat(np.arange(len(windows)), windows)
    g, at, words = _live(of, of, at, np.cumsum(mark)[at] == 0, span)
    # symbols that overlap each new region; those cut by its ends are nobody's
    i, j = np.searchsorted(start + m["size"], at, "right"), np.searchsorted(start, at + words, "left")
    pick, own = spread(i, j - i), np.repeat(np.arange(len(g)), j - i)
    low, high = np.maximum(start[pick], at[own]), np.minimum((start + m["size"])[pick], (at + words)[own])
    whole = high - low == m["size"][pick]
    doc = c["doc"][g]
    used, doc = np.unique(doc, return_inverse=True)
    return {
        "key": c["key"][used], "id": c["id"][used], "doc": doc, "at": c["at"][g] + at - begin[g], "size": words, "letters": c["letters"][spread(at, words)],
        "name": np.where(whole, name[pick], 0), "len": high - low, "lo": np.where(whole, m["lo"][pick], FAR), "hi": np.where(whole, m["hi"][pick], FAR),
    }


def _least(name: np.ndarray, dep_lo: np.ndarray, dep_hi: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least name whose stretch lies in each window, and whether there is one."""
    out = np.zeros(len(at), A.U64)
    if not len(name) or not len(at):
        return out, np.zeros(len(at), bool)
    # both ends of the stretches rise with the symbols, so a window holds a range of them
    dep_lo, dep_hi = np.minimum.accumulate(dep_lo[::-1])[::-1], np.maximum.accumulate(dep_hi)
    a, b = np.searchsorted(dep_lo, at, "left"), np.searchsorted(dep_hi, at + span, "right")
    size = b - a
    some = size > 0
    level, k = [name], 1
    while k * 2 <= (size.max() if some.any() else 0):
        last = level[-1]
        level.append(np.minimum(last[:-k], last[k:]) if len(last) > k else last)
        k *= 2
    exp = np.zeros(len(at), np.int64)
    exp[some] = np.floor(np.log2(size[some])).astype(np.int64)
    for j in range(len(level)):
        m = some & (exp == j)
        if m.any():
            out[m] = np.minimum(level[j][a[m]], level[j][b[m] - (1 << j)])
    return out, some


def stretches(c: dict[str, np.ndarray], span: int = SPAN) -> dict[str, np.ndarray]:
    """The chunk's windows (hash, and first word in all regions' words) and stretches: anchor, name, region, first window, windows."""
    edge = np.append(0, np.cumsum(c["size"]))
    letters = A.Words(None, None, A.mix(c["letters"].astype(A.U64) + A.U64(1)), edge)
    value, at = A.windows(letters, span)
    start = np.cumsum(c["len"]) - c["len"]
    good = (c["name"] > 0) & (c["lo"] < FAR) & (c["hi"] < FAR) & (c["len"] + c["lo"] + c["hi"] <= span)
    order = (255 - np.minimum(c["len"][good], 255)).astype(A.U64) << A.U64(56) | c["name"][good].astype(A.U64)
    got, found = _least(order, (start - c["lo"])[good], (start + c["len"] + c["hi"])[good], at, span)
    anchor = np.where(found, got, value)
    region = np.searchsorted(edge, at, "right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (region[1:] != region[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(first)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    name = A.mix((np.add.reduceat(value * A.factors(place), first) if len(first) else np.zeros(0, A.U64)) + size.astype(A.U64))
    return {"value": value.view(np.int64), "word": at, "anchor": anchor[first].view(np.int64), "stretch": name.view(np.int64), "region": region[first], "first": first, "windows": size}


# -- what the parts ask for, and hear ---------------------------------------------------------------------------------


def _segments(batches, columns: int = 2):
    """(values of the leading columns, slice of a batch) for stretches of rows where these are equal."""
    for b in batches:
        lead = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in lead], axis=0)) + 1 if len(b) else []
        for lo, hi in zip([0, *edge], [*edge, len(b)], strict=True):
            if hi > lo:
                yield tuple(int(x[lo]) for x in lead), b.slice(lo, hi - lo)


class Heard:
    """The answers of a part, by kind. Names count from the base of their range."""

    def __init__(self, bases: dict[int, list[int] | None]):
        self.bases, self.parts, self.tables = bases, {k: [] for k in bases}, {}

    def add(self, kind: int, ranges: pa.Array, data: pa.Array) -> None:
        for r, x in zip(ranges.to_pylist(), data.to_pylist(), strict=True):
            got = _unpacked(x)
            if self.bases[kind] is not None:
                got["v"] = got["v"] + self.bases[kind][r]
            self.parts[kind].append(got)

    def find(self, kind: int, columns: list[np.ndarray], *values: str) -> list[np.ndarray]:
        """Whether each key has an answer, and its values (0 where not)."""
        keys = KEYS[: len(columns)]
        if kind not in self.tables:
            got = {k: np.concatenate([p[k] for p in self.parts[kind]]) if self.parts[kind] else np.zeros(0, np.int64) for k in (*keys, *values)}
            first = grouped([got[k] for k in keys])[0]  # a key that several tasks of the part asked for is answered as often
            self.tables[kind] = Table([got[k][first] for k in keys], [got[k][first] for k in values])
        at, hit = self.tables[kind].find(columns)
        out = [hit]
        for v in self.tables[kind].values:
            x = np.zeros(len(at), np.int64)
            x[hit] = v[at[hit]]
            out.append(x)
        return out


class Asked:
    """Distinct keys of a part, with the least and the greatest of a value that goes with them."""

    def __init__(self, many: int, ranges: int):
        self.many, self.ranges, self.columns = many, ranges, []

    def add(self, columns: list[np.ndarray], value: np.ndarray) -> None:
        if len(value):
            self.columns.append(self._folded(columns, value, value))
            if sum(len(x[0]) for x in self.columns[1:]) > 2_000_000:
                self.columns = [self._all()]

    @staticmethod
    def _folded(columns, least, most):
        first, back = grouped(columns)
        order = np.argsort(back, kind="stable")
        begin = np.searchsorted(back[order], np.arange(len(first)))
        return [*(c[first] for c in columns), np.minimum.reduceat(least[order], begin), np.maximum.reduceat(most[order], begin)]

    def _all(self) -> list[np.ndarray]:
        got = [np.concatenate(x) for x in zip(*self.columns, strict=True)]
        return self._folded(got[: self.many], got[-2], got[-1])

    def rows(self, part: int, ids: bool):
        """(range, part, packed keys) for each range that has some. ids: with the least and greatest value, else whether these differ."""
        if not self.columns:
            return
        got = self._all()
        if ids:
            got = dict(zip([*KEYS[: self.many], "least", "most"], got, strict=True))
            at = _hashed([got["a"]], 0) % A.U64(self.ranges)  # keys with one a lie in one range
        else:
            at = _hashed(got[: self.many], 0) % A.U64(self.ranges)
            got = dict(zip([*KEYS[: self.many], "several"], [*got[: self.many], got[-1] != got[-2]], strict=True))
        order = np.lexsort((got["a"].view(A.U64), at))
        bounds = np.searchsorted(at[order], np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)):
            yield int(r), part, _packed({k: v[order[bounds[r] : bounds[r + 1]]] for k, v in got.items()})


ASKS = "range int, part int, data binary"
ANSWERS = "range int, part int, n long, data binary"
STATE = "part int, data binary"


def _blobs(rows):
    """Record batches of (range, part, data), a few at a time."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= 128:
            yield _batch(held, ["range", "part", "data"], [pa.int32(), pa.int32(), pa.binary()])
            held = []
    if held:
        yield _batch(held, ["range", "part", "data"], [pa.int32(), pa.int32(), pa.binary()])


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _named(many: int, ids: bool):
    """Rows range, part, data in the order of the range -> each part's keys that have an answer; and, with part -1, how many keys of the range
    have one (n) in a row of its own. ids: the least id of a key that has several, and whether its `a` goes with several keys; else a number."""

    def answered(r, held):
        keys = KEYS[:many]
        got = {k: np.concatenate([h[1][k] for h in held]) for k in held[0][1]}
        part = np.repeat([h[0] for h in held], [len(h[1]["a"]) for h in held])
        first, back = grouped([got[k] for k in keys])
        n = len(first)
        if ids:
            least, most = np.full(n, LAST), np.full(n, -LAST - 1)
            np.minimum.at(least, back, got["least"])
            np.maximum.at(most, back, got["most"])
            keep, w = least < most, np.zeros(n, np.int64)
            if many > 1:
                head, own = grouped([got["a"][first]])
                low, high = np.full(len(head), LAST), np.full(len(head), -LAST - 1)
                np.minimum.at(low, own, least)
                np.maximum.at(high, own, most)
                w = ((np.bincount(own) > 1) & (low < high))[own].astype(np.int64)
                keep |= w > 0
            values = {"v": least, "w": w}
        else:
            seen = np.bincount(back, minlength=n) + np.bincount(back, got["several"], n)
            keep = seen > 1
            values = {"v": np.cumsum(keep) - 1}
        yield r, -1, int(keep.sum()), None
        order = np.argsort(part, kind="stable")
        order = order[keep[back[order]]]
        edge = np.flatnonzero(np.diff(part[order], prepend=-1))
        for lo, hi in zip(edge, np.append(edge[1:], len(order)) if len(order) else edge, strict=True):
            at = order[lo:hi]
            yield r, int(part[at[0]]), len(at), _packed({**{k: got[k][at] for k in keys}, **{k: v[back[at]] for k, v in values.items()}})

    def run(batches):
        out: list = []
        now, held = None, []

        def flush(rows):
            out.extend(rows)
            while len(out) >= 128:
                yield _batch(out[:128], ["range", "part", "n", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])
                del out[:128]

        for b in batches:
            for r, part, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now:
                    if held:
                        yield from flush(answered(now, held))
                    now, held = r, []
                held.append((part, _unpacked(data)))
        if held:
            yield from flush(answered(now, held))
        if out:
            yield _batch(out, ["range", "part", "n", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])

    return run


def _answers(asks: DataFrame, ranges: int, many: int, ids: bool = False, keep: bool = False) -> tuple[DataFrame, list[int], int]:
    """(the answers, stored; the base of the numbers of each range; how many keys have one). The driver gets a count for each range."""
    dealt = asks.select("range", "part", "data").repartition(ranges, "range").sortWithinPartitions("range", "part")
    table = stored(dealt.mapInArrow(_named(many, ids), ANSWERS), keep=keep)
    counts = dict(table.where("part = -1").select("range", "n").collect())
    base, upto = [], 0
    for r in range(ranges):
        base.append(upto)
        upto += counts.get(r, 0)
    return table.where("part >= 0").select("part", "range", "data"), base, upto


def _ranges(keys: int, parts: int) -> int:
    return max(1, min(parts, MOST_RANGES, keys // RANGE_KEYS))


def _chunked(batches, bases: dict[int, list[int] | None]):
    """(part, what it has heard, chunk) for rows part, kind, range, data in the order of part and kind; chunks have kind 9."""
    now, heard = None, None
    for (part, kind), b in _segments(batches):
        if part != now:
            now, heard = part, Heard(bases)
        if kind == 9:
            for data in b.column(3).to_pylist():
                yield part, heard, _unpacked(data)
        else:
            heard.add(kind, b.column(2), b.column(3))


def _asking(bases: dict, many: int, ranges: int, ids: bool, ask):
    """A mapInArrow function: each part's distinct keys, which ask(heard, chunk, asked) gathers."""

    def rows(batches):
        now, asked = None, None
        for part, heard, c in _chunked(batches, bases):
            if part != now:
                if asked:
                    yield from asked.rows(now, ids)
                now, asked = part, Asked(many, ranges)
            ask(heard, c, asked)
        if asked:
            yield from asked.rows(now, ids)

    return lambda batches: _blobs(rows(batches))


def _pairs_asked(r: int):
    def ask(_, c, asked):
        m = merged(c, r)
        f = np.flatnonzero(m["fresh"])
        asked.add([m[k][f] for k in KEYS], c["key"][c["doc"][m["region"][f]]])

    return ask


def _states(rows):
    for part, c in rows:
        if len(c["doc"]):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(c)], pa.binary())], ["part", "data"])


def _pairs_named(r: int, base: list[int], first: int):
    def rows(batches):
        for part, heard, c in _chunked(batches, {0: base}):
            m = merged(c, r)
            hit, number = heard.find(0, [m[k] for k in KEYS], "v")
            yield part, rewritten(c, m, np.where(m["fresh"], np.where(hit, number + first, 0), m["name"]))

    return lambda batches: _states(rows(batches))


def _of(c: dict[str, np.ndarray], region: np.ndarray) -> np.ndarray:
    return c["id"][c["doc"][region]]


def _stretches_asked(_, c, asked):
    s = stretches(c)
    asked.add([s["anchor"], s["stretch"]], _of(c, s["region"]))


def _judged(heard: Heard, c: dict[str, np.ndarray]):
    """(stretches, those that a smaller id has, windows of the others that are compared one by one, and their regions)."""
    s = stretches(c)
    hit, least, several = heard.find(1, [s["anchor"], s["stretch"]], "v", "w")
    own = _of(c, s["region"])
    single = np.flatnonzero(hit & (several > 0) & (least == own))
    return s, hit & (least < own), spread(s["first"][single], s["windows"][single]), np.repeat(s["region"][single], s["windows"][single])


def _windows_asked(heard, c, asked):
    s, _, window, region = _judged(heard, c)
    asked.add([s["value"][window]], _of(c, region))


def _lost(batches):
    """row, starts: the runs of a document's windows that a smaller id has, one row a document, starts counted in its words."""
    for _, heard, c in _chunked(batches, {1: None, 2: None}):
        s, gone, window, region = _judged(heard, c)
        hit, least, _ = heard.find(2, [s["value"][window]], "v", "w")
        late = hit & (least < _of(c, region))
        word = np.concatenate([s["word"][s["first"][gone]], s["word"][window[late]]])
        region = np.concatenate([s["region"][gone], region[late]])
        size = np.concatenate([s["windows"][gone], np.ones(int(late.sum()), np.int64)])
        if not len(word):
            continue
        start, doc = c["at"][region] + word - (np.cumsum(c["size"]) - c["size"])[region], c["doc"][region]
        # runs that touch are one
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], (start + size)[order]
        far = int(end.max()) + 1
        reach = np.maximum.accumulate(end + doc * far) - doc * far  # of the document's runs so far
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(doc)) - 1
        used, begin = np.unique(doc[at], return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(reach[last] - start[at])], ["start", "size"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), runs)
        yield pa.RecordBatch.from_arrays([pa.array(c["key"][used]), lists], ["row", "starts"])


SURVEY = "part int, row long, id long, n long, sha string, range int, data binary"


def _survey(ranges: int):
    """Rows of two kinds, part by part: a document's row, id, number of words and digest; and packed words, by range, of documents of at
    least SPAN words, each with whether unlike documents of the part have it."""
    names = ["part", "row", "id", "n", "sha", "range", "data"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]

    def words_of(part, asked):
        for b in _blobs(asked.rows(part, False)):
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.nulls(len(b), t) for t in kinds[1:5]), b.column(0), b.column(2)], names)

    def run(batches):
        now, asked = None, None
        for (part,), b in _segments(batches, 1):
            if part != now:
                if asked:
                    yield from words_of(now, asked)
                now, asked = part, Asked(1, ranges)
            for block in A.blocks(b.column(3)):
                w = A.words(block)
                sha = [hashlib.sha256(b" ".join(block.text(i).split())) for i in range(block.n)]
                short = np.array([int.from_bytes(x.digest()[:8], "little", signed=True) for x in sha], np.int64)
                m = np.repeat(w.count >= SPAN, w.count)
                asked.add([w.hash[m].view(np.int64)], np.repeat(short, w.count)[m])
                own = [b.column(k).slice(block.rows.start, block.n) for k in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(w.count), pa.array([x.hexdigest() for x in sha]), *(pa.nulls(block.n, t) for t in kinds[5:])], names)
        if asked:
            yield from words_of(now, asked)

    return run


def _lettered(base: list[int]):
    """The first chunks. Rows part, kind, row, id, text, range, data in the order of part and kind: names of words (0), rows to leave out (1), texts (2)."""

    def rows(batches):
        now, heard, skip = None, None, []
        for (part, kind), b in _segments(batches):
            if part != now:
                now, heard, skip = part, Heard({0: base}), []
            if kind == 0:
                heard.add(0, b.column(5), b.column(6))
                continue
            if kind == 1:
                skip.append(b.column(2).to_numpy(zero_copy_only=False))
                continue
            skip = [np.concatenate(skip)] if skip else []
            ids = b.column(3)
            for block in A.blocks(b.column(4)):
                w = A.words(block)
                key = b.column(2).slice(block.rows.start, block.n).to_numpy(zero_copy_only=False)
                taken = (w.count >= SPAN) & ~(np.isin(key, skip[0]) if skip else np.zeros(block.n, bool))
                hit, letter = heard.find(0, [w.hash.view(np.int64)], "v")
                letter = np.where(hit, letter + 1, 0)
                seen = np.append(0, np.cumsum(letter == 0))
                windows = np.where(taken, w.count - SPAN + 1, 0)
                doc = np.repeat(np.arange(block.n), windows)
                start = spread(w.first[:-1], windows)
                doc, start, words = _live(doc, doc, start, seen[start + SPAN] == seen[start], SPAN)
                used, doc_at = np.unique(doc, return_inverse=True)
                letters = letter[spread(start, words)]
                one, zero = np.ones(len(letters), np.int64), np.zeros(len(letters), np.int64)
                own = np.array([LAST if x is None else x for x in ids.slice(block.rows.start, block.n).take(pa.array(used)).to_pylist()], np.int64)
                yield part, {"key": key[used], "id": own, "doc": doc_at, "at": start - w.first[doc], "size": words, "letters": letters, "name": letters, "len": one, "lo": zero, "hi": zero}

    return lambda batches: _states(rows(batches))


def _cut(batches):
    """The digest of what is left of a text without the words under the given stretches of windows."""
    for b in batches:
        starts = b.column(2)
        removed, sha, texts = [], [], []
        for block in A.blocks(b.column(1)):
            for i in range(block.n):
                words = block.text(i).split()
                mark = np.zeros(len(words) + 1, np.int32)
                at = [(x["start"], x["size"]) for x in starts[block.rows.start + i].as_py()]
                at, size = np.array(at, np.int64).reshape(-1, 2).T
                np.add.at(mark, at, 1)
                np.add.at(mark, at + size + SPAN - 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                left = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["row", "removed", "cut_sha", "left"])


def _gathered(chunks: DataFrame, answers: list[tuple[int, DataFrame]], parts: int) -> DataFrame:
    """Chunks and answers of each part, in the order of part and kind."""
    out = _plain(chunks)
    for kind, a in answers:
        out = out.union(a.select("part", F.lit(kind).alias("kind"), "range", "data"))
    return out.repartition(parts, "part").sortWithinPartitions("part", "kind")


def _plain(chunks: DataFrame) -> DataFrame:
    return chunks.select("part", F.lit(9).alias("kind"), F.lit(0).alias("range"), "data")


def _first_state(texts: DataFrame, parts: int, size: int) -> tuple[DataFrame, DataFrame, int]:
    """size: bytes of all texts. (whole: row, id, n, sha, stand, gone; the chunks before the first round; how many words are named)."""
    spark, ranges = texts.sparkSession, _ranges(size // 20, parts)
    dealt = texts.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "row", "id", "text")
    with scratch(spark):
        with scratch(spark):  # the words go as soon as they are named
            survey = stored(dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_survey(ranges), SURVEY))
            docs = survey.where("data is null").select("part", "row", "id", "n", "sha")
            # documents with equal words look alike to all others: one with the smallest id stands for them
            id_ = F.coalesce("id", F.lit(LAST))
            first = docs.where(F.col("n") >= SPAN).groupBy("sha").agg(F.min(F.struct(id_.alias("id"), "row")).alias("m")).select("sha", F.col("m.id").alias("least"), F.col("m.row").alias("stand"))
            whole = docs.join(first, "sha", "left").withColumn("stand", F.when(F.col("n") >= SPAN, F.col("stand"))).withColumn("gone", F.coalesce((F.col("n") >= SPAN) & (F.col("least") < id_), F.lit(False)))
            whole = stored(whole.select("part", "row", "id", "n", "sha", "stand", "gone"), keep=3)
            answers, base, named = _answers(survey.where("data is not null"), ranges, 1, keep=True)
        none = {"row": F.lit(None).cast("long"), "id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "range": F.lit(0), "data": F.lit(None).cast("binary")}
        order = ["part", "kind", "row", "id", "text", "range", "data"]
        rows = answers.withColumns({"kind": F.lit(0)} | {k: none[k] for k in ("row", "id", "text")}).select(order)
        rows = rows.union(whole.where("row != stand").select("part", F.lit(1).alias("kind"), "row").withColumns({k: none[k] for k in ("id", "text", "range", "data")}).select(order))
        rows = rows.union(dealt.withColumns({"kind": F.lit(2)} | {k: none[k] for k in ("range", "data")}).select(order))
        state = stored(rows.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_lettered(base), STATE), keep=True)
    return whole, state, named


def _redealt(state: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(the state in as few parts as its size asks for, how many these are)."""
    size = state.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    fewer = max(1, min(parts, -(-size // STATE_BYTES)))
    return state.withColumn("part", F.col("part") % F.lit(fewer)), fewer


def _round(state: DataFrame, r: int, named: int, ranges: int, parts: int) -> tuple[DataFrame, int]:
    """The state after round r, and how many names it gave. named: how many there were."""
    with scratch(state.sparkSession):
        answers, base, n = _answers(_plain(state).mapInArrow(_asking({}, 4, ranges, False, _pairs_asked(r)), ASKS), ranges, 4)
        return stored(_gathered(state, [(0, answers)], parts).mapInArrow(_pairs_named(r, base, named + 1), STATE), keep=True), n


def _repeats(state: DataFrame, ranges: int, parts: int) -> DataFrame:
    """row, starts: the runs of windows that a smaller id has."""
    whole = _answers(_plain(state).mapInArrow(_asking({}, 2, ranges, True, _stretches_asked), ASKS), ranges, 2, True)[0]
    single = _gathered(state, [(1, whole)], parts).mapInArrow(_asking({1: None}, 1, ranges, True, _windows_asked), ASKS)
    lone = _answers(single, ranges, 1, True)[0]
    return stored(_gathered(state, [(1, whole), (2, lone)], parts).mapInArrow(_lost, "row long, starts array<struct<start:long,size:long>>"))


def passages(docs: DataFrame, id: str = "doc_id", text: str = "text", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs: row, id, n, sha, stand, gone; of words that are cut: row, removed, cut_sha, left). gone: all words are
    removed, as a smaller id has the same words; the others are cut as their stand is. row: a column of docs with a stored key of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        texts = keyed(bare(docs, id=id, text=text), "id", "row") if row is None else bare(docs, row=row, id=id, text=text)
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = parts_of(texts.sparkSession, size)
        whole, state, named = _first_state(texts, parts, size)
        for r in range(ROUNDS):
            state, parts = _redealt(state, parts)
            state, n = _round(state, r, named, _ranges(8 * named if not r else 8 * n, parts), parts)
            named += n
            if not n:
                break
        state, parts = _redealt(state, parts)
        cut = among(texts.select("row", "text"), _repeats(state, parts, parts), "row").select("row", "text", "starts")
        return whole, stored(cut.mapInArrow(_cut, "row long, removed long, cut_sha string, left string"), keep=True)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256."""
    whole, cut = passages(docs, id, text)
    cut = cut.select(F.struct("row", F.lit(False).alias("gone")).alias("of"), "removed", "cut_sha")
    # rows that are gone join with nothing; a key of their own deals them out
    out = whole.join(cut, F.struct(F.when(F.col("gone"), F.col("row")).otherwise(F.col("stand")).alias("row"), F.col("gone").alias("gone")) == F.col("of"), "left")
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_words"),
        F.when(F.col("gone"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
