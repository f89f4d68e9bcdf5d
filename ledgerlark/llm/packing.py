"""Best-fit packing of tokenized documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the sequence length, so an instance of any size is a table of at most that many counts.
Reduction and best fit run on this table on the driver: a step fixes or places all pieces of one length that are alike,
so their number doesn't matter. The plan says for each length which ranks of its pieces go where; Spark numbers the
pieces of each length and looks their places up.

Defined cases: null and empty texts are one piece of one token, the end id; equal lengths are ranked by id and piece;
an empty table gives no rows; repeated rows are packed like others.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import bytepair
from .shared import bare, ranked, small_batches, stored

LENGTH, END = 2048, 0


@dataclass
class Plan:
    """Places by length: pieces with ranks from lo on, `per` to a sequence, from `sequence` on, at `offset` there."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, lo, sequence, per, offset
    sequences: int = 0
    fixed: int = 0  # sequences settled by dominance

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


def plan(counts: np.ndarray, size: int = LENGTH) -> Plan:
    """counts[k]: pieces of length k, for k from 0 (none) to size."""
    left = np.array(counts, np.int64)
    out, used = Plan(), np.zeros(size + 1, np.int64)

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        out.rows.append((length, int(used[length]), sequence, per, offset))
        used[length] += n
        left[length] -= n

    def fix(n: int, *lengths: int) -> None:
        """n sequences of a piece of each of the lengths."""
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            many = lengths.count(length)
            put(length, many * n, out.sequences, many, offset)
            offset += many * length
        out.sequences += n
        out.fixed += n

    def most(*lengths: int) -> int:
        return min(int(left[x]) // lengths.count(x) for x in lengths)

    # Dominance, from the longest piece j on. A set that fits beside j dominates all others when each of them can be
    # exchanged for it, part by part, without need of more sequences. Sets of more than three pieces are not tried.
    for j in range(size, 0, -1):
        while left[j]:
            room = size - j
            others = left.copy()
            others[j] -= 1
            fits = np.flatnonzero(others[: room + 1])
            if not len(fits):
                fix(int(left[j]), j)
                break
            best = int(fits[-1])
            small = np.repeat(fits[:3], np.minimum(others[fits[:3]], 3))[:3]
            if best != room and len(small) > 1 and small[0] + small[1] <= room:
                # two more would fit: one piece dominates only if no pair is longer, and no three fit
                if len(small) > 2 and small.sum() <= room:
                    break
                if _best_pair(others, fits, room) > best:
                    if (pair := _full_pair(others, fits, room)) is None:
                        break
                    fix(most(j, *pair), j, *pair)
                    continue
            fix(most(j, best), j, best)

    # Best fit of the rest, longest first. Sequences with the same room are alike: a group is (first, how many).
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((first, n))

    for length in range(size, 0, -1):
        while n := int(left[length]):
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, m = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, m = size, out.sequences, -(-n // (size // length))
                out.sequences += m
            per = room // length
            whole = min(m, n // per)
            if whole:
                put(length, whole * per, first, per, size - room)
                add(room - per * length, first, whole)
                n -= whole * per
            if whole < m and n:  # the last pieces of this length open one more sequence of the group
                put(length, n, first + whole, n, size - room)
                add(room - n * length, first + whole, 1)
                whole += 1
            add(room, first + whole, m - whole)
    return out


def _best_pair(others: np.ndarray, fits: np.ndarray, room: int) -> int:
    """The greatest sum of two pieces that is at most room."""
    mate = np.searchsorted(fits, room - fits, "right") - 1
    ok = mate >= 0
    a, b = fits[ok], fits[mate[ok]]
    twin = (a == b) & (others[a] < 2)
    lower = np.maximum(mate[ok] - 1, 0)
    b = np.where(twin, fits[lower], b)
    ok = ~(twin & (mate[ok] == 0))
    return int((a + b)[ok].max()) if ok.any() else 0


def _full_pair(others: np.ndarray, fits: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two pieces that fill the room and dominate all that fits there, where at most two do: no more than one piece lies between them,
    or the two pieces next above the shorter one don't fit together."""
    half = fits[fits <= room // 2]
    for b in half[::-1].tolist():
        a = room - b
        if others[a] >= 1 + (a == b):
            above = np.flatnonzero(others[b + 1 :])[:2] + b + 1
            next_two = np.repeat(above, np.minimum(others[above], 2))[:2]
            if a == b or others[b + 1 : a].sum() <= 1 or len(next_two) == 2 and next_two.sum() > room:
                return a, b
            return None  # pairs further apart have more between them
    return None


def pieces(docs: DataFrame, vocabulary: str, id: str, text: str, size: int = LENGTH, end: int = END) -> DataFrame:
    """id, piece, start, length, crc of every piece: a document's ids and the end id, cut when longer than size."""
    import tiktoken

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bytepair.prepared(vocabulary))

    def run(batches):
        ranks, table = shared.value
        core = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        encoder = bytepair.Encoder(ranks, table, core.encode_single_piece)
        tail = np.array([end], "<u4")
        for b in batches:
            row, number, start, length, crc = [], [], [], [], []
            for block in A.blocks(b.column(1)):
                ids, first = encoder.encode(block)
                ids = ids.astype("<u4")
                for k in range(block.n):
                    own = np.concatenate([ids[first[k] : first[k + 1]], tail])
                    lo, p, hi = 0, 0, len(own) % size or size
                    while lo < len(own):
                        row.append(block.rows.start + k)
                        number.append(p)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own[lo:hi]))
                        lo, hi, p = hi, hi + size, p + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "crc"])

    return bare(docs, id=id, text=text).mapInArrow(run, "id long, piece int, start long, length long, crc long")


def pack(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", size: int = LENGTH, end: int = END) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    table = stored(pieces(docs, vocabulary, id, text, size, end))
    counts = np.zeros(size + 1, np.int64)
    for length, n in table.groupBy("length").count().collect():  # a row for each length up to size
        counts[length] = n
    places = spark.sparkContext.broadcast(plan(counts, size).table())

    def place(batches):
        rows = places.value
        key = rows[:, 0] << 42 | rows[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            _, lo, sequence, per, offset = rows[np.searchsorted(key, length << 42 | rank, "right") - 1].T
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence + (rank - lo) // per), pa.array(offset + (rank - lo) % per * length)], ["id", "piece", "start", "length", "crc", "sequence", "offset"])

    numbered = ranked(table, "length", ["id", "piece", "start", "crc"], F.xxhash64("id", "piece"), "rank")
    out = numbered.select("id", "piece", "start", "length", "crc", F.col("rank").cast("long")).mapInArrow(place, "id long, piece int, start long, length long, crc long, sequence long, offset long")
    return out.select(F.col("id").alias(id), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
