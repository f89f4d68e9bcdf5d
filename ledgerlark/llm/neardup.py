"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Each document's set of 5-word shingles is hashed once. The permutation is cut into BANDS * ROWS bins; a bin keeps its
least hash, an empty bin borrows that of another bin by optimal densification (Shrivastava 2017). ROWS bins make a band,
and documents that agree in a band meet in its bucket. A bucket of m documents proposes m - 1 pairs with its smallest
document, and all proposed pairs are confirmed on the full sets.

A member unlike the centre may be like another member. So the members of buckets that hold more than one component so far are
looked at again, exactly: of two sets of n and m shingles that link, each has 3 * (n + m) / 7 of its shingles in common with the
other, so a document with fewer shingles that another component of these has, is done. Of the others those that meet, in
whatever row of buckets, make a group; groups are cut into blocks, and a task compares two blocks. Blocks of one component are not
compared with each other, and what a task gives is a spanning forest, so no pairs of a group are ever listed.

Defined cases: null and blank texts have no shingle and no links; texts of fewer than five words have one shingle, the
whole sequence; equal sets always link. Rows are compared, not ids: rows of one doc_id with unlike texts are in groups of their
own, rows without doc_id take part, and a group of such rows alone has no component_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .shared import SMALL_IDS, SMALL_ROWS, among, bare, components, keyed, partitions, scratch, small_batches, stored

BANDS, ROWS, WIDTH = 32, 4, 5
#: Documents of a block, and columns of the tables of shingles that a task compares at once.
BLOCK, COLUMNS = 512, 4096


def signatures(value: np.ndarray, off: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation signatures [rows, bins] of the sorted sets in value; rows of empty sets are 0."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    cell = row * bins + ((value >> A.U64(32)) * A.U64(bins) >> A.U64(32)).astype(np.int64)
    out, full = np.zeros(n * bins, A.U64), np.zeros(n * bins, bool)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # sorted values: the first of a cell is its least
    out[cell[first]], full[cell[first]] = value[first], True
    out, full = out.reshape(n, bins), full.reshape(n, bins)
    some = full.any(axis=1)
    need = np.flatnonzero((~full & some[:, None]).ravel())
    ask = 1
    while len(need):
        r, c = need // bins, need % bins
        other = (A.mix(c.astype(A.U64) * A.U64(1_000_003) + A.U64(ask)) % A.U64(bins)).astype(np.int64)
        hit = full[r, other]
        out[r[hit], c[hit]] = out[r[hit], other[hit]]
        need, ask = need[~hit], ask + 1
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys [rows, BANDS]."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=A.U64)[None, :] * A.U64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        total = A.mix(total ^ parts[:, :, k])
    return total


def _sketches(batches):
    for b in batches:
        for block in A.blocks(b.column(2)):
            value, off = A.sets_of_shingles(block, WIDTH)
            count = np.diff(off)
            key = bands(signatures(value, off)).view(np.int64)
            sums = []
            for salt in (1, 2):
                run = np.zeros(len(value) + 1, A.U64)
                np.cumsum(A.mix(value + A.U64(salt * 0x51ED270B)), out=run[1:])
                sums.append((run[off[1:]] - run[off[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (block.n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(key.ravel()))
            own = [b.column(k).slice(block.rows.start, block.n) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(count), pa.array(sums[0]), pa.array(sums[1]), lists], ["row", "id", "n", "s1", "s2", "keys"])


def _confirm(batches):
    """Rows in the order of (centre, part, role): a centre's text, then the texts to compare with it."""
    held, own = None, None
    for b in batches:
        centre, part, role, member = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        a_out, c_out, ok = [], [], []
        for block in A.blocks(b.column(4)):
            value, off = A.sets_of_shingles(block, WIDTH)
            for k in range(block.n):
                i = block.rows.start + k
                mine = value[off[k] : off[k + 1]]
                if role[i] == 0:
                    held, own = (centre[i], part[i]), mine.copy()
                elif held == (centre[i], part[i]):
                    both = len(np.intersect1d(mine, own, assume_unique=True))
                    a_out.append(member[i])
                    c_out.append(centre[i])
                    ok.append(100 * both >= 75 * (len(mine) + len(own) - both) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a_out, np.int64)), pa.array(np.array(c_out, np.int64)), pa.array(np.array(ok, bool))], ["a", "c", "ok"])


def confirmed(texts: DataFrame, pairs: DataFrame, per_part: int = 256) -> DataFrame:
    """pairs (a, c) with ok: 100 * |A and C| >= 75 * |A or C| on the whole sets.

    The partners of one c are dealt into parts of about per_part, and each part gets c's text again, so a c with any
    number of partners spreads over many tasks; a task holds one set and one Arrow batch.
    """
    spark = texts.sparkSession
    wide = pairs.groupBy("c").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    members = pairs.join(wide, "c").select(F.col("a").alias("id"), "c", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    centres = wide.select(F.col("c").alias("id"), "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    asked = stored(members.union(centres))
    few = asked.count() <= SMALL_ROWS
    rows = (texts.join(F.broadcast(asked), "id") if few else among(texts, asked)).select("c", "part", "role", "id", "text")
    rows = rows.repartition(partitions(spark), "c", "part").sortWithinPartitions("c", "part", "role")
    return stored(rows.mapInArrow(_confirm, "a long, c long, ok boolean").distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    with scratch(docs.sparkSession):
        rows = keyed(bare(docs, id=id, text=text), "id", "row")
        out = grouped(rows, "row", "id", "text").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
        return stored(out, keep=True)


def grouped(docs: DataFrame, row: str, id: str, text: str) -> DataFrame:
    """Per row of docs: row, id, n, component_id, kept; row: a column with a stored key of each row. kept: one row of each group,
    that with the smallest id."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stored(_grouped(bare(docs, row=row, id=id, text=text)), keep=True)


def _grouped(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("row").alias("id"), "text")
    sets = stored(docs.select("row", "id", "text").mapInArrow(_sketches, "row long, id long, n long, s1 long, s2 long, keys array<long>"))
    real = sets.where("n > 0")
    classes = stored(real.groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.first("keys").alias("keys")))
    rows = classes.select("rep", "n", F.explode("keys").alias("key"))
    full = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    members = stored(rows.join(full, "key"))
    tested = confirmed(texts, members.where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("c")).distinct())
    links = tested.where("ok").select(F.col("a").alias("u"), F.col("c").alias("v"))
    more = _undecided(texts, members, components(links))
    # copies hang on the representatives of their sets
    same = real.join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).where("row != rep").select(F.col("row").alias("u"), F.col("rep").alias("v"))
    roots = components((links if more is None else links.union(more)).union(same))
    out = sets.select("row", "id", "n").join(roots, F.col("row") == F.col("node"), "left").select("row", "id", "n", F.coalesce("root", "row").alias("root"))
    first = out.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"))
    return out.join(first, "root").select("row", "id", "n", F.col("m.id").alias("component_id"), (F.col("row") == F.col("m.row")).alias("kept"))


def _shingles(batches):
    for b in batches:
        for block in A.blocks(b.column(1)):
            value, off = A.sets_of_shingles(block, WIDTH)
            row = np.repeat(np.arange(block.n), np.diff(off))
            for k in range(0, len(value), 200_000):
                at = pa.array(block.rows.start + row[k : k + 200_000])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(value[k : k + 200_000].view(np.int64))], ["id", "root", "shingle"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right, by products of tables of 0 and 1."""
    value = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    both = np.intersect1d(*value)
    out = np.zeros((len(left), len(right)))
    at = [np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0)) for v in value]
    in_ = [both[a] == v if len(both) else np.zeros(len(v), bool) for a, v in zip(at, value, strict=True)]
    for k in range(0, len(both), COLUMNS):
        tables = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = in_[side] & (at[side] >= k) & (at[side] < k + COLUMNS)
            t = np.zeros((n, min(COLUMNS, len(both) - k)), np.float32)
            t[row[side][m], at[side][m] - k] = 1
            tables.append(t)
        out += tables[0] @ tables[1].T
    return out


def _compared(batches):
    """Rows group, one, two, side, id, root, n, set in the order of the first three: links that join components of a pair of blocks."""

    def links(held):
        side, ident, root, n = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
        sets = [s for h in held for s in h[4]]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        like = (100 * both >= 75 * (n[left][:, None] + n[right][None, :] - both)) & (root[left][:, None] != root[right][None, :])
        up: dict[int, int] = {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(like), strict=True):
            a, c = top(int(root[left[i]])), top(int(root[right[j]]))
            if a != c:
                up[a] = c
                out.append((int(ident[left[i]]), int(ident[right[j]])))
        return out

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["u", "v"])

    now, held = None, []
    for b in batches:
        lead = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in lead], axis=0)) + 1 if len(b) else []
        for lo, hi in zip([0, *edge], [*edge, len(b)], strict=True):
            if lo == hi:
                continue
            if (at := tuple(int(x[lo]) for x in lead)) != now:
                if held and (found := links(held)):
                    yield batch(found)
                now, held = at, []
            s = b.slice(lo, hi - lo)
            off = np.append(0, np.cumsum(s.column(7).value_lengths().to_numpy(zero_copy_only=False)))
            flat = s.column(7).flatten().to_numpy(zero_copy_only=False)
            held.append((*(s.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6)), [flat[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]))
    if held and (found := links(held)):
        yield batch(found)


def _undecided(texts: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Links (u, v) that join the components that meet in a bucket; None if no bucket holds two."""
    at = stored(members.join(roots, members.rep == roots.node, "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root")))
    mixed = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("least")).where("x < y").select("key", "least")
    meet = stored(at.join(mixed, "key"))
    asked = stored(meet.groupBy("rep").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.min("least").alias("least")).withColumnRenamed("rep", "id"))
    if not (n := asked.count()):
        return None
    # to link with a set of m shingles, at least 3 n / 4 and as many as the least that it meets, it must share so many
    asked = asked.withColumn("need", F.ceil(3 * (F.col("n") + F.greatest("least", F.ceil(3 * F.col("n") / 4))) / 7))
    rows = texts.join(F.broadcast(asked) if n <= SMALL_IDS else asked, "id").select("id", "text", "root")
    rows = stored(rows.repartition(partitions(texts.sparkSession)).mapInArrow(_shingles, "id long, root long, shingle long"))
    common = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    shared = rows.select("id", "shingle").join(common, "shingle").groupBy("id").agg(F.collect_list("shingle").alias("set"))
    alive = stored(shared.join(asked, "id").where(F.size("set") >= F.col("need")).select("id", "root", "n", "set"))
    # those that meet make groups
    ids = meet.select("key", F.col("rep").alias("id")).join(alive.select("id"), "id")
    low = ids.groupBy("key").agg(F.min("id").alias("v"))
    group = components(ids.join(low, "key").select(F.col("id").alias("u"), "v").where("u != v").distinct())
    rows = alive.select("id", "root").join(group.select("node", F.col("root").alias("group")), F.col("id") == F.col("node")).select("id", "root", "group")
    # a component of at least a block has blocks of its own (label), the others are mixed
    wide = rows.groupBy("group", "root").agg(F.count("*").alias("m")).select("group", "root", F.when(F.col("m") >= BLOCK, F.col("root")).alias("label"))
    rows = stored(rows.join(wide, ["group", "root"]))
    sizes = rows.groupBy("group", "label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    unit = lambda label, part: F.xxhash64(label.isNull(), label, part)
    units = sizes.select("group", "label", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    units = units.groupBy("group").agg(F.collect_list(F.struct(unit(F.col("label"), F.col("part")).alias("unit"), "label")).alias("units"))
    sizes = sizes.select(F.col("group").alias("g"), F.col("label").alias("l"), "parts")
    rows = rows.join(sizes, (F.col("group") == F.col("g")) & F.col("label").eqNullSafe(F.col("l"))).drop("g", "l").join(units, "group")
    own = unit(F.col("label"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.select("group", "id", "root", "label", own.alias("own"), "units")
    rows = rows.select("group", "id", "root", "own", F.explode(F.filter("units", lambda u: F.col("label").isNull() | u["label"].isNull() | (u["label"] != F.col("label")))["unit"]).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side.alias("side"), "id", "root")
    rows = rows.join(alive.select("id", "n", "set"), "id").select("group", "one", "two", "side", "id", "root", "n", "set")
    rows = rows.repartition(partitions(texts.sparkSession), "group", "one", "two").sortWithinPartitions("group", "one", "two")
    return stored(rows.mapInArrow(_compared, "u long, v long"))
