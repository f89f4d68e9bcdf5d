"""Near-duplicate vectors by randomised-rotation binary codes with correction factors (RaBitQ, Gao and Long 2024).

A unit vector x is turned by a random rotation into BITS >= dim coordinates; its code is their signs, and its correction
factor f is the inner product of x with the unit vector that the code stands for. <code of y, x> / f(y) estimates <x, y>
without bias, and the error is within EPSILON * sqrt((1 - f^2) / f^2 / (BITS - 1)) but with a tiny probability. A pair
is recomputed in double precision only where the upper bound reaches the threshold, and it links only if the recomputed
cosine does.

Candidates are met in buckets: each of L tables takes k bits of the code as its key. k grows with the logarithm of the
number of vectors, and L is such that a pair at the threshold is missed with a probability of at most MISS. A bucket
of more than BLOCK vectors is cut into blocks, and each pair of blocks is a task's work. A bucket gives, linear in its
size, the number of links of each vector (counted in the first table where a pair meets) and a spanning forest.
Equal vectors are one class and compared once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; rows with one id are joined by that id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, bare, components, partitions, scratch, small_batches, stored

THRESHOLD, EPSILON, MISS, BLOCK = 0.95, 4.5, 1e-4, 2048


def tables(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(k, L) for n vectors."""
    k = min(24, max(4, round(math.log2(max(n, 2) / 64))))
    p = 1 - math.acos(threshold) / math.pi
    return k, math.ceil(math.log(MISS) / math.log(1 - p**k))


def rotation(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """[bits, dim] with orthonormal columns."""
    bits = max(bits, dim)
    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(bits, dim)))[0]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs and correction factors of unit vectors."""
    y = x @ turn.T
    return y >= 0, np.abs(y).sum(axis=1) / math.sqrt(turn.shape[0])


def near(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit vectors x[i], y[j] with an inner product of at least threshold."""
    bits = turn.shape[0]
    code, f = encode(y, turn)
    sign = np.where(code, 1, -1).astype(np.float32) / np.float32(math.sqrt(bits))
    estimate = (x @ turn.T).astype(np.float32) @ sign.T / f.astype(np.float32)
    error = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (bits - 1))
    i, j = np.nonzero(estimate >= (threshold - error - 1e-5).astype(np.float32))
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 100_000):
        keep[k : k + 100_000] = np.einsum("ij,ij->i", x[i[k : k + 100_000]], y[j[k : k + 100_000]]) >= threshold
    return i[keep], j[keep]


def _units(batches):
    """id, dim (0: links with nothing), unit vector as bytes of float64."""
    for b in batches:
        dim, blob = [], []
        for v in b.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            top = np.abs(x).max(initial=0)
            ok = len(x) and np.isfinite(x).all() and top > 0
            if ok:
                x = x / top
                x = x / np.sqrt((x * x).sum())
            dim.append(len(x) if ok else 0)
            blob.append(x.tobytes() if ok else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim, pa.int32()), pa.array(blob, pa.binary())], ["id", "dim", "unit"])


def _bucket_keys(code: np.ndarray, k: int, many: int) -> np.ndarray:
    """[rows, many] keys of k bits each."""
    weight = 1 << np.arange(k)
    return (code[:, : k * many].reshape(len(code), many, k) * weight).sum(axis=2)


def _dealt(k: int, many: int):
    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.float64).reshape(-1, dim)
                keys = _bucket_keys(encode(x, rotation(int(dim), k * many))[0], k, many)
                own = pa.array(np.repeat(at, many))
                bucket = (np.int64(dim) << 40) + (np.arange(many, dtype=np.int64) << 32)[None, :] + keys
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *(b.column(c).take(own) for c in (0, 1, 2, 3))], ["bucket", "rep", "dim", "unit", "n"])

    return run


def _linked(k: int, many: int):
    """Per bucket (and pair of blocks): (u, v) of a spanning forest with n 0, and (u, u) with the number n of u's links."""

    def run(batches):
        def out(bucket, rows):
            rep, dim, unit, n, side = (np.concatenate(x) if c != 2 else [y for z in x for y in z] for c, x in enumerate(zip(*rows, strict=True)))
            turn = rotation(int(dim[0]), k * many)
            x = np.frombuffer(b"".join(unit), np.float64).reshape(len(rep), -1)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            table = bucket >> 32 & 0xFF
            pairs = []
            for lo in range(0, len(left), 1024):
                part = left[lo : lo + 1024]
                i, j = near(x[part], x[right], turn)
                pairs.append((part[i], right[j]))
            i, j = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
            one = rep[i] < rep[j] if (side == 2).all() else i != j  # within a block each pair shows twice
            i, j = i[one], j[one]
            if not len(i):
                return
            keys = _bucket_keys(encode(x, turn)[0], k, many)
            first = np.ones(len(i), bool)
            for t in range(table):
                first &= keys[i, t] != keys[j, t]
            count = np.bincount(i[first], n[j[first]], len(rep)) + np.bincount(j[first], n[i[first]], len(rep))
            label, before = np.arange(len(rep)), None
            order = np.argsort(rep)
            place = np.empty(len(rep), np.int64)
            place[order] = np.arange(len(rep))
            a, b = place[i], place[j]
            while before is None or (label != before).any():
                before = label.copy()
                np.minimum.at(label, a, label[b])
                np.minimum.at(label, b, label[a])
                label = label[label]
            some = np.flatnonzero(count)
            tied = np.flatnonzero(label != np.arange(len(rep)))
            u = np.concatenate([rep[some], rep[order[tied]]])
            v = np.concatenate([rep[some], rep[order[label[tied]]]])
            m = np.concatenate([count[some], np.zeros(len(tied))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(m)], ["u", "v", "n"])

        now, rows = None, []
        for b in batches:
            bucket, block = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            key = np.stack([bucket, block], axis=1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(bucket)], strict=True):
                if lo == hi:
                    continue
                if (at := (int(bucket[lo]), int(block[lo]))) != now:
                    if rows:
                        yield from out(now[0], rows)
                    now, rows = at, []
                s = b.slice(lo, hi - lo)
                rows.append((*(s.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)), s.column(4).to_pylist(), *(s.column(c).to_numpy(zero_copy_only=False) for c in (5, 6))))
        if rows:
            yield from out(now[0], rows)

    return run


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per row of vectors: id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        return stored(_near_vectors(vectors, id, vector, block), keep=True)


def _near_vectors(vectors: DataFrame, id: str, vector: str, block: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = bare(vectors, id=id, vector=vector).mapInArrow(_units, "id long, dim int, unit binary")
    rows = stored(rows.select("*", F.xxhash64("unit").alias("h1"), F.xxhash64("unit", F.lit(1)).alias("h2")))
    real = rows.where("dim > 0 and id is not null")
    classes = stored(real.groupBy("h1", "h2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")))
    k, many = tables(classes.count())
    dealt = stored(classes.select("rep", "dim", "unit", "n").repartition(partitions(spark)).mapInArrow(_dealt(k, many), "bucket long, rep long, dim int, unit binary, n long"))
    large = stored(dealt.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > block).select("bucket", F.ceil(F.col("m") / block).cast("int").alias("parts")))
    large = F.broadcast(large) if large.count() <= SMALL_ROWS else large
    cut = dealt.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # the pairs of blocks that a row takes part in, and on which side: 2 within its own block, else 0 or 1
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct((F.least(o, "own") * F.col("parts") + F.greatest(o, "own")).alias("block"), F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    cut = cut.select("bucket", "rep", "dim", "unit", "n", F.explode(other).alias("o"))
    cut = cut.select("bucket", "o.block", "rep", "dim", "unit", "n", "o.side").repartition(partitions(spark), "bucket", "block").sortWithinPartitions("bucket", "block")
    found = stored(cut.mapInArrow(_linked(k, many), "u long, v long, n long"))
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("links"))
    same = real.join(classes.select("h1", "h2", "dim", "rep"), ["h1", "h2", "dim"]).where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    roots = components(found.where("u != v").select("u", "v").union(same))
    per = classes.select("h1", "h2", "dim", "rep", "n").join(counts, F.col("rep") == F.col("u"), "left").select("h1", "h2", "dim", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.join(per, ["h1", "h2", "dim"], "left").join(roots, F.col("id") == F.col("node"), "left")
    root = F.coalesce("root", "id")
    alone = (F.col("dim") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id), F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("id")).alias("kept"))
