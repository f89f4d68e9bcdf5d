"""Hard negatives of anchor vectors by distributed radix selection.

Scores are whole numbers: inner products of vectors of whole numbers. Anchors come in blocks and rows in groups of bounded
size; a task has one block and one group, and works its scores out slice by slice. A positive opens a window below its own
score. Rounds locate the score of each window's kth negative: tasks count the scores of a window by their next digit,
counts of all groups are added, and the bucket that holds the kth is what the next round looks into, unless few rows are
left in it. Then each group gives the rows at or above the bucket's lower end, at most k of them, and the first k are kept.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part, nor
do vectors whose length differs from the first dimension count seen most; repeated ids are rows of their own, ordered by
their further copies' row number; an anchor without positives or a window without negatives gives no rows; an empty
table gives none; other columns are not read. Scores must fit 64 bits, or the query fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bare, partitions, stored

#: Rows of a group, and anchors of a block, on average.
GROUP, BLOCK = 16_384, 2_048
#: Bits of a digit, and rows of a bucket that needs no further round.
DIGIT, FEW = 8, 64
#: Scores that a task works out at a time.
SLICE = 4_000_000


def quantized(vectors: DataFrame, id: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """row, id, label, q (components floor(scale * x)), stored: the rows that take part."""
    rows = bare(vectors, id=id, label=label, v=F.col(vector).cast("array<double>"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id is not null and label is not null and v is not null and size(v) > 0").where(~bad)
    # beyond 2^53 every double is whole
    q = F.transform("v", lambda x: F.when(F.abs(scale * x) < 2.0**53, F.floor(scale * x).cast("double")).otherwise(scale * x))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), q.alias("q")))


def matrix(q: pd.Series, exact: bool) -> np.ndarray:
    """Vectors as rows of a matrix; of Python's whole numbers where doubles would round."""
    x = np.stack(q.to_numpy()) if len(q) else np.zeros((0, 0))
    return x if exact else np.array([[int(v) for v in r] for r in x], object)


def scored(rows: pd.DataFrame, anchors: pd.DataFrame, exact: bool):
    """For each anchor of a block: its place there, and its scores with the rows of a group, int64."""
    left, right = matrix(rows["q"], exact), matrix(anchors["q"], exact)
    step = max(1, SLICE // max(len(rows), 1))
    for lo in range(0, len(anchors), step):
        s = left @ right[lo : lo + step].T
        s = np.ascontiguousarray(s.astype(np.int64).T)
        for k in range(len(s)):
            yield lo + k, s[k]


def first(score: np.ndarray, id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then id, then row."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((row[at], id[at], -score[at]))[:k]]


class Grid:
    """Rows in groups and anchors in blocks, each pair of which is one task's work."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, exact: bool):
        self.exact = exact
        n, m = rows.count(), anchors.count()
        self.groups = max(1, -(-n // GROUP), min(partitions(rows.sparkSession), n // 512))
        self.blocks = max(1, -(-m // BLOCK))
        self.rows = rows.withColumns({"g": F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))})
        self.anchors = anchors.withColumns({"b": F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.blocks)).cast("int")})

    def run(self, work, schema: str, windows: DataFrame | None = None) -> DataFrame:
        """What work(rows, anchors, exact) gives for each pair of a group and a block. windows: what each anchor row brings along."""
        anchors = self.anchors if windows is None else self.anchors.join(windows, "row")
        anchors = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        exact = self.exact

        def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return work(left, right, exact) if len(left) and len(right) else empty.copy()

        from pyspark.sql.types import StructType

        empty = pd.DataFrame({f.name: [] for f in StructType.fromDDL(schema)})
        return self.rows.groupBy("g", "b").cogroup(anchors.groupBy("g", "b")).applyInPandas(task, schema)


def positives(grid: Grid, k: int) -> DataFrame:
    """anchor (row), rank, id, score: the first k rows of the anchor's label, itself left out."""

    def work(rows, anchors, exact):
        label, id, row = (rows[c].to_numpy() for c in ("label", "id", "row"))
        out = []
        own, names = anchors["label"].to_numpy(), anchors["row"].to_numpy()
        for a, s in scored(rows, anchors, exact):
            at = np.flatnonzero((label == own[a]) & (row != names[a]))
            at = at[first(s[at], id[at], row[at], k)]
            out.append(pd.DataFrame({"anchor": names[a], "row": row[at], "id": id[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "row": [], "id": [], "score": []})

    found = grid.run(work, "anchor long, row long, id long, score long")
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "rank", "id", "score")


def _below(windows: pd.Series):
    """The windows of an anchor as arrays: rank, its positive's score, greatest depth below it, digits settled so far."""
    return [np.array([w[c] for w in windows], np.int64) for c in ("rank", "score", "depth", "lo", "shift")]


def _histogram(rows, anchors, exact):
    """Counts of depths below the positive's score by the next digit within the open bucket."""
    label = rows["label"].to_numpy()
    own, names, windows = anchors["label"].to_numpy(), anchors["row"].to_numpy(), anchors["windows"].to_numpy()
    out = []
    for a, s in scored(rows, anchors, exact):
        rank, score, depth, lo, shift = _below(windows[a])
        s = s[(label != own[a]) & (s >= (score - depth).min()) & (s <= score.max())]
        for j in range(len(rank)):
            t = score[j] - s
            t = t[(t >= lo[j]) & (t <= depth[j])]
            t = (t - lo[j]) >> shift[j]
            n = np.bincount(t[t < 1 << DIGIT])
            digit = np.flatnonzero(n)
            if len(digit):
                out.append(pd.DataFrame({"row": names[a], "rank": rank[j], "digit": digit, "n": n[digit]}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "rank": [], "digit": [], "n": []})


def _gather(k: int):
    def work(rows, anchors, exact):
        label, id, row = (rows[c].to_numpy() for c in ("label", "id", "row"))
        own, names, windows = anchors["label"].to_numpy(), anchors["row"].to_numpy(), anchors["windows"].to_numpy()
        out = []
        for a, s in scored(rows, anchors, exact):
            rank, score, depth, _, _ = _below(windows[a])
            near = np.flatnonzero((label != own[a]) & (s >= (score - depth).min()) & (s <= score.max()))
            for j in range(len(rank)):
                at = near[(s[near] <= score[j]) & (s[near] >= score[j] - depth[j])]
                at = at[first(s[at], id[at], row[at], k)]
                if len(at):
                    out.append(pd.DataFrame({"anchor": names[a], "rank": rank[j], "row": row[at], "id": id[at], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "rank": [], "row": [], "id": [], "score": []})

    return work


def located(grid: Grid, windows: DataFrame, k: int) -> DataFrame:
    """windows (row, rank, score, depth) with depth lowered to the end of the bucket that holds the kth negative."""
    most = windows.agg(F.max("depth")).first()[0]
    if most is None:
        return windows
    bits = max(DIGIT, -(-max(1, int(most).bit_length()) // DIGIT) * DIGIT)
    state = stored(windows.select("row", "rank", "score", "depth", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("above"), F.lit(True).alias("open")))
    for shift in range(bits - DIGIT, -1, -DIGIT):
        asked = state.where("open").groupBy("row").agg(F.collect_list(F.struct("rank", "score", "depth", "lo", F.lit(shift).alias("shift"))).alias("windows"))  # as many as positives
        counts = grid.run(_histogram, "row long, rank int, digit int, n long", asked).groupBy("row", "rank", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("row", "rank").orderBy("digit"))  # at most 256 digits
        kth = counts.withColumn("upto", upto).join(state.select("row", "rank", "above"), ["row", "rank"])
        kth = kth.where((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k)).select("row", "rank", "digit", "n", (F.col("upto") - F.col("n")).alias("before"))
        hit = F.col("open") & F.col("digit").isNotNull()
        lo = F.col("lo") + F.shiftleft(F.col("digit").cast("long"), shift)
        new = state.join(kth, ["row", "rank"], "left").select("row", "rank", "score", F.when(hit, F.least("depth", lo + ((1 << shift) - 1))).otherwise(F.col("depth")).alias("depth"), F.when(hit, lo).otherwise(F.col("lo")).alias("lo"),
            F.when(hit, F.col("above") + F.col("before")).otherwise(F.col("above")).alias("above"), (hit & (F.col("n") > FEW)).alias("open"))
        state = stored(new)
        if shift and state.where("open").isEmpty():
            break
    return state.select("row", "rank", "score", "depth")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k_positives: int = 5, k: int = 5, low: int = 80, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on `id`, the id; label: the label by the columns of vectors. A window of a positive with score p has the rows of
    other labels with low * p <= 100 * s <= 100 * p.
    """
    rows = quantized(vectors, id, vector, label, scale)
    size = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    top = rows.agg(F.max(F.expr("aggregate(q, 0d, (m, x) -> greatest(m, abs(x)))"))).first()[0] or 0.0
    d = size["d"] if size else 0
    exact = top * top * max(d, 1) < 2**53
    rows = rows.where(F.size("q") == d)
    anchors = stored(rows.where(is_anchor))
    grid = Grid(rows, anchors, exact)
    names = anchors.select("row", F.col("id").alias("anchor_id"))
    found = stored(positives(grid, k_positives))
    windows = found.where("score >= 0").select(F.col("anchor").alias("row"), "rank", "score", F.expr(f"score div 100 * {100 - low} + score % 100 * {100 - low} div 100").alias("depth"))
    narrowed = located(grid, stored(windows), k)
    asked = narrowed.groupBy("row").agg(F.collect_list(F.struct("rank", "score", "depth", F.lit(0).cast("long").alias("lo"), F.lit(0).alias("shift"))).alias("windows"))
    got = grid.run(_gather(k), "anchor long, rank int, row long, id long, score long", asked)
    order = W.partitionBy("anchor", "rank").orderBy(F.col("score").desc(), "id", "row")
    best = got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    out = best.join(found.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "rank"]).join(names.withColumnRenamed("row", "anchor"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
