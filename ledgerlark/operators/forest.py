"""Isolation forest (Liu et al. 2008): fitted on small samples, frozen to plain arrays, scored by an Arrow function.

All draws are hashes of the seed, segment, tree and node, so that SQL can grow the same trees. Scores are rounded to 9 digits: the order
in which path lengths are added doesn't show."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def settled(x: np.ndarray) -> np.ndarray:
    """Values to six digits after the point: sums that were added in another order are the same."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def draws(key: str) -> tuple[float, float]:
    """Two numbers between 0 and 1 that only the key decides, the same for every engine that has MD5."""
    h = hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()
    return tuple((int(h[k : k + 8], 16) + 0.5) / 2**32 for k in (0, 8))


def tree(x: np.ndarray, key: str) -> dict:
    """One tree over the rows of x: arrays feature (-1: leaf), threshold, left, right, path of the leaf.

    Node k of a complete tree splits one of the columns that vary there, at a value between its ends; both come from draws of
    "key.k". Rows below the value go to node 2k + 1, others to 2k + 2.
    """
    depth = max(1, math.ceil(math.log2(max(len(x), 2))))
    feature, threshold, left, right, path = [], [], [], [], []
    stack = [(x, 0, 0, -1, 0)]
    while stack:
        x, d, node, parent, side = stack.pop()
        at = len(feature)
        for a in (feature, threshold, left, right, path):
            a.append(-1)
        if parent >= 0:
            (left, right)[side][parent] = at
        lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(hi > lo)
        if d >= depth or not len(open_):
            path[at] = d + _c(len(x))
            continue
        u, v = draws(f"{key}.{node}")
        f = int(open_[int(u * len(open_))])
        t = float(lo[f] + v * (hi[f] - lo[f]))
        feature[at], threshold[at] = f, t
        stack += [(x[x[:, f] < t], d + 1, 2 * node + 1, at, 0), (x[x[:, f] >= t], d + 1, 2 * node + 2, at, 1)]
    return {"feature": feature, "threshold": [float(t) for t in threshold], "left": left, "right": right, "path": [float(p) for p in path]}


def fit(sample: np.ndarray, trees: int = 300, size: int = 256, seed: int = 42) -> dict:
    """A forest over a bounded sample, grown here. Tree k has the next `size` rows of the sample in a random order, from its beginning again
    where it ends."""
    size, order = min(size, len(sample)), np.random.default_rng(seed).permutation(len(sample))
    return {"size": size, "trees": [tree(sample[order[np.arange(k * size, (k + 1) * size) % len(sample)]], f"{seed}.{k}") for k in range(trees)]}


def choices(model: dict) -> tuple[list[np.ndarray], list, int]:
    """(sorted thresholds of each feature, groups of trees, most nodes on a way down).

    A group is (for each feature, the number of the group's own thresholds among the first k of all; (paths, root) of each tree): trees are
    grouped so that these numbers fit into a byte. A node is (feature, place of its threshold in the group, what is below it, what isn't, difference of
    the two if both are numbers); a subtree in which all leaves have the same path is that path's number, an array of no dimension. The most
    frequent path has number 0.
    """
    width = 1 + max((int(f) for t in model["trees"] for f in t["feature"]), default=-1)
    all_, groups = [set() for _ in range(width)], []
    for t in model["trees"]:
        own = [set() for _ in range(width)]
        for f, x in zip(t["feature"], t["threshold"], strict=True):
            if f >= 0:
                own[int(f)].add(float(x))
        if not groups or any(len(a | b) > 255 for a, b in zip(groups[-1][0], own, strict=True)):
            groups.append(([set() for _ in range(width)], []))
        for f, x in enumerate(own):
            groups[-1][0][f].update(x)
            all_[f].update(x)
        groups[-1][1].append(t)
    cuts = [np.array(sorted(x), float) for x in all_]
    depth, out = 1, []
    for found, trees in groups:
        short = [np.array(sorted(x), float) for x in found]
        place = np.min_scalar_type(max(map(len, short), default=0)).type
        roots = []
        for t in trees:
            leaves = Counter(float(p) for f, p in zip(t["feature"], t["path"], strict=True) if f < 0)
            paths = np.array([p for p, _ in leaves.most_common()])
            number = {p: np.array(k, np.min_scalar_type(len(paths) - 1)) for k, p in enumerate(paths)}
            with np.errstate(over="ignore"):
                root, n = _grown(t, 0, short, place, number)
            depth = max(depth, n)
            roots.append((paths, root))
        out.append(([np.concatenate([[0], np.cumsum(np.isin(c, own))]).astype(place) for c, own in zip(cuts, short, strict=True)], roots))
    return cuts, out, depth


def _grown(t: dict, k: int, cuts: list[np.ndarray], place: type, number: dict) -> tuple:
    """(node k of a tree as choices() has it, most nodes on a way down from it)."""
    if (f := int(t["feature"][k])) < 0:
        return number[float(t["path"][k])], 0
    (a, m), (b, n) = (_grown(t, t[side][k], cuts, place, number) for side in ("left", "right"))
    x, whole = float(t["threshold"][k]), type(a) is not tuple and type(b) is not tuple
    if x != x or whole and a == b:  # no value reaches a threshold that is no number
        return a, m
    return (f, np.array(np.searchsorted(cuts[f], x), place), a, b, b - a if whole else None), 1 + max(m, n)


def _choose(node: tuple, codes: list[np.ndarray], mask: tuple[np.ndarray, np.ndarray], out: list[np.ndarray], level: int) -> None:
    """The number of each row's path below the node, in out[level]; out[level + 1] and beyond are for the other side. Whole columns are
    compared and chosen from, without a look-up for each row: a - m * (a - b) with unsigned numbers that wrap around."""
    f, place, a, b, d = node
    x, y = out[level], out[level + 1]
    left, right = type(a) is tuple, type(b) is tuple
    if left:
        _choose(a, codes, mask, out, level)
    if right:
        _choose(b, codes, mask, out, level + left)
    np.greater(codes[f], place, out=mask[0])
    if left:
        np.subtract(y if right else b, x, out=y)
        np.multiply(y, mask[1], out=y)
        np.add(x, y, out=x)
        return
    if right and a:
        np.subtract(x, a, out=x)
    np.multiply(mask[1], x if right else d, out=x)
    if a:
        np.add(x, a, out=x)


def scores(model: dict, x: np.ndarray, rows: int = 32_768) -> np.ndarray:
    """From -1 (isolated at once) to 0. Values become their places among the forest's thresholds, so that the trees compare bytes."""
    if "choices" not in model:
        model["choices"] = choices(model)
    cuts, groups, depth = model["choices"]
    out = np.empty(len(x))
    for lo in range(0, len(x), rows):
        part = np.ascontiguousarray(x[lo : lo + rows].T)
        n, total, kept = part.shape[1], np.zeros(part.shape[1]), {}
        mask, path = np.empty(n, bool), np.empty(n)
        mask = mask, mask.view(np.uint8)
        places = [np.where(np.isnan(v), 0, np.searchsorted(c, v, "right")) for c, v in zip(cuts, part, strict=False)]
        for short, roots in groups:
            codes = [c.take(v) for c, v in zip(short, places, strict=True)]
            for paths, root in roots:
                if type(root) is not tuple:
                    total += paths[root]
                    continue
                kind = np.min_scalar_type(len(paths) - 1)
                if kind not in kept:
                    kept[kind] = [np.empty(n, kind) for _ in range(depth + 1)]
                _choose(root, codes, mask, kept[kind], 0)
                total += np.take(paths, kept[kind][0], out=path, mode="clip")
        out[lo : lo + rows] = total
    return np.round(-np.exp2(-out / len(model["trees"]) / max(_c(model["size"]), 1e-9)), 9)


TREE = "feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def fit_segments(df: DataFrame, columns: list[str], segment: str, least: int = 100, sample: int = 20_000, trees: int = 300, seed: int = 42, size: int = 256) -> dict:
    """A model for each segment with at least `least` rows, from at most `sample` rows of it, the first by the MD5 of _row_id.

    A threshold on the hash leaves a little more than the sample of each segment before rows are ranked. Tree k has ranks k * size
    to (k + 1) * size - 1 of the sample, from its beginning again where it ends; each tree's rows meet in one task, which grows it. The
    driver gets the trees, arrays of at most 2 * size nodes.
    """
    width = len(columns)
    rows = df.select(F.col(segment).alias("_s"), F.md5(F.col("_row_id").cast("string")).alias("_h"), "_row_id", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)]).where("_s is not null")
    counts = rows.groupBy("_s").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    share = F.least(F.lit(1.0), (1.1 * sample + 1000) / F.col("_n"))
    u = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") / float(1 << 32)
    few = rows.join(F.broadcast(counts.select("_s", share.alias("_share"), F.least("_n", F.lit(sample)).alias("_p"))), "_s").where(u <= F.col("_share"))  # a row for each segment
    few = few.select("_s", "_h", "_row_id", "_p", F.array(*[f"c{k}" for k in range(width)]).alias("x"))
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", "_row_id")) - 1).where(F.col("_r") < sample)
    own = F.least(F.lit(size), F.col("_p"))
    dealt = few.select("_s", "_r", "x", F.explode(F.sequence(F.lit(0), F.floor((own * trees - 1 - F.col("_r")) / F.col("_p")).cast("int"))).alias("_w"), "_p", own.alias("_size")).where(F.col("_r") < own * trees)
    place = F.col("_r") + F.col("_w") * F.col("_p")
    dealt = dealt.select(F.col("_s").cast("string").alias("s"), F.floor(place / F.col("_size")).cast("int").alias("k"), "x")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        s, k = rows["s"].iloc[0], int(rows["k"].iloc[0])
        return pd.DataFrame([{"s": s, "k": k, "size": len(rows)} | tree(settled(np.stack(rows["x"].to_numpy()).reshape(-1, width)), f"{seed}.{s}.{k}")])

    grown: dict = {}
    for r in sorted(dealt.repartition("s", "k").groupBy("s", "k").applyInPandas(grow, f"s string, k int, size int, {TREE}").collect(), key=lambda r: (r["s"], r["k"])):
        model = grown.setdefault(r["s"], {"size": r["size"], "trees": []})
        model["trees"].append({k: np.asarray(r[k]) for k in ("feature", "threshold", "left", "right", "path")})
    return grown


#: Rows scored at a time, gathered from Arrow batches: a step of a tree costs a call for all of them.
BLOCK = 100_000


def score(df: DataFrame, models: dict, columns: list[str], segment: str, name: str = "iso_score") -> DataFrame:
    """df with the score by the model of the row's segment, 0 where it has none. Models are of fixed size and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def block(parts: list[tuple[pd.Series, pd.DataFrame]]) -> pd.Series:
        seg, data = (pd.concat(p, ignore_index=True) for p in zip(*parts, strict=True))
        data, out = settled(data.to_numpy(float)), np.zeros(len(seg))
        for s, model in shared.value.items():
            m = (seg == s).to_numpy()
            if m.any():
                out[m] = scores(model, data[m])
        return pd.Series(out)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        parts, n = [], 0
        for seg, x in batches:
            parts, n = [*parts, (seg, x)], n + len(seg)
            if n >= BLOCK:
                yield block(parts)
                parts, n = [], 0
        if parts:
            yield block(parts)

    return df.withColumn(name, run(F.col(segment), F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(columns)])))
