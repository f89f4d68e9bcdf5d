"""Gradient-boosted trees over binned columns: histograms of gradients by aggregation, leaf-wise growth, early stopping.

Columns are cut at their quantiles once, and rows are stored as a label, a weight and a byte a column. A round grows a tree
in waves: a pass sums gradients by leaf, column and bin within each task, and the driver gets the sums, whose number
doesn't depend on the rows. Of all leaves that are open, those whose best split gains most are split while the tree may have
more leaves. Margins are stored every few rounds, so a pass walks few trees. A model is a plain dictionary."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .forest import settled
from .stats import exact_quantiles

BINS, KEEP = 32, 10


def _binned(df: DataFrame, columns: list[str], fill: dict, edges: list[np.ndarray], label: str, weight: str, held: str) -> DataFrame:
    """y, w, held (of the validation rows), bins (a byte a column) and the margin f, 0."""

    def run(batches):
        for b in batches:
            x = [settled(np.nan_to_num(b.column(3 + k).to_numpy(zero_copy_only=False).astype(float), nan=fill[c])) for k, c in enumerate(columns)]
            bins = np.stack([np.searchsorted(e, v, "left") for e, v in zip(edges, x, strict=True)], 1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(columns)), len(bins), [None, pa.py_buffer(np.ascontiguousarray(bins))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed, pa.array(np.zeros(len(bins)))], ["y", "w", "held", "bins", "f"])

    rows = df.select(F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), F.col(held).cast("boolean").alias("held"), *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return stored(rows.mapInArrow(run, "y double, w double, held boolean, bins binary, f double"))


def _leaves(bins: np.ndarray, splits: list) -> np.ndarray:
    """Leaf of each row: node k's children are 2k + 1 and 2k + 2. Splits (node, column, bin) stand after those of their parents."""
    at = np.zeros(len(bins), np.int64)
    for node, column, cut in splits:
        own = np.flatnonzero(at == node)
        at[own] = 2 * node + 1 + (bins[own, column] > cut)
    return at


def _margin(bins: np.ndarray, f: np.ndarray, trees: list) -> np.ndarray:
    for splits, values in trees:
        at = _leaves(bins, splits)
        table = np.zeros(max(values) + 1)
        table[list(values)] = list(values.values())
        f = f + table[at]
    return f


def _rows(b, width: int) -> tuple[np.ndarray, ...]:
    y, w, held, f = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
    bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, width)
    return y, w, held.astype(bool), bins, f


def _sums(data: DataFrame, width: int, base: float, trees: list, splits: list, open_: list[int]) -> dict:
    """{leaf: (columns, BINS, 3) sums of gradients, hessians and rows} of the open leaves, over training rows."""
    place = {leaf: k for k, leaf in enumerate(open_)}
    size = len(open_) * width * BINS

    def run(batches):
        total = np.zeros((3, size))
        for b in batches:
            y, w, held, bins, f = _rows(b, width)
            p = 1 / (1 + np.exp(-(base + _margin(bins, f, trees))))
            at = _leaves(bins, splits)
            slot = np.array([place.get(x, -1) for x in range(int(at.max(initial=0)) + 1)])[at]
            own = np.flatnonzero((slot >= 0) & ~held)
            cell = ((slot[own, None] * width + np.arange(width)) * BINS + bins[own]).ravel()
            for k, v in enumerate((w * (y - p), w * p * (1 - p), np.ones(len(y)))):
                total[k] += np.bincount(cell, np.repeat(v[own], width), size)
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[k][some]) for k in range(3))], ["cell", "g", "h", "n"])

    out = np.zeros((3, size))
    summed = data.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n"))
    for cell, *sums in summed.collect():  # a row for each leaf, column and bin
        out[:, cell] = sums
    out = out.reshape(3, len(open_), width, BINS)
    return {leaf: np.moveaxis(out[:, k], 0, -1) for leaf, k in place.items()}


def _best(sums: np.ndarray, least: int, penalty: float) -> tuple | None:
    """(gain, column, bin, sums of the left leaf, sums of the right one) of the best split of a leaf, gains rounded to 6 digits."""
    upto = np.cumsum(sums, axis=1)
    whole = upto[:, -1:]
    left, right = upto, whole - upto
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), np.floor((score(left) + score(right) - score(whole)) * 1e6 + 0.5) / 1e6, 0)
    k = int(gain.argmax())  # of equal ones the first column and bin
    column, cut = divmod(k, gain.shape[1])
    return (float(gain[column, cut]), column, cut, left[column, cut], right[column, cut]) if gain[column, cut] > 0 else None


def _loss(data: DataFrame, width: int, base: float, trees: list) -> float:
    """Mean logistic loss of the validation rows."""

    def run(batches):
        for b in batches:
            y, w, held, bins, f = _rows(b, width)
            m = base + _margin(bins, f, trees)
            yield pa.RecordBatch.from_arrays([pa.array([float((w * (np.logaddexp(0, m) - y * m))[held].sum())]), pa.array([float(w[held].sum())])], ["l", "w"])

    total, weight = data.mapInArrow(run, "l double, w double").agg(F.sum("l"), F.sum("w")).first()
    return total / weight if weight else math.inf


def _moved(data: DataFrame, width: int, trees: list) -> DataFrame:
    def run(batches):
        for b in batches:
            _, _, _, bins, f = _rows(b, width)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(_margin(bins, f, trees))], ["y", "w", "held", "bins", "f"])

    return stored(data.mapInArrow(run, "y double, w double, held boolean, bins binary, f double"))


def fit(df: DataFrame, columns: list[str], fill: dict, label: str, weight: str, held: str, rounds: int = 100, leaves: int = 31, depth: int = 6, rate: float = 0.1, least: int = 20, penalty: float = 1.0, patience: int = 10) -> dict:
    """A model of the rows that aren't held. Where some are, rounds stop when `patience` of them in a row don't lower the loss of the held ones,
    and the trees after the best round are dropped. Nulls take the fill of their column."""
    found = exact_quantiles(df.where(~F.col(held)), columns, [k / BINS for k in range(1, BINS)]).get(None, {})
    edges = [np.unique(settled(np.array(found[c], float))) if found.get(c) else np.zeros(0) for c in columns]
    data = _binned(df, columns, fill, edges, label, weight, held)
    width = len(columns)
    some, w, up = data.agg(F.count_if("held"), F.sum(F.when(~F.col("held"), F.col("w"))), F.sum(F.when(~F.col("held"), F.col("w") * F.col("y")))).first()
    share = min(max((up or 0.0) / w, 1e-6), 1 - 1e-6) if w else 0.5
    model = {"columns": list(columns), "base": math.log(share / (1 - share)), "trees": []}
    fresh, best, since = [], (math.inf, 0), 0
    for r in range(rounds):
        splits, values, open_ = [], {0: 0.0}, [0]
        for _ in range(depth):
            sums = _sums(data, width, model["base"], fresh, splits, open_)
            options = [(b[0], leaf, b) for leaf in open_ if (b := _best(sums[leaf], least, penalty))]
            options = sorted(options, key=lambda o: (-o[0], o[1]))[: leaves - len(values)]
            open_ = []
            for _, leaf, (_, column, cut, left, right) in options:
                splits.append((leaf, column, cut))
                del values[leaf]
                for child, s in ((2 * leaf + 1, left), (2 * leaf + 2, right)):
                    values[child] = rate * float(s[0] / (s[1] + penalty))
                    open_.append(child)
            if not open_ or len(values) >= leaves:
                break
        if not splits:
            break
        fresh.append((splits, values))
        model["trees"].append({"split": [[n, c, float(edges[c][k])] for n, c, k in splits], "value": [[n, v] for n, v in sorted(values.items())]})
        if some:
            loss = _loss(data, width, model["base"], fresh)
            best, since = ((loss, r + 1), 0) if loss < best[0] else (best, since + 1)
            if since >= patience:
                break
        if len(fresh) == KEEP:
            data, fresh = _moved(data, width, fresh), []
    if some:
        model["trees"] = model["trees"][: best[1]]
    return model


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of rows of raw values."""
    x = settled(x)
    out = np.full(len(x), model["base"])
    for t in model["trees"]:
        at = np.zeros(len(x), np.int64)
        for node, column, cut in t["split"]:
            own = np.flatnonzero(at == node)
            at[own] = 2 * node + 1 + (x[own, column] > cut)
        table = np.zeros(int(max(n for n, _ in t["value"])) + 1)
        for n, v in t["value"]:
            table[n] = v
        out += table[at]
    return out


def score(df: DataFrame, model: dict, fill: dict, name: str) -> DataFrame:
    """df with the probability of a one. A model is of bounded size and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-margins(shared.value, x.to_numpy(float)))))

    return df.withColumn(name, run(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fill.get(c, 0.0)))).alias(f"c{k}") for k, c in enumerate(model["columns"])])))
