"""PageRank over packed blocks of edges that stay where they are: rounds move vectors of ranks only.

With dangling mass spread evenly, ranks are the normalised solution y of y = v + alpha * P' * y, where accounts that send nothing
have no row in P. So no figure of all accounts enters a round: what an account has got and not yet passed on is its residue, and
the sum of residues bounds the error.
"""

from __future__ import annotations

import contextlib
import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import folder, setting, stored

#: Accounts and edges a part has on average, and the edges of a block.
ACCOUNTS, EDGES, BLOCK = 1 << 18, 4_000_000, 1 << 17
#: A row of the state: y (0), edges within the part (1), residue of some accounts (2), of all (3), what is passed on (4).
_ROW = "part int, kind int, a array<int>, b array<int>, x array<double>"
_SUM = "aggregate(x, 0D, (s, v) -> s + abs(v))"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _passed_on(stop: float, more: float):
    """One part: residues run along the edges within it until little is left; what each account has passed on leaves it. `more`
    times as much is passed on besides, and taken from the residue."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        part, kinds = table.column("part")[0].as_py(), table.column("kind").to_pylist()
        a, b, x = ([c.values.to_numpy(zero_copy_only=False) for c in table.column(name)] for name in ("a", "b", "x"))
        y = x[kinds.index(0)].copy()
        r, inside = np.zeros(len(y)), [k for k, kind in enumerate(kinds) if kind == 1]
        for k, kind in enumerate(kinds):
            if kind == 2:
                r += np.bincount(a[k], x[k], len(y))
            elif kind == 3:
                r += x[k]
        s, t, w = (np.concatenate([c[k] for k in inside]) if inside else np.zeros(0, c[0].dtype) for c in (a, b, x))
        z, r0 = np.zeros(len(y)), r
        for _ in range(1000):
            z += r
            r = np.bincount(t, r[s] * w, len(y)) if len(s) else np.zeros(len(y))
            if np.abs(r).sum() <= stop:
                break
        z, r = z * (1 + more), r * (1 + more) - r0 * more
        none = [[]] * 3
        return pa.table({"part": pa.array([part] * 3, pa.int32()), "kind": pa.array([0, 3, 4], pa.int32()), "a": pa.array(none, pa.list_(pa.int32())), "b": pa.array(none, pa.list_(pa.int32())), "x": pa.array([y + z, r, z], pa.list_(pa.float64()))})

    return run


def _crossing(batches):
    """Edges between parts beside what their sources pass on: residues of the targets, summed within the task."""
    import numpy as np
    import pyarrow as pa

    def flushed(held):
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([v for _, v in held]), len(key))
        parts, first = np.unique(key >> 32, return_index=True)
        slots, sums = np.split((key & 0xFFFFFFFF).astype(np.int32), first[1:]), np.split(total, first[1:])
        n = len(parts)
        return pa.RecordBatch.from_pydict({"part": pa.array(parts.astype(np.int32)), "kind": pa.array([2] * n, pa.int32()), "a": pa.array(slots, pa.list_(pa.int32())), "b": pa.array([[]] * n, pa.list_(pa.int32())), "x": pa.array(sums, pa.list_(pa.float64()))})

    held, size = [], 0
    for batch in batches:
        for s, p, t, w, z in zip(*(batch.column(k) for k in ("a", "p", "b", "x", "z")), strict=True):
            s, p, t, w, z = (c.values.to_numpy(zero_copy_only=False) for c in (s, p, t, w, z))
            got = z[s] * w
            some = got != 0
            held.append(((p[some].astype(np.int64) << 32) | t[some], got[some]))
            size += int(some.sum())
            if size > EDGES:
                yield flushed(held)
                held, size = [], 0
    if size:
        yield flushed(held)


def _packed(links: DataFrame, block: int) -> DataFrame:
    """part, a, p, b, x: at most about `block` edges of one part in a row, however many of them one account has."""
    chunks = links.groupBy("part").agg(F.ceil(F.count("*") / block).alias("_chunks"))  # a row a part
    cut = links.join(F.broadcast(chunks), "part").withColumn("_chunk", F.pmod(F.xxhash64("a", "p", "b"), F.col("_chunks")))
    packed = cut.groupBy("part", "_chunk").agg(F.collect_list(F.struct("a", "p", "b", "x")).alias("_e"))
    return packed.select("part", *[F.col(f"_e.{c}").alias(c) for c in ("a", "p", "b", "x")])


def pagerank(e: DataFrame, alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-9, weight: str = "montant", accounts: int = ACCOUNTS, edges: int = EDGES, block: int = BLOCK) -> DataFrame:
    """node, pagerank, summing to one. Weighted, dangling mass spread evenly; empty without edges. Rounds end where at most
    `tolerance` of all mass has not been passed on.

    Accounts are dealt by hash into parts of `accounts` accounts and `edges` edges on average. A round first runs within each part, along
    the edges that stay in it, until these have nothing left to carry; a graph of one part needs one round. Edges between parts
    are packed once into blocks in a table bucketed by the source's part, so that a round shuffles one vector a part and the sums for
    targets, never an edge. Each round is written to the shared folder; the driver sees scalars. Where residues shrink by a steady factor
    f, they point one way, and a round passes on 1 / (1 - f) times as much, the sum of the series; never again once that hasn't helped.
    """
    spark = e.sparkSession
    e = stored(e.select("source", "target", F.col(weight).cast("double").alias("w")))
    sent = e.groupBy(F.col("source").alias("node")).agg(F.sum("w").alias("out"))
    met = stored(e.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(sent, "node", "left"))
    n, m = met.count(), e.count()
    if not n:
        return met.select("node", F.lit(0.0).alias("pagerank"))
    parts = max(1, math.ceil(n / accounts), math.ceil(m / edges))
    numbered = met.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
    numbered = stored(numbered.withColumn("slot", F.row_number().over(W.partitionBy("part").orderBy("node")) - 1))
    source = numbered.where("out > 0").select(F.col("node").alias("source"), F.col("part"), F.col("slot").alias("a"), "out")
    target = numbered.select(F.col("node").alias("target"), F.col("part").alias("p"), F.col("slot").alias("b"))
    links = stored(e.join(source, "source").join(target, "target").select("part", "a", "p", "b", (F.lit(alpha) * F.col("w") / F.col("out")).alias("x")))
    inside = stored(_packed(links.where("part = p"), block).select("part", F.lit(1).alias("kind"), "a", "b", "x"))
    empty = F.array().cast("array<int>")
    start = numbered.groupBy("part").agg((F.max("slot") + 1).alias("k"))
    start = start.select("part", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0.0).alias("v")), F.struct(F.lit(3).alias("kind"), F.lit((1 - alpha) / n).alias("v")))).alias("s"), "k")
    state = start.select("part", "s.kind", empty.alias("a"), empty.alias("b"), F.array_repeat(F.col("s.v"), F.col("k")).alias("x"))
    stop = tolerance * (1 - alpha)
    table = f"blocks_{uuid.uuid4().hex}"
    with setting(spark, _BATCH, "16"), contextlib.ExitStack() as end:
        across = None
        if parts > 1:
            end.callback(spark.sql, f"drop table if exists {table}")
            buckets = min(parts, 4096)
            _packed(links.where("part != p"), block).repartition(buckets, "part").write.bucketBy(buckets, "part").option("path", f"{folder(spark)}/{table}").saveAsTable(table)
            across = spark.table(table)
        come, more, helps, outs = None, 0.0, True, []
        for _ in range(rounds):
            rows = state if come is None else state.unionByName(come)
            state = stored(rows.unionByName(inside).groupBy("part").applyInArrow(_passed_on(stop / (2 * parts), more), _ROW))
            left, out = state.agg(F.sum(F.when(F.col("kind") == 3, F.expr(_SUM))), F.sum(F.when(F.col("kind") == 4, F.expr(_SUM)))).first()
            if left + (alpha * out if across is not None else 0.0) <= stop:
                break
            if more:
                outs = outs[-1:]  # of the round before
            elif len(outs) == 1 and out > outs[0]:
                helps, outs = False, []
            more, outs = 0.0, (outs if more else [*outs, out][-3:])
            if helps and len(outs) == 3 and abs(outs[2] / outs[1] - outs[1] / outs[0]) < 0.02:
                more = min(outs[2] / outs[1] / (1 - min(outs[2] / outs[1], 0.95)), 19.0)
            if across is not None:
                z = state.where("kind = 4").select("part", F.col("x").alias("z"))
                come = across.join(z.hint("shuffle_merge"), "part").select("a", "p", "b", "x", "z").mapInArrow(_crossing, _ROW)
            state = state.where("kind in (0, 3)")
        y = state.where("kind = 0")
        total = y.agg(F.sum(F.expr(_SUM))).first()[0]
        slots = y.select("part", F.posexplode("x").alias("slot", "y"))
        return stored(numbered.join(slots, ["part", "slot"]).select("node", (F.col("y") / F.lit(total)).alias("pagerank")))
