"""The transfer graph: edges, relay accounts, PageRank, density clusters, sub-graphs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import reasons
from ..schema import clip
from ..tables import stored
from .ranks import pagerank
from .stats import exact_quantiles, percent_rank, quantile

FEATURES = ["in_degree", "out_degree", "in_montant", "out_montant", "ratio_transit", "transit_score", "pagerank"]
# Weights of the ensemble.
WEIGHTS = {"transit": 0.35, "diversite": 0.25, "pagerank": 0.20, "cluster": 0.20}


def edges(df: DataFrame) -> DataFrame:
    """source, target, nb_tx, montant of the successful transfers between two accounts."""
    ok = df.where((F.col("TRANSFER_STATUS") == "TS") & F.col("SENDER_USER_ID").isNotNull() & F.col("RECEIVER_USER_ID").isNotNull() & (F.col("SENDER_USER_ID").cast("string") != F.col("RECEIVER_USER_ID").cast("string")))
    return ok.groupBy(F.col("SENDER_USER_ID").alias("source"), F.col("RECEIVER_USER_ID").alias("target")).agg(F.count("*").alias("nb_tx"), F.sum(F.coalesce(F.col("TRANSACTION_AMOUNT").try_cast("double"), F.lit(0.0))).alias("montant"))


def nodes(e: DataFrame) -> DataFrame:
    """Degrees and amounts of every account, by one shuffle of both ends."""
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("out")), F.struct(F.col("target").alias("node"), F.lit(0).alias("out")))).alias("x"), "montant", "nb_tx").select("x.*", "montant", "nb_tx")
    out, into = F.col("out") == 1, F.col("out") == 0
    zero = F.lit(0.0)
    return ends.groupBy("node").agg(F.count_if(into).alias("in_degree"), F.count_if(out).alias("out_degree"), F.sum(F.when(into, F.col("montant")).otherwise(zero)).alias("in_montant"), F.sum(F.when(out, F.col("montant")).otherwise(zero)).alias("out_montant"), F.sum(F.when(into, F.col("nb_tx")).otherwise(0)).alias("in_tx"), F.sum(F.when(out, F.col("nb_tx")).otherwise(0)).alias("out_tx"))


def transit(n: DataFrame) -> DataFrame:
    """Accounts that both receive and send, and how much of what comes in goes out."""
    n = n.withColumn("est_transit", (F.col("in_degree") > 0) & (F.col("out_degree") > 0)).where("est_transit")
    n = n.withColumn("ratio_transit", F.col("out_montant") / (F.col("in_montant") + 1))
    return n.withColumns({"transit_score": 1 - clip(F.abs(F.col("ratio_transit") - 1), 0, 1), "diversite": F.log1p(F.least("in_degree", "out_degree").cast("double"))})


def between(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes of n."""
    s = n.select("node").distinct()
    return e.join(s.withColumnRenamed("node", "source"), "source", "left_semi").join(s.withColumnRenamed("node", "target"), "target", "left_semi")


def robust_scaled(df: DataFrame, columns: list[str], frozen: dict | None = None) -> tuple[DataFrame, dict]:
    """(x - median) / interquartile range, exact; frozen holds [median, range] of each column."""
    if frozen is None:
        got = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).get(None, {})
        frozen = {c: [got[c][1], (got[c][2] - got[c][0]) or 1.0] if got.get(c) else [0.0, 1.0] for c in columns}
    return df.withColumns({f"{c}_scaled": (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in frozen.items()}), frozen


#: Core points of a cell that stand for it when cells are linked first.
REPRESENTATIVES = 16


def _components(nodes_: DataFrame, links: DataFrame) -> DataFrame:
    """c, root: the least node of its component, by repeated minima and jumps. links have both directions."""
    label = nodes_.select("c", F.col("c").alias("root"))
    while True:
        low = links.join(label.withColumnRenamed("c", "o"), "o").groupBy("c").agg(F.min("root").alias("m"))
        step = label.join(low, "c", "left").select("c", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        far = label.select(F.col("c").alias("root"), F.col("root").alias("r2"))
        new = stored(step.join(far, "root", "left").select("c", "was", F.least("root", F.coalesce("r2", "root")).alias("root")))
        label = new.select("c", "root")
        if new.where("was != root").isEmpty():
            return label


def dbscan(df: DataFrame, columns: list[str], eps: float = 1.5, least: int = 5, id: str = "node", seen: dict | None = None) -> DataFrame:
    """id, cluster (-1: noise), numbered by their first core point in the order of id. Rows without a coordinate are noise.

    Points lie in cells over all columns whose diagonal is eps, so points of one cell are neighbours: all points of a cell with
    `least` of them are core, without a comparison, and core points of a cell are in one cluster. Only points of smaller cells are
    compared with those of cells within eps. Cells are linked by a few core points of each first, and all core points are compared
    only where that leaves neighbouring cells in different clusters. A border point takes the least cluster among its core
    neighbours. seen: gets the number of cells, of pairs of near cells, and of points that were compared.
    """
    d = len(columns)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    names = [f"x{k}" for k in range(d)]
    p = df.select(F.col(id).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)])
    sound = p.dropna().where(F.greatest(*[F.abs(x) for x in names], F.lit(0.0)) < 1e15 * side)
    keyed = stored(sound.withColumn("cell", F.array(*[F.floor(F.col(x) / side) for x in names])))
    cells = stored(keyed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()))
    # cells within eps differ by at most `reach` in each column; candidates meet in blocks of the columns that tell most cells apart
    reach = 1 + math.isqrt(d)
    block = lambda k: F.floor(F.get("cell", F.lit(k)) / reach)
    spread = cells.agg(*[F.countDistinct(block(k)) for k in range(d)]).first()
    told = sorted(range(d), key=lambda k: (-spread[k], k))[: min(3, d)]
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in itertools.product((-1, 0, 1), repeat=len(told))])
    left = cells.select("c", "cell", F.array(*map(block, told)).alias("b"))
    right = cells.select(F.col("c").alias("o"), F.col("cell").alias("other"), F.explode(F.transform(shifts, lambda s: F.zip_with(F.array(*map(block, told)), s, lambda u, v: u + v))).alias("b"))
    gap = sum((F.pow(F.greatest(F.abs(F.get("cell", F.lit(k)) - F.get("other", F.lit(k))) - 1, F.lit(0)).cast("double"), F.lit(2.0)) for k in range(d)), F.lit(0.0))
    pairs = stored(left.join(right, "b").where(gap <= d).select("c", "o"))
    p = keyed.join(cells, "cell").select("id", "c", "n", *names)
    q = p.select(F.col("c").alias("o"), F.col("id").alias("other"), *[F.col(x).alias(f"y{x}") for x in names])
    close = sum(((F.col(x) - F.col(f"y{x}")) * (F.col(x) - F.col(f"y{x}")) for x in names), F.lit(0.0)) <= eps * eps
    sparse = p.where(F.col("n") < least)
    counted = sparse.join(pairs, "c").join(q, "o").where(close).groupBy("id").agg(F.count("*").alias("near"))
    p = stored(p.join(counted, "id", "left").select("id", "c", "n", *names, ((F.col("n") >= least) | (F.coalesce("near", F.lit(0)) >= least)).alias("core")))
    core = p.where("core").select("id", "c", *names)
    full = core.groupBy("c").agg(F.min("id").alias("first"))
    near = pairs.where("c < o").join(full.select("c"), "c", "left_semi").join(full.select(F.col("c").alias("o")), "o", "left_semi")
    near = stored(near.select("c", "o"))

    def linked(asked: DataFrame, points: DataFrame) -> DataFrame:
        """Of pairs of cells, those with two of the points within eps."""
        other = points.select(F.col("c").alias("o"), *[F.col(x).alias(f"y{x}") for x in names])
        return stored(asked.join(points, "c").join(other, "o").where(close).select("c", "o").distinct())

    few = core.withColumn("_k", F.row_number().over(W.partitionBy("c").orderBy("id"))).where(F.col("_k") <= REPRESENTATIVES)
    found = linked(near, few)
    label = _components(full, found.union(found.select("o", "c")))
    apart = near.join(label, "c").join(label.select(F.col("c").alias("o"), F.col("root").alias("r2")), "o").where("root != r2").select("c", "o")
    more = linked(apart, core)
    if not more.isEmpty():
        found = found.union(more)
        label = _components(full, found.union(found.select("o", "c")))
    if seen is not None:
        seen |= {"cells": cells.count(), "pairs": pairs.count(), "compared": sparse.count(), "apart": apart.count()}
    roots = label.join(full, "c").groupBy("root").agg(F.min("first").alias("first"))
    numbers = roots.withColumn("cluster", F.row_number().over(W.orderBy("first")) - 1).select("root", "cluster")  # a row for each cluster
    label = stored(label.join(numbers, "root").select("c", "cluster"))
    inside = core.join(label, "c").select("id", "cluster")
    other = core.join(label, "c").select(F.col("c").alias("o"), "cluster", *[F.col(x).alias(f"y{x}") for x in names])
    border = p.where("not core").join(pairs, "c").join(other, "o").where(close).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return df.select(F.col(id).alias("id")).join(inside.unionByName(border), "id", "left").select(F.col("id").alias(id), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def candidates(t: DataFrame, share: float = 0.90, least_degree: int = 3, most: int = 50_000) -> DataFrame:
    """Relays with a high transit score and enough counterparts on both sides, at most `most` of them."""
    x = t.where((F.col("transit_score") >= F.lit(quantile(t, "transit_score", share))) & (F.least("in_degree", "out_degree") >= least_degree))
    return x.orderBy(F.col("transit_score").desc(), "node").limit(most)


def score(t: DataFrame, budget: int = 500) -> DataFrame:
    """Ensemble score of relays with pagerank and cluster, the best `budget` flagged, with reasons."""
    for value, name in (("transit_score", "r_transit"), ("diversite", "r_diversite"), ("pagerank", "r_pagerank")):
        t = percent_rank(t, value, name).withColumn(name, F.col(name) * 100)
    member = F.when(F.col("cluster") >= 0, 100.0).otherwise(0.0)
    total = WEIGHTS["transit"] * F.col("r_transit") + WEIGHTS["diversite"] * F.col("r_diversite") + WEIGHTS["pagerank"] * F.col("r_pagerank") + WEIGHTS["cluster"] * member
    t = stored(t.withColumn("RISK_SCORE", clip(total, 0, 100)))
    best = t.orderBy(F.col("RISK_SCORE").desc(), "node").limit(budget).select("node", F.lit(1).alias("_a"))
    t = t.join(best, "node", "left").withColumn("ALERTE", F.coalesce("_a", F.lit(0))).drop("_a")
    # Texts and bounds of the rules.
    why = reasons(
        "profil de transit atypique",
        (F.col("transit_score") > 0.8, "relais quasi-parfait (entrée≈sortie)"),
        (F.col("in_degree") >= 10, F.format_string("%d sources", "in_degree")),
        (F.col("out_degree") >= 10, F.format_string("%d destinations", "out_degree")),
        (F.col("cluster") >= 0, "membre d'un réseau organisé"),
        (F.col("r_pagerank") > 95, "position centrale dans le réseau"),
    )
    return t.withColumn("RAISON", F.when(F.col("ALERTE") == 1, why))


def cluster_summary(scored: DataFrame) -> DataFrame:
    return scored.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("taille"), F.avg("RISK_SCORE").alias("risque_moyen"), F.avg(F.col("in_degree") + F.col("out_degree")).alias("degre_moyen"), F.sum("in_montant").alias("montant")).orderBy(F.col("taille").desc(), "cluster")


def subgraph(scored: DataFrame, e: DataFrame, cluster: int, external: bool = True, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a cluster: its nodes, with those one step away if external, at most `most` nodes:
    those of the cluster by risk, then others by degree."""
    core = scored.where(F.col("cluster") == cluster).select("node", F.col("RISK_SCORE").alias("_risk"))
    s, t = core.select(F.col("node").alias("source"), F.lit(1).alias("_s")), core.select(F.col("node").alias("target"), F.lit(1).alias("_t"))
    marked = e.join(s, "source", "left").join(t, "target", "left")
    near = marked.where("_s = 1 or _t = 1" if external else "_s = 1 and _t = 1").drop("_s", "_t")
    degree = near.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("_degree"))
    all_ = degree.join(core, "node", "full").orderBy(F.col("_risk").desc_nulls_last(), F.col("_degree").desc_nulls_last(), "node").limit(most)
    kept = stored(all_.select("node"))
    known = kept.join(scored, "node", "left").withColumn("_external", F.col("RISK_SCORE").isNull())
    return known, near.join(kept.withColumnRenamed("node", "source"), "source", "left_semi").join(kept.withColumnRenamed("node", "target"), "target", "left_semi")


def displayed(known: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with size, edges with width) as a drawing of a sub-graph scales them."""
    # The scales.
    ends = e.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes_ = known.select("node").join(ends, "node", "left").select("node", (12 + F.least(F.coalesce("degree", F.lit(0)), F.lit(40)) * 1.4).alias("size"))
    top = e.agg(F.max("montant").alias("top"))
    width = 1 + 5 * F.coalesce(F.expr("try_divide(ln(1 + montant), ln(1 + top))"), F.lit(0.0))
    return nodes_, e.join(F.broadcast(top)).select("source", "target", width.alias("width"))  # one row


def fuzzy(df: DataFrame, **wanted: list[str]) -> DataFrame:
    """df with the columns that the aliases name, in whatever case; missing ones are left out."""
    from ..sources.transfers import resolve

    return df.select(*[F.col(f"`{have}`").alias(name) for name, aliases in wanted.items() if (have := resolve(df, name, *aliases))])
