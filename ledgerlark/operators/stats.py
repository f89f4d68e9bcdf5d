"""Ranks, calibration and the quality of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import clip
from ..tables import stored

#: Up to so many values, quantiles come from one aggregation whose buffer holds them; beyond, values are narrowed down by counting.
SMALL_VALUES = 2_000_000
#: Up to so many chosen rows are broadcast.
SMALL_ROWS = 150_000


def exact_quantiles(df: DataFrame, columns: list[str], steps: list[float], group: str | None = None, small: int = SMALL_VALUES) -> dict:
    """{group value (None without group): {column: the value at each step}}, interpolated linearly; a column without values gives None.

    No task holds the values of a group: a pass counts the values in equal bins of each bracket that holds a wanted rank, and
    the bins that hold one are the brackets of the next pass, until a bracket has one value. The driver gets a bounded table a pass.
    """
    key = F.lit(None).cast("string") if group is None else F.col(group)
    wide = df.select(key.alias("g"), *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    names = [f"c{k}" for k in range(len(columns))]
    heads = wide.groupBy("g").agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).collect()
    out: dict = {h["g"]: dict.fromkeys(columns) for h in heads}
    if sum(h[f"n_{c}"] for h in heads for c in names) <= small:
        for r in wide.groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(float(q)) for q in steps])).alias(c) for c in names]).collect():
            out[r["g"]] = {c: r[n] for c, n in zip(columns, names, strict=True)}
        return out
    found: dict[tuple, float] = {}
    brackets = []
    for h in heads:
        for k, c in enumerate(names):
            if n := h[f"n_{c}"]:
                at = {x for q in steps for x in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}
                brackets.append((h["g"], k, h[f"lo_{c}"], h[f"hi_{c}"], 0, sorted(at)))
    long_ = wide.select("g", F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(n).alias("x")) for k, n in enumerate(names)])).alias("v")).select("g", "v.c", "v.x").where("x is not null")
    kind = wide.schema["g"].dataType.simpleString()
    while brackets:
        bins = max(16, 50_000 // len(brackets))
        table = df.sparkSession.createDataFrame([(i, *b[:4]) for i, b in enumerate(brackets)], f"i int, bg {kind}, bc int, lo double, hi double")
        inside = long_.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("bg")) & (F.col("c") == F.col("bc")) & F.col("x").between(F.col("lo"), F.col("hi")))  # at most len(brackets) rows
        at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
        rows: dict[int, list] = {}
        for i, b, n, lo, hi in inside.groupBy("i", at.alias("bin")).agg(F.count("*"), F.min("x"), F.max("x")).collect():
            rows.setdefault(i, []).append((b, n, lo, hi))
        after = []
        for i, (g, c, _, _, above, ranks) in enumerate(brackets):
            for _, n, lo, hi in sorted(rows.get(i, [])):
                mine = [r for r in ranks if above <= r < above + n]
                if mine and lo == hi:
                    found.update({(g, c, r): lo for r in mine})
                elif mine:
                    after.append((g, c, lo, hi, above, mine))
                above += n
        brackets = after
    for h in heads:
        for k, c in enumerate(columns):
            if n := h[f"n_c{k}"]:
                place = [q * (n - 1) for q in steps]
                ends = [(found[h["g"], k, int(x)], found[h["g"], k, min(int(x) + 1, n - 1)], x - int(x)) for x in place]
                out[h["g"]][c] = [a if a == b or not t else (1 - t) * a + t * b for a, b, t in ends]
    return out


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """One exact quantile; None without values."""
    got = exact_quantiles(df, [column], [q]).get(None, {}).get(column)
    return got[0] if got else None


def percent_rank(df: DataFrame, value: str, name: str, group: str | None = None) -> DataFrame:
    """Average-rank percentile of value, without a global window.

    Values are counted first; distinct values are cut into ranges whose sums, one row a range, give the
    ranks before each range, so a task ranks one range of one group. Ranks of common values are broadcast, all others joined.
    """
    if group is not None:
        df, key = df, F.col(group)
    else:
        key = F.lit(0)
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull() & key.isNotNull()).groupBy(key.alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.groupBy("_g").agg(F.percentile_approx("_v", F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5)), 10_000).alias("_cuts"))
    counts = counts.join(F.broadcast(cuts), "_g").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = counts.groupBy("_g", "_part").agg(F.sum("_n").alias("_s"))
    offsets = sums.select("_g", "_part", (F.sum("_s").over(W.partitionBy("_g").orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy("_g")).alias("_total"))
    inner = F.sum("_n").over(W.partitionBy("_g", "_part").orderBy("_v")) - F.col("_n")
    ranks = counts.withColumn("_in", inner).join(F.broadcast(offsets), ["_g", "_part"])
    ranks = ranks.select("_g", "_v", "_n", ((F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2) / F.col("_total")).alias("_rank"))
    return _looked_up(df, value, key, stored(ranks), name)


#: A value held by at least one row in so many is broadcast; there can't be more of them than this.
HEAVY = 4_000


def _looked_up(df: DataFrame, value: str, key, ranks: DataFrame, name: str) -> DataFrame:
    """df with the rank of its value. A value that many rows hold never gathers them in one task: ranks of such values are broadcast to
    their rows, and only rows of other values are dealt by value; rows without a value stay where they are."""
    total = ranks.agg(F.sum("_n")).first()[0] or 0
    heavy = (F.col("_n") * HEAVY >= F.lit(total)) & (F.col("_n") > 1)
    keyed = df.withColumn("_key", key)
    same = (F.col("_key") == F.col("_g")) & (F.col(value) == F.col("_v"))
    some = F.col(value).isNotNull() & F.col("_key").isNotNull()
    common = ranks.where(heavy).select("_g", "_v", "_rank")
    if total and common.isEmpty():
        common = None
    rare = keyed.where(some)
    if common is not None:
        rare = rare.join(F.broadcast(common), same, "left_anti")
    out = rare.join(ranks.where(~heavy).select("_g", "_v", "_rank"), same, "left")
    rest = keyed.where(~some).withColumn("_rank", F.lit(None).cast("double"))
    if common is not None:
        rest = rest.unionByName(keyed.join(F.broadcast(common), same).drop("_g", "_v"))
    return out.drop("_g", "_v").unionByName(rest).withColumn(name, F.col("_rank")).drop("_rank", "_key")


def rescale(df: DataFrame, value: str, name: str) -> tuple[DataFrame, dict]:
    """Min-max to 0..100; the ends are returned for later use."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    x = F.lit(0.0) if lo is None or lo == hi else (F.col(value) - lo) / (hi - lo) * 100
    return df.withColumn(name, clip(x, 0, 100)), {"method": "minmax", "min": lo, "max": hi}


def calibrate(df: DataFrame, value: str, name: str) -> tuple[DataFrame, dict]:
    """Percentile score 0..100 and the 101 quantiles that rescore() compares with."""
    quantiles = exact_quantiles(df, [value], [k / 100 for k in range(101)]).get(None, {}).get(value)
    return percent_rank(df, value, name).withColumn(name, F.col(name) * 100), {"method": "percentile", "quantiles": quantiles}


def rescore(df: DataFrame, value: str, name: str, frozen: dict) -> DataFrame:
    """Score of new values against frozen ends or quantiles."""
    if frozen["method"] == "minmax":
        return df.withColumn(name, clip((F.col(value) - frozen["min"]) / (frozen["max"] - frozen["min"]) * 100, 0, 100))
    q = frozen["quantiles"]
    below = F.size(F.filter(F.array(*[F.lit(float(x)) for x in q]), lambda x: x < F.col(value)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.least(below / (len(q) - 1) * 100, F.lit(100.0))))


def top_per_group(df: DataFrame, group: str, score: str, n: int, tie: str, name: str = "ALERTE", salts: int = 64) -> DataFrame:
    """1 for the n best rows of each group by (score, tie), else 0; rows without score, group or tie are never chosen.

    A group may hold any share of the rows: the n best of each (group, salt) are found first, then the n best of these. Rows
    that tie doesn't tell apart come out as often as they went in, and no more than n of a group are chosen.
    """
    best = df.where(F.col(score).isNotNull() & F.col(group).isNotNull() & F.col(tie).isNotNull()).select(F.col(group).alias("_g"), F.col(score).alias("_s"), F.col(tie).alias("_t"))
    best = best.withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(salts)))
    for keys in (["_g", "_salt"], ["_g"]):  # one more than n, to see whether the last one has equals that are not chosen
        best = best.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_s").desc(), "_t"))).where(F.col("_k") <= n + 1)
    best = stored(best.groupBy("_g", "_s", "_t").agg(F.count_if(F.col("_k") <= n).alias("_take"), (F.max("_k") > n).alias("_cut")).where("_take > 0"))
    count, cut = best.agg(F.count("*"), F.count_if("_cut")).first()
    small = F.broadcast if count <= SMALL_ROWS else lambda x: x
    same = (F.col(group) == F.col("_g")) & (F.col(score) == F.col("_s")) & (F.col(tie) == F.col("_t"))
    chosen = df.join(small(best), same, "left").withColumn(name, F.col("_g").isNotNull().cast("int"))
    if cut:
        # equal rows of which only some are chosen: they are numbered, and the first of them taken
        some = F.coalesce(F.col("_cut"), F.lit(False))
        equal = stored(chosen.where(some).withColumn("_at", F.monotonically_increasing_id()))
        first = equal.select("_g", "_s", "_t", "_take", "_at").withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)))
        for keys in (["_g", "_s", "_t", "_salt"], ["_g", "_s", "_t"]):
            first = first.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_at"))).where(F.col("_k") <= F.col("_take"))
        first = stored(first.select(F.col("_at").alias("_hit")))  # at most n a group
        equal = equal.join(first, F.col("_at") == F.col("_hit"), "left").withColumn(name, F.col("_hit").isNotNull().cast("int")).drop("_at", "_hit")
        chosen = chosen.where(~some).unionByName(equal)
    return chosen.drop("_g", "_s", "_t", "_take", "_cut")


def page(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(min(limit, 5000))


def curve(df: DataFrame, score: str, label: str, gains: bool = False, group: str | None = None) -> DataFrame:
    """score, tp, fp (and gain: how many of tp have this very score) of every threshold: scores are counted, cut into ranges, and cumulated within
    each range. With group, a column of few values, one curve for each of these."""
    keys = [] if group is None else [group]
    per = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = per.groupBy(*keys).agg(F.percentile_approx("score", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000).alias("_cuts"))
    per = per.join(F.broadcast(cuts), keys or None).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("score")))).drop("_cuts")
    sums = per.groupBy(*keys, "_part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    # one row a range
    above = W.partitionBy(*keys).orderBy(F.col("_part").desc())
    offsets = sums.select(*keys, "_part", (F.sum("sp").over(above) - F.col("sp")).alias("p0"), (F.sum("sn").over(above) - F.col("sn")).alias("n0"))
    down = W.partitionBy(*keys, "_part").orderBy(F.col("score").desc())
    out = per.join(F.broadcast(offsets), [*keys, "_part"]).withColumns({"tp": F.sum("p").over(down) + F.col("p0"), "k": F.sum("n").over(down) + F.col("n0")})
    return out.select(*keys, "score", "tp", (F.col("k") - F.col("tp")).alias("fp"), *([F.col("p").alias("gain")] if gains else []))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, by the rank formula."""
    ranked = percent_rank(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "_r")
    p, n, s = F.sum(F.col(label).cast("double")), F.count("*").cast("double"), F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return ranked.agg(p.alias("p"), n.alias("n"), s.alias("s")).select(F.expr("try_divide(s * n - p * (p + 1) / 2, p * (n - p))").alias("auc"))


def precision_recall(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, precision, recall, f1 of every threshold."""
    total = df.where(F.col(score).isNotNull()).agg(F.sum(F.col(label).cast("long")).alias("all"))
    out = curve(df, score, label).join(F.broadcast(total))
    out = out.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.expr("try_divide(tp, all)").alias("recall"))
    return out.withColumn("f1", F.expr("try_divide(2 * precision * recall, precision + recall)"))


def average_precision(df: DataFrame, score: str, label: str, group: str | None = None) -> DataFrame:
    """The sum over thresholds of precision times the gain in recall: one row, or one for each value of group, of which there are few."""
    keys = [] if group is None else [group]
    total = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.sum(F.col(label).cast("long")).alias("all"))
    points = curve(df, score, label, True, group)
    area = points.groupBy(*keys).agg(F.sum(F.col("gain") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return area.join(F.broadcast(total), keys or None).select(*keys, F.expr("try_divide(s, all)").alias("pr_auc"))  # a row each


def numbered(df: DataFrame, *by, name: str = "_at") -> DataFrame:
    """df, stored, with the place of each row in the order of by, from 0: rows are cut into ranges, numbered within each, and a range adds the sizes
    of those before it. Rows that by doesn't tell apart come in any order."""
    cut = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1 + F.col("_before")
    return stored(cut.join(F.broadcast(before), "_part").withColumn(name, at).drop("_part", "_before"))


def permutation_importance(df: DataFrame, columns: list[str], label: str, key: str, scored, score: str, used: list[str] | None = None) -> DataFrame:
    """column, pr_auc, importance: how much PR-AUC falls when a column's values are dealt anew; a row for each column, and one of null with that of the
    values as they are. Rows without label don't count; none without rows.

    All rows take part. They stand in the order of md5(key), which is random, and column k of K gives its value to the row
    1 + k * (n - 1) / K places on, so equal input is dealt equally everywhere. Each row sends its values in one exchange; scored(df), which
    adds the column score, then sees each row once for each column. Columns that the scores don't depend on (a tree model reads those of its splits only)
    change nothing when they are dealt: where used names the others, these alone are sent and scored, and scored(df) gets null for the rest.
    """
    ks = [k for k, c in enumerate(columns) if used is None or c in used]
    rest = [k for k in range(len(columns)) if k not in ks]
    own = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_y"), F.col(key).cast("string").alias("_key"), *[F.col(f"`{columns[k]}`") for k in ks])
    at = numbered(own, F.md5("_key"), F.col("_key")).drop("_key")
    n, width = at.count(), len(columns)
    to = {k: F.pmod(F.col("_at") + 1 + k * (n - 1) // width, F.lit(max(n, 1))) for k in ks}
    if ks:
        sent = at.select(F.explode(F.array(*[F.struct(to[k].alias("_at"), F.lit(k).alias("k"), F.col(f"`{columns[k]}`").cast("double").alias("v")) for k in ks])).alias("s")).select("s.*")
        got = sent.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_got"))  # an entry a column
        at = at.join(got, "_at")
    else:
        at = at.withColumn("_got", F.lit(None).cast("map<int,double>"))
    dealt = at.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in (-1, *ks)])))
    dealt = dealt.withColumns({c: F.when(F.col("_k") == k, F.element_at("_got", k)).otherwise(F.col(f"`{c}`").cast("double")) if k in ks else F.lit(None).cast("double") for k, c in enumerate(columns)})
    area = average_precision(scored(dealt.drop("_got", "_at")).select("_k", "_y", score), score, "_y", "_k")
    area = area.withColumn("_base", F.max(F.when(F.col("_k") == -1, F.col("pr_auc"))).over(W.partitionBy()))  # a row a column
    area = area.withColumn("_k", F.explode(F.when(F.col("_k") == -1, F.array(*[F.lit(k) for k in (-1, *rest)])).otherwise(F.array("_k"))))
    names = F.array(*[F.lit(c) for c in columns])
    return area.select(F.get(names, F.col("_k")).alias("column"), "pr_auc", (F.col("_base") - F.col("pr_auc")).alias("importance"))


def describe(df: DataFrame, columns: list[str], steps: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A row for each column: count, mean, std, min, max and the exact percentiles, named p25 and so on."""
    got = exact_quantiles(df, columns, [0.0, *steps, 1.0]).get(None, {})
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("count"), F.avg(F.col(c)).alias("mean"), F.stddev_samp(F.col(c)).alias("std"), *[F.lit(got[c][k] if got.get(c) else None).cast("double").alias(n) for k, n in enumerate(["min", *[f"p{q * 100:g}" for q in steps], "max"])]) for c in columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    return precision_recall(df, score, label).orderBy(F.col("f1").desc_nulls_last(), F.col("score").desc()).limit(1)


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, is_one = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(hit & is_one).alias("tp"), F.count_if(hit & ~is_one).alias("fp"), F.count_if(~hit & is_one).alias("fn"), F.count_if(~hit & ~is_one).alias("tn"))


def class_weights(df: DataFrame, label: str, rare: float = 0.02) -> dict:
    """share of ones, and the weight of a one: the ratio of the classes when ones are rare, else balanced."""
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    mode = "scale_pos_weight" if share < rare else "balanced"
    weight = (1 - share) / share if share else 1.0
    return {"share": share, "mode": mode, "weight": weight}


__all__ = ["average_precision", "best_f1", "calibrate", "class_weights", "confusion", "curve", "describe", "exact_quantiles", "numbered", "page", "permutation_importance", "quantile", "percent_rank", "precision_recall", "rescale", "rescore", "roc_auc", "top_per_group"]
