"""What the operators share: stored intermediate tables, components, salted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import folder, scratch, setting, stored

__all__ = ["among", "bare", "components", "folder", "fresh", "keyed", "numbered", "parts_of", "partitions", "ranked", "scratch", "setting", "small_batches", "stored"]

#: A table of at most so many short rows is broadcast, a larger one shuffled.
SMALL_ROWS = 150_000


#: So many ids are broadcast, more are shuffled.
SMALL_IDS = 1_000_000


def among(texts: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """texts joined with a table on an id. Only ids are ever broadcast, and only a counted number of them: they pick the
    texts that take part, so that the join moves no others."""
    ids = stored(table.select(key).distinct())
    if ids.count() <= SMALL_IDS:
        texts = texts.join(F.broadcast(ids), key, "left_semi")
    return texts.join(table, key)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a key of each row, stored, so that the keys stay the same however often it is read."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, id: str, name: str) -> DataFrame:
    """df with a key of each row: the id where each row has one of its own, else a number stored with a copy of the rows."""
    twice = df.groupBy(df[id].alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")
    return df.withColumn(name, df[id]) if twice.isEmpty() else numbered(df, name)


#: Bytes of text that one part of a corpus holds on average.
PART_BYTES = 32_000_000


def parts_of(spark: SparkSession, total: int, size: int = PART_BYTES) -> int:
    """Into how many parts texts of `total` bytes are dealt: as many as shuffle partitions, and more where a part would hold over `size` on average."""
    return max(partitions(spark), -(-total // size))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of one Arrow batch, so that very long texts don't pile up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bare(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Only the columns that an operator reads, under names that can't clash with others of df."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def _forest(batches):
    """Edges of a partition -> a star for each component that they form there."""
    import numpy as np
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (a := root(a)) != (c := root(c)):
                up[max(a, c)] = min(a, c)
    keys = list(up)
    step = 50_000
    for k in range(0, len(keys), step):
        part = keys[k : k + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(part, np.int64)), pa.array(np.array([root(x) for x in part], np.int64))], ["u", "v"])


#: Edges that one task may join.
LOCAL_EDGES = 400_000


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of edges (u, v), both long: node, root (the smallest node of its component).

    First each partition keeps a spanning star of what it has. If these have at most `local` edges (16 bytes each) one
    task joins them; else rounds of large-star and small-star (Kiveris et al. 2014) run on the joined tables until
    nothing changes. Nodes without an edge are left out.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long"))
    if now.count() <= local:
        now = stored(now.coalesce(1).mapInArrow(_forest, "u long, v long"))
        return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        if state == tuple(seen) or seen["n"] == seen["d"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def ranked(df: DataFrame, key: str, order: list[str], salt: Column, name: str, salts: int = 512) -> DataFrame:
    """df with name: rows of the same key numbered from 0, in the order of salt and then of order.

    A key may hold any share of the rows: they are numbered within (key, salt), and the numbers of the earlier
    salts, at most `salts` a key, are added.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    sums = df.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    base = sums.select(key, "_salt", (F.sum("_n").over(W.partitionBy(key).orderBy("_salt")) - F.col("_n")).alias("_base"))
    inner = df.withColumn("_at", F.row_number().over(W.partitionBy(key, "_salt").orderBy(*order)) - 1)
    return inner.join(base, [key, "_salt"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_salt", "_at", "_base")
