"""Running figures of accounts that are too large for one task: a segmented prefix scan.

Every figure of block C is a running sum over events of the account: a row adds itself, leaves the seven-day frame when the
frame's time has passed, and the first row of each counterpart adds one to the number of counterparts. Events are cut by
time into chunks of bounded size; each chunk sums its own events up to each row, and the totals of the chunks before it, a
row for each chunk, are added. Moments are sums about the account's mean, so that they can be added too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import stored

#: Rows of an account that one task sorts; accounts with more are cut into chunks of about so many.
CHUNK = 500_000
#: Most chunks of one account; beyond, they grow with it.
CHUNKS = 256
#: What leaves the seven-day frame: rows at least so many microseconds older.
FRAME = 7 * 86_400_000_000 + 1
#: Sums carried over chunks: rows, amounts that aren't null, their sum and squares about the mean, failures, counterparts, rows and sum of the frame.
SUMS = ["n", "k", "s1", "s2", "bad", "new", "v", "s"]


def large(df: DataFrame, account: str, chunk: int = CHUNK) -> DataFrame:
    """account, n of the accounts with more than `chunk` rows, stored: at most rows / chunk of them."""
    return stored(df.groupBy(F.col(account).alias("account")).agg(F.count("*").alias("n")).where(F.col("n") > chunk))


def apart(df: DataFrame, account: str, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other accounts, rows of these)."""
    keys = F.broadcast(few.select(F.col("account").alias("_account"), F.lit(True).alias("_large")))  # at most rows / chunk short rows
    marked = df.join(keys, F.col(account).eqNullSafe(F.col("_account")), "left").drop("_account")
    return marked.where("_large is null").drop("_large"), marked.where("_large").drop("_large")


def scanned(df: DataFrame, few: DataFrame, account: str, time: str, order: str, amount: str, other: str, failed, chunk: int = CHUNK) -> DataFrame:
    """df, rows of the accounts of `few`, with the running sums SUMS up to and including each row (named _r_n, ...), the account's first
    time (_r_born, microseconds) and the mean that the sums are about (_r_mean).

    Rows are ordered by (time, order). failed: a condition; other: the column whose distinct values are counted, null as one of them.
    """
    name = F.coalesce(F.col(account).cast("string"), F.lit("\x00")).alias("_a")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stored(df.select(name, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), micros.alias("_r_t"), F.col(order).alias("_r_o"), F.col(amount).cast("double").alias("_r_x"), F.coalesce(failed, F.lit(False)).cast("int").alias("_r_bad"), F.col(other).alias("_other")))
    # a row for each account: its mean, its first and last time and the times that cut it
    cuts = F.percentile_approx("_r_t", F.array(*[F.lit(k / CHUNKS) for k in range(1, CHUNKS)]), 20_000)
    heads = rows.groupBy("_a").agg(F.coalesce(F.avg("_r_x"), F.lit(0.0)).alias("_r_mean"), F.min("_r_t").alias("_r_born"), F.max("_r_t").alias("_last"), F.count("*").alias("_rows"), cuts.alias("_cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(float(CHUNKS * chunk)) / F.col("_rows")).cast("int"))
    heads = F.broadcast(stored(heads.select("_a", "_r_mean", "_r_born", "_last", F.array_distinct(F.filter("_cuts", lambda _, i: (i + 1) % step == 0)).alias("_cuts"))))  # at most rows / chunk accounts
    counterparts = rows.groupBy("_a", "_other").agg(F.min(F.struct("_r_t", "_r_o")).alias("m"))
    rows = rows.join(heads, "_a")
    d = F.col("_r_x") - F.col("_r_mean")
    zero, none = F.lit(0.0), F.lit(0)

    def event(at, kind, place, **sums):
        """A place in the order (time, kind: frames end before rows begin, place among equals, counterparts before their row) and what is added."""
        given = {"n": none, "k": none, "s1": zero, "s2": zero, "bad": none, "new": none, "v": none, "s": zero} | sums
        return F.struct(at.alias("t"), F.lit(kind).alias("kind"), place.alias("o"), *[given[c].alias(c) for c in SUMS])

    # one row a counterpart, by partial minima; its event stands before the rows that are equal to its first
    firsts = counterparts.join(heads, "_a").select("_a", "_cuts", event(F.col("m._r_t"), 1, F.col("m._r_o"), new=F.lit(1)).alias("e"), F.lit(0).alias("is_row"))
    own = event(F.col("_r_t"), 1, F.col("_r_o"), n=F.lit(1), k=F.col("_r_x").isNotNull().cast("int"), s1=F.coalesce(d, zero), s2=F.coalesce(d * d, zero), bad=F.col("_r_bad"), v=F.lit(1), s=F.coalesce("_r_x", zero))
    leave = event(F.col("_r_t") + FRAME, 0, F.col("_r_o"), v=F.lit(-1), s=-F.coalesce("_r_x", zero))
    events = rows.select("_a", "_cuts", own.alias("e"), F.lit(1).alias("is_row"), F.struct("_row.*", "_r_mean", "_r_born").alias("_row"))
    events = events.unionByName(rows.where(F.col("_r_t") + FRAME <= F.col("_last")).select("_a", "_cuts", leave.alias("e"), F.lit(0).alias("is_row")), allowMissingColumns=True)
    events = events.unionByName(firsts, allowMissingColumns=True)
    events = events.select("_a", F.size(F.filter("_cuts", lambda c: c < F.col("e.t"))).alias("_chunk"), "e.*", "is_row", "_row")
    totals = stored(events.groupBy("_a", "_chunk").agg(*[F.sum(c).alias(c) for c in SUMS]))
    before = W.partitionBy("_a").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)  # at most CHUNKS rows an account
    carried = totals.select("_a", "_chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_c_{c}") for c in SUMS])
    upto = W.partitionBy("_a", "_chunk").orderBy("t", "kind", "o", "is_row").rowsBetween(W.unboundedPreceding, 0)
    inner = events.select("_a", "_chunk", "is_row", "_row", *[F.sum(c).over(upto).alias(f"_i_{c}") for c in SUMS]).where("is_row = 1")
    out = inner.join(carried, ["_a", "_chunk"])  # dealt like the windows
    return out.select("_row.*", *[(F.col(f"_i_{c}") + F.col(f"_c_{c}")).alias(f"_r_{c}") for c in SUMS])
