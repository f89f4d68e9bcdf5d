"""Quality by importance resampling of hashed n-gram models, sampled by Gumbel top-k.

Two generative models are counted: one of the raw texts, all of them, and one of the target, at most SAMPLE of the
texts labelled good, chosen by a hash of their id.
Both are bags of hashed n-grams in BUCKETS buckets (Xie et al. 2023): words and pairs of words, and runs of one to
three word shapes (case, digits, punctuation at the end, length, and whether a word repeats the one before). A text's
importance is the ratio of its probabilities under the two, so its log is a sum over all n-grams. Resampling without replacement
keeps the k texts with the greatest log ratio + Gumbel noise, where the noise is drawn from a hash of the id: a text is drawn with
a probability in proportion to its importance, so short and doubtful texts are kept by chance and clear ones are not.
k is a share of the texts that have n-grams: a parameter, or else the share of good ones among the labelled rows. The k-th key is
found exactly by counting keys in ever finer bins.

Defined cases: null, empty and blank texts have no n-gram and are rejected; without any good label there is no target and
nothing is rejected but those; ties at the k-th key are all kept; rows with one id and text share their fate; labels of unknown
ids and labels other than 0 and 1 don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .shared import bare, fresh, small_batches, stored

BUCKETS, PRIOR, SAMPLE = 1 << 16, 0.5, 40_000

_FLAG = np.zeros(256, np.uint8)
_FLAG[97:123] = 1
_FLAG[65:91] = 2
_FLAG[48:58] = 4
_FLAG[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_FLAG[128:] = 16


def grams(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and its row."""
    w = A.words(block)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, row = block.data, w.row()
    flag = _FLAG[data]
    have = np.bitwise_or.reduceat(flag[~A._WHITE[data]], np.cumsum(w.length) - w.length).astype(A.U64)
    last = data[w.start + w.length - 1]
    tail = np.where(_FLAG[last] == 8, last, 0).astype(A.U64)
    before = np.where(w.length > 1, data[w.start + np.maximum(w.length - 2, 0)], 0)
    tail2 = np.where((tail > 0) & (_FLAG[before] == 8), before, 0).astype(A.U64)
    size = np.searchsorted([2, 4, 8, 14], w.length).astype(A.U64)
    capital = (_FLAG[data[w.start]] == 2).astype(A.U64)
    joined = np.zeros(n, bool)
    joined[1:] = row[1:] == row[:-1]
    same = np.zeros(n, A.U64)
    same[1:] = joined[1:] & (w.hash[1:] == w.hash[:-1])
    shape = A.mix(have | capital << A.U64(6) | same << A.U64(7) | size << A.U64(8) | tail << A.U64(16) | tail2 << A.U64(24))
    out = [w.hash, A.mix(w.hash[:-1] * A.U64(3) ^ w.hash[1:])[joined[1:]], A.mix(shape + A.U64(11)), A.mix(shape[:-1] * A.U64(5) ^ shape[1:])[joined[1:]]]
    rows = [row, row[1:][joined[1:]], row, row[1:][joined[1:]]]
    three = joined[2:] & joined[1:-1]
    out.append(A.mix(A.mix(shape[:-2] * A.U64(7) ^ shape[1:-1]) ^ shape[2:])[three])
    rows.append(row[2:][three])
    return (np.concatenate(out) % A.U64(BUCKETS)).astype(np.int64), np.concatenate(rows)


def _counts(batches):
    """Per partition: raw and target counts of the buckets it has."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        good = b.column(1).to_numpy(zero_copy_only=False) == 1
        for block in A.blocks(b.column(0)):
            bucket, row = grams(block)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[block.rows][row]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Log ratio of each bucket. All texts are counted; the driver gets one row a bucket."""
    small_batches(docs.sparkSession)
    good = bare(labels, id=id, label=label).where("id is not null and label = 1").select("id").distinct()
    u = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    good = good.where(u < min(1.0, 0.97 * sample / max(good.count(), 1))).orderBy(u, "id").limit(sample)
    ids = bare(docs, id=id, text=text).join(F.broadcast(good.withColumn("good", F.lit(1))), "id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))
    got = ids.mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, PRIOR), np.full(BUCKETS, PRIOR)
    if not len(got) or not got["target"].sum():
        return np.zeros(BUCKETS)
    raw[got["bucket"]] += got["raw"]
    target[got["bucket"]] += got["target"] * (got["raw"].sum() / got["target"].sum())
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(block: A.Block, ratio: np.ndarray) -> np.ndarray:
    """Log importance of each row; -inf without n-grams."""
    bucket, row = grams(block)
    n = np.bincount(row, minlength=block.n)
    total = np.bincount(row, ratio[bucket], block.n)
    return np.where(n > 0, total, -np.inf)


def weighed(docs: DataFrame, ratio: np.ndarray, id: str, text: str, weight: str, key: str) -> DataFrame:
    """docs with two more columns: the log importance, and that with Gumbel noise."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, at = spark.sparkContext.broadcast(ratio), docs.columns.index(text)

    def run(batches):
        for b in batches:
            w = [weigh(block, shared.value) for block in A.blocks(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(w) if w else np.zeros(0))], [*b.schema.names, weight])

    u = (F.pmod(F.xxhash64(docs[id], F.lit(2)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    out = docs.withColumn(key, -F.log(-F.log(u)))
    out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(weight, T.DoubleType())]))
    return out.withColumn(key, F.col(weight) + F.col(key))


def kth(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th greatest finite value of column _key, exactly: each pass counts the values in `bins` bins of the last bin."""
    keys = keys.select(F.col("_key").alias("key")).where(F.col("key") > float("-inf"))
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None or k <= 0:
        return float("inf")
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        table = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect(), reverse=True)
        for _, n, low, high in table:
            if above + n >= k:
                lo, hi = low, high
                break
            above += n
        else:
            return lo
    return lo


def labelled_share(labels: DataFrame, id: str = "doc_id", label: str = "quality") -> float:
    """The share of good rows among those labelled 0 or 1; 1 where there is none."""
    marks = bare(labels, id=id, label=label).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    return marks.agg(F.avg(F.col("label").cast("double"))).first()[0] or 1.0


def _bar(keys: DataFrame, ratio: np.ndarray, share: float) -> float:
    """The least key that is kept."""
    if not ratio.any():
        return -1e300
    return kth(keys, round(share * keys.where(F.col("_key") > float("-inf")).count()))


def resample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", share: float | None = None, label: str = "quality") -> DataFrame:
    """Per row of docs: id, weight, key, kept. labels has the same id, and the label."""
    ratio, share = fit(docs, labels, id, text, label), labelled_share(labels, id, label) if share is None else share
    keys = weighed(bare(docs, id=id, text=text), ratio, "id", "text", "_weight", "_key").drop("text")
    keys = stored(keys)
    return keys.select(F.col("id").alias(id), F.col("_weight").alias("weight"), F.col("_key").alias("key"), (F.col("_key") >= _bar(keys, ratio, share)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", share: float | None = None, label: str = "quality") -> DataFrame:
    """The rows of docs that resampling keeps, with all their columns."""
    ratio, share = fit(docs, labels, id, text, label), labelled_share(labels, id, label) if share is None else share
    keys = stored(weighed(bare(docs, id=id, text=text), ratio, "id", "text", "_weight", "_key").select("_key"))
    weight, key = fresh(docs, "_weight", "_key")
    return weighed(docs, ratio, id, text, weight, key).where(F.col(key) >= _bar(keys, ratio, share)).drop(weight, key)
