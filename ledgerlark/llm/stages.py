"""The stages of the corpus pipeline: each takes and returns documents, the last returns packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup, packing, quality, substring, toxicity
from .shared import SMALL_IDS, fresh, keyed, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of like texts, that with the smallest doc_id (rows without one come last). Rows are compared,
    not ids: unlike texts of one doc_id all stay, and rows without doc_id are in the groups. Texts without words are like none."""
    row, gone = fresh(docs, "_row", "_gone")
    rows = keyed(docs, "doc_id", row)
    lost = stored(neardup.grouped(rows, row, "doc_id", "text").where("not kept").select(F.col("row").alias(gone)))
    if lost.count() <= SMALL_IDS:
        lost = F.broadcast(lost)
    return rows.join(lost, F.col(row) == F.col(gone), "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; text and n_chars change where words went."""
    row, of, left = fresh(docs, "_row", "_of", "_left")
    rows = keyed(docs, "doc_id", row)
    whole, cut = substring.passages(rows, row=row)
    change = whole.where("not gone").join(cut.select(F.col("row").alias("stand"), "left"), "stand").select(F.col("row").alias(of), F.col("left").alias(left))
    change = stored(change.union(whole.where("gone").select("row", F.lit(""))))
    # only row keys may be broadcast: the texts that stay don't move, and those that change are small in number
    keys = change.select(of)
    keys = F.broadcast(keys) if change.count() <= SMALL_IDS else keys
    same = rows.join(keys, F.col(row) == F.col(of), "left_anti").drop(row)
    rest = rows.drop("text").join(keys, F.col(row) == F.col(of), "left_semi").join(change, F.col(row) == F.col(of))
    new = {"text": F.col(left), "n_chars": F.length(left).cast("long")}
    return same.unionByName(rest.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
