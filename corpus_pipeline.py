"""Documents through quality, toxicity, near-dedup, substring dedup and packing.

Each stage works on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import shared, stages

STAGES = [
    ("quality", stages.keep_good),
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.cut_repeats),
    ("packing", stages.pack),
]
#: Fitted models, shingles and packing have no SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"{name}-{uuid.uuid4().hex}")
    return docs
