"""The thin queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bytepair, lm, neardup, negatives, ordermin, packing, quality, sharding, substring, toxicity, vectors, webpages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), toxicity.fold(F.col("id"), 7) != 2)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op13_webpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.main_text(table(spark, sf_dir, "pages"))


SQL = {
    "op12_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as q
from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
a as (select vec_id as anchor, label as own, q as aq from v where vec_id % 100 = 0),
s as (select anchor, own, vec_id as id, label, cast(list_inner_product(aq, q) as bigint) as score from a, v),
p as (select *, row_number() over (partition by anchor order by score desc, id) as k from s where label = own and id <> anchor)
select p.anchor as anchor_id, p.id as positive_id, cast(row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as int) as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor = p.anchor and s.label <> s.own and 80 * p.score <= 100 * s.score and s.score <= p.score where p.k <= 5 qualify rank <= 5""",
}


def queries() -> dict:
    return {f.__name__: f for f in (op1_ordermin, op2_resampling, op3_packing, op4_rotation, op5_minhash, op6_factorization, op7_trees, op8_sharding, op9_recompression, op10_bytepair, op11_alignment, op12_negatives, op13_webpages)}


def oracle_sql() -> dict:
    return dict(SQL)
