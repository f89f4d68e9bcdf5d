"""The transfer records that the star-schema test tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = {"click": "RC", "purchase": "MP", "signup": "CO", "view": "CI", "error": "PP"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfer_id(event_id=None):
    """PREFIX date . session . A number, of an event."""
    e = F.col("event_id") if event_id is None else event_id
    prefix = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in PREFIX.items()])
    return F.concat(prefix, F.date_format("ts", "yyMMdd"), F.lit("."), F.lpad((e / 100).cast("long").cast("string"), 4, "0"), F.lit(".A"), F.lpad(e.cast("string"), 6, "0"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transfers, with the balances and places of the customers of the two parties."""
    e = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    s = c.select(F.col("c_custkey").alias("s_key"), F.col("c_acctbal").alias("s_bal"), F.col("n_name").alias("s_city"), F.col("c_mktsegment").alias("s_type"))
    r = c.select(F.col("c_custkey").alias("r_key"), F.col("c_acctbal").alias("r_bal"), F.col("c_mktsegment").alias("r_type"))
    e = e.join(s, F.col("user_id") == F.col("s_key"), "left").join(r, F.col("k") == F.col("r_key"), "left")
    amount = F.col("value") * 100
    return e.select(
        transfer_id().alias("TRANSFER_ID"),
        F.col("ts").alias("CREATED_ON"),
        F.concat(F.lit("U"), F.col("user_id")).alias("SENDER_USER_ID"),
        F.concat(F.lit("U"), F.col("k")).alias("RECEIVER_USER_ID"),
        amount.alias("TRANSACTION_AMOUNT"),
        F.when(F.col("event_type") == "error", "TF").otherwise("TS").alias("TRANSFER_STATUS"),
        F.col("event_type").alias("SERVICE_TYPE"),
        F.when(F.col("event_type") == "error", 60019.0).alias("ERROR_CODE"),
        F.col("s_bal").alias("SENDER_PRE_BAL"),
        (F.col("s_bal") - F.col("value")).alias("SENDER_POST_BAL"),
        F.col("r_bal").alias("RECEIVER_PRE_BAL"),
        (F.col("r_bal") + F.col("value")).alias("RECEIVER_POST_BAL"),
        F.col("s_city").alias("SENDER_CITY"),
        F.col("s_type").alias("SENDER_USER_TYPE"),
        F.col("r_type").alias("RECEIVER_USER_TYPE"),
        F.col("event_id").alias("_row_id"),
    )


def commissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and part as transfers with commissions."""
    j = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    return j.select(F.col("l_shipdate").alias("CREATED_ON"), F.col("p_type").alias("SERVICE_TYPE"), F.lit("TS").alias("TRANSFER_STATUS"), price.alias("TRANSACTION_AMOUNT"), (price * F.col("l_discount")).alias("COMMISSIONS_PAID"), (price * F.col("l_tax")).alias("COMMISSIONS_RECEIVED"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row_id"))


def declaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id of the events that declare a counterpart, be it in the table or not."""
    return _table(spark, sf_dir, "events").where("event_id % 50 in (0, 25)").select("event_id")


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transfers some of which declare their counterpart, rightly (event_id % 50 = 0) or not (25)."""
    e = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    t = e.select("event_id", transfer_id().alias("id"))
    target = F.when(F.col("event_id") % 50 == 0, F.col("event_id") + 1 + ((F.col("event_id") / 50).cast("long") % 3) * 40)
    e = e.withColumn("to", target)
    # 49 rows of 50 have no target: within the join they'd all have the same key, null
    found = e.where("to is not null").join(t.select(F.col("event_id").alias("to"), F.col("id").alias("to_id")), "to", "left")
    e = found.unionByName(e.where("to is null").withColumn("to_id", F.lit(None).cast("string")))
    return e.select(
        transfer_id().alias("TRANSFER_ID"),
        F.col("ts").alias("CREATED_ON"),
        (F.floor(F.col("value") / 20) * 20).cast("double").alias("TRANSACTION_AMOUNT"),
        F.concat(F.lit("U"), F.col("user_id") % 5).alias("SENDER_USER_ID"),
        F.concat(F.lit("U"), F.col("k") % 5).alias("RECEIVER_USER_ID"),
        F.when(F.col("event_id") % 50 == 25, F.concat(F.lit("ZZ"), F.col("event_id"))).otherwise(F.col("to_id")).alias("RECONCILIATION_FOR"),
        F.col("event_id").alias("_row_id"),
    )
