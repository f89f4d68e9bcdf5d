"""Commission anomalies: day by service against a frozen mean and deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import stored

# The rates that are watched.
RATES = ["taux_comm_paid", "taux_comm_recv", "comm_par_tx"]


def daily(df: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Successful transfers by day and service; days below a share of the service's median volume are left out."""
    x = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("TRANSACTION_AMOUNT", "COMMISSIONS_PAID", "COMMISSIONS_RECEIVED")}
    ok = df.where((F.col("TRANSFER_STATUS") == "TS") & F.col("CREATED_ON").isNotNull() & F.col("SERVICE_TYPE").isNotNull())
    agg = ok.groupBy(F.to_date("CREATED_ON").alias("jour"), "SERVICE_TYPE").agg(F.count("*").alias("volume"), F.sum(x["TRANSACTION_AMOUNT"]).alias("montant"), F.sum(x["COMMISSIONS_PAID"]).alias("comm_paid"), F.sum(x["COMMISSIONS_RECEIVED"]).alias("comm_recv"))
    agg = agg.withColumns({"taux_comm_paid": F.col("comm_paid") / (F.col("montant") + 1), "taux_comm_recv": F.col("comm_recv") / (F.col("montant") + 1), "comm_par_tx": (F.col("comm_paid") + F.col("comm_recv")) / F.col("volume")})
    median = F.median("volume").over(W.partitionBy("SERVICE_TYPE"))
    return agg.withColumn("_m", median).where(F.col("volume") >= F.col("_m") * least_share).drop("_m")


def reference(agg: DataFrame) -> DataFrame:
    """Mean and deviation of each rate by service."""
    return agg.groupBy("SERVICE_TYPE").agg(*[f(r).alias(f"{r}_{n}") for r in RATES for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def alerts(agg: DataFrame, frozen: DataFrame, threshold: float = 2.5) -> DataFrame:
    """A row for each rate of a day and service that is off by more than threshold deviations.

    The frozen table has a row for each service, so it is broadcast by size.
    """
    wide = agg.join(frozen.withColumnRenamed("SERVICE_TYPE", "_service"), F.col("SERVICE_TYPE") == F.col("_service"))
    long_ = wide.select("jour", F.col("SERVICE_TYPE").alias("service"), "volume", F.explode(F.array(*[F.struct(F.lit(r).alias("metrique"), F.col(r).alias("valeur"), F.col(f"{r}_mean").alias("mu"), F.col(f"{r}_std").alias("sd")) for r in RATES])).alias("m")).select("jour", "service", "volume", "m.*")
    long_ = long_.where("mu is not null and sd is not null")
    z = (F.col("valeur") - F.col("mu")) / F.greatest("sd", F.abs("mu") * 0.05, F.lit(1e-9))
    hit = long_.withColumn("z", z).where(F.abs("z") > threshold)
    ratio = F.when(F.col("mu") > 0, F.format_string("x%.1f", F.expr("try_divide(valeur, mu)"))).otherwise("réf. nulle")
    why = F.concat("metrique", F.lit(" anormal ("), ratio, F.lit(" vs norme, z="), F.format_string("%.1f", F.least(F.abs("z"), F.lit(100.0))), F.lit(")"))
    clipped = F.greatest(F.least("z", F.lit(100.0)), F.lit(-100.0))
    return hit.select("jour", "service", "metrique", F.round("valeur", 6).alias("valeur"), F.round("mu", 6).alias("reference"), F.round(clipped, 2).alias("z_score"), "volume", why.alias("RAISON"))


def unknown_services(agg: DataFrame, frozen: DataFrame) -> DataFrame:
    return agg.select("SERVICE_TYPE").distinct().join(frozen, "SERVICE_TYPE", "left_anti")


def partial_days(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Days with fewer rows than a share of the median day."""
    days = df.groupBy(F.to_date("CREATED_ON").alias("jour")).agg(F.count("*").alias("n"))
    return days.join(F.broadcast(days.agg(F.median("n").alias("m")))).where(F.col("n") < F.col("m") * share).select("jour", "n")


def active_services(df: DataFrame, least: float = 100) -> DataFrame:
    """Services with a mean of at least `least` transfers a day."""
    days = df.groupBy("SERVICE_TYPE", F.to_date("CREATED_ON").alias("jour")).agg(F.count("*").alias("n"))
    return days.groupBy("SERVICE_TYPE").agg(F.avg("n").alias("mean_n")).where(F.col("mean_n") >= least)


def batch_zmax(agg: DataFrame) -> DataFrame:
    """The greatest deviation among the rates of a day and service, within this batch."""
    w = W.partitionBy("SERVICE_TYPE")
    zs = [F.abs((F.col(r) - F.avg(r).over(w)) / (F.stddev_samp(r).over(w) + 1e-9)) for r in RATES]
    return agg.select("jour", "SERVICE_TYPE", F.greatest(*zs).alias("zscore_max"))


def leak(agg: DataFrame) -> DataFrame:
    """Commission paid beyond the service's median rate."""
    median = F.median("taux_comm_paid").over(W.partitionBy("SERVICE_TYPE"))
    return agg.select("jour", "SERVICE_TYPE", F.greatest((F.col("taux_comm_paid") - median) * F.col("montant"), F.lit(0.0)).alias("fuite"))


def pivoted(zmax: DataFrame, days: list) -> DataFrame:
    """Services by the given days."""
    return zmax.groupBy("SERVICE_TYPE").pivot("jour", days).avg("zscore_max")


def fused(agg: DataFrame, frozen: DataFrame, threshold: float = 2.5, trees: int = 200, share: float = 0.05, seed: int = 42) -> DataFrame:
    """agg with RISK_SCORE, anomalie_zscore, anomalie_if, ALERTE and confiance (0 to 2: how many of the two found the day).

    A forest over the robustly scaled rates of day and service, a table of days times services, beside the rule of deviations.
    """
    from . import forest
    from .anomalies import contamination_flag
    from .graph import robust_scaled
    from .stats import calibrate

    late = alerts(agg, frozen, threshold).select(F.col("jour").alias("_j"), F.col("service").alias("_s")).distinct()
    x = agg.join(late, (F.col("jour") == F.col("_j")) & (F.col("SERVICE_TYPE") == F.col("_s")), "left")
    x = x.withColumn("anomalie_zscore", F.col("_j").isNotNull().cast("int")).drop("_j", "_s")
    columns = [f"{r}_scaled" for r in RATES]
    x = robust_scaled(x, RATES)[0].withColumns({"_segment": F.lit("tous"), "_row_id": F.xxhash64("jour", "SERVICE_TYPE")})
    x = stored(forest.score(x, forest.fit_segments(x, columns, "_segment", 1, trees=trees, seed=seed), columns, "_segment"))
    x = contamination_flag(x, "iso_score", share).withColumns({"anomalie_if": (F.col("prediction") == -1).cast("int"), "_iso": -F.col("iso_score")})
    x = calibrate(x, "_iso", "RISK_SCORE")[0]
    x = x.withColumns({"ALERTE": F.greatest("anomalie_zscore", "anomalie_if"), "confiance": F.col("anomalie_zscore") + F.col("anomalie_if")})
    return x.drop("_iso", "_segment", "_row_id", "prediction", *columns)
