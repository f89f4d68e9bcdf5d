"""Probability that a transfer fails: gradient-boosted trees with a guard against leaking features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import imputed, leaking, medians
from ..schema import LeakError
from . import boosting
from .stats import class_weights


def split(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and the others."""
    day = F.to_date("CREATED_ON")
    return df.where(day < F.lit(date).cast("date")), df.where(day >= F.lit(date).cast("date"))


def guard(columns: list[str]) -> None:
    if bad := leaking(columns):
        raise LeakError(f"features known only after the transfer: {bad}")


def fit(df: DataFrame, columns: list[str], valid: DataFrame | None = None, rounds: int = 100, leaves: int = 31, depth: int = 6, rate: float = 0.1, patience: int = 10) -> tuple[dict, dict]:
    """(model, frozen medians). The label is a failed status; failures weigh as much as their class is rarer. Rounds stop early by the rows of valid."""
    guard(columns)
    fill = medians(df, columns)
    label = F.coalesce((F.col("TRANSFER_STATUS") == "TF").cast("double"), F.lit(0.0))
    weight = float(class_weights(df.select(label.alias("_label")), "_label")["weight"])
    parts = [x.select(*[F.col(f"`{c}`") for c in columns], label.alias("_label"), F.lit(held).alias("_held")) for x, held in ((df, False), (valid, True)) if x is not None]
    data = parts[0] if valid is None else parts[0].unionByName(parts[1])
    data = data.withColumn("_w", F.when(F.col("_label") == 1, weight).otherwise(1.0))
    return boosting.fit(data, columns, fill, "_label", "_w", "_held", rounds, leaves, depth, rate, patience=patience), fill


def score(df: DataFrame, model: dict, columns: list[str], fill: dict, threshold: float = 0.80) -> DataFrame:
    """df, nulls of the columns filled, with proba_echec and ALERTE."""
    guard(columns)
    out = boosting.score(imputed(df, fill), model, fill, "proba_echec")
    return out.withColumn("ALERTE", (F.col("proba_echec") >= threshold).cast("int"))


def by_service(df: DataFrame) -> DataFrame:
    bad = (F.col("TRANSFER_STATUS") == "TF").cast("int")
    return df.groupBy("SERVICE_TYPE").agg(F.avg(bad).alias("taux_echec"), F.sum(bad).alias("n_echecs"), F.count("*").alias("n")).orderBy(F.col("taux_echec").desc(), "SERVICE_TYPE")
