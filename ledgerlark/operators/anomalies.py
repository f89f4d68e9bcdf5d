"""Anomalous transfers: isolation within peer segments, deviation from peers, a daily budget of alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import reasons, segment
from ..schema import clip
from . import forest
from ..tables import stored
from .stats import exact_quantiles, percent_rank, quantile, top_per_group


def segmented(df: DataFrame, bands: tuple[int, int, int] = (10, 100, 1000), volume: str | None = None) -> DataFrame:
    """SEGMENT by the number of transfers of the sender. Counted by aggregation, so no account is sorted into one task, or taken from the
    column `volume`, which features.behaviour() gives without a further exchange."""
    if volume is not None:
        return df.withColumn("SEGMENT", segment(F.col(f"`{volume}`"), *bands))
    n = df.groupBy(F.col("SENDER_USER_ID").alias("_s")).agg(F.count("*").alias("volume_compte"))
    out = df.join(n, F.col("SENDER_USER_ID") == F.col("_s"), "left").drop("_s")
    return out.withColumn("SEGMENT", segment(F.col("volume_compte"), *bands))


def peer_deviation(df: DataFrame, value: str = "TRANSACTION_AMOUNT", name: str = "montant_z_segment") -> DataFrame:
    """|x - median| / deviation within the segment, at most 10. A row for each segment is broadcast."""
    middle = exact_quantiles(df, [value], [0.5], "SEGMENT")
    peers = df.groupBy(F.col("SEGMENT").alias("_g")).agg(F.stddev_samp(value).alias("_d"))
    peers = peers.withColumn("_m", F.coalesce(*[F.when(F.col("_g") == g, F.lit(float(m[value][0]))) for g, m in middle.items() if g is not None and m[value]], F.lit(None).cast("double")))
    out = df.join(F.broadcast(peers), F.col("SEGMENT") == F.col("_g"), "left")
    return out.withColumn(name, clip(F.abs((F.col(value) - F.col("_m")) / (F.col("_d") + 1e-9)), None, 10)).drop("_g", "_m", "_d")


#: Features that the rules of explained() read.
RULES = ["f_velocite_7j", "f_taux_echec_hist", "f_montant_tres_arrondi", "f_est_nuit"]


def score(df: DataFrame, models: dict, columns: list[str], budget: int = 200, weights: tuple[float, float] = (0.7, 0.3), keep: list[str] | None = None) -> DataFrame:
    """df (with features and SEGMENT) with RISK_SCORE, ALERTE and RAISON. keep: the columns of df that come out, by default all; the rows are
    written and dealt by their values several times, so the features are left behind once they are scored."""
    added = ["iso_score", "montant_z_segment"]
    kept = [c for c in df.columns if c not in added and (keep is None or c in keep)]
    carried = [c for c in df.columns if c in {*kept, "SEGMENT", "CREATED_ON", "_row_id", *RULES}]
    df = peer_deviation(forest.score(df, models, columns, "SEGMENT")).select(*[F.col(f"`{c}`") for c in (*carried, *added)])
    df = stored(df.withColumns({"_iso": -F.col("iso_score"), "_z": F.round("montant_z_segment", 9)}))
    df = percent_rank(df, "_iso", "_ri", "SEGMENT")
    df = percent_rank(df, "_z", "_re", "SEGMENT")  # amounts as far above the median as below it are equal
    df = df.withColumn("RISK_SCORE", clip(100 * (weights[0] * F.col("_ri") + weights[1] * F.col("_re")), 0, 100)).withColumn("_day", F.to_date("CREATED_ON"))
    df = top_per_group(stored(df), "_day", "RISK_SCORE", budget, "_row_id")
    return explained(df).select(*[F.col(f"`{c}`") for c in (*kept, *added)], "RISK_SCORE", "ALERTE", "RAISON")


def explained(df: DataFrame) -> DataFrame:
    """RAISON of the alerts: which of five rules hold. The 99 % quantile of the velocity is of all rows."""
    fast = quantile(df, "f_velocite_7j", 0.99)
    # Texts and bounds of the rules.
    why = reasons(
        "profil globalement atypique",
        (F.col("montant_z_segment") > 3, "montant très élevé vs pairs"),
        (F.col("f_velocite_7j") > F.lit(fast), "vélocité anormale"),
        (F.col("f_taux_echec_hist") > 0.5, "historique d'échec élevé"),
        (F.col("f_montant_tres_arrondi") == 1, "montant très arrondi"),
        (F.col("f_est_nuit") == 1, "transaction nocturne"),
    )
    return df.withColumn("RAISON", F.when(F.col("ALERTE") == 1, why))


def pseudo_labels(df: DataFrame) -> DataFrame:
    """1 where any of seven expert rules holds; df has the features of blocks A to C and the training variants."""
    from ..schema import WITHOUT_BALANCE

    df = stored(df)  # the windows of the features are worked out once
    q1, q2, q3 = quantile(df, "TRANSACTION_AMOUNT", 0.95), quantile(df, "f_nb_dest_cumul", 0.99), quantile(df, "f_montant_cumul", 0.99)
    night = F.col("f_est_nuit") == 1
    rules = [
        night & (F.col("TRANSACTION_AMOUNT") > F.lit(q1)),
        ~F.coalesce(F.col("SERVICE_TYPE").isin(WITHOUT_BALANCE), F.lit(False)) & (F.col("f_ratio_montant_solde") > 0.95),
        (F.col("f_taux_echec_hist") > 0.5) & (F.col("TRANSFER_STATUS") == "TS"),
        (F.col("f_montant_tres_arrondi") == 1) & night,
        F.col("f_nb_dest_cumul") > F.lit(q2),
        F.col("f_montant_cumul") > F.lit(q3),
        F.col("f_rang_tx_compte") > 50,
    ]
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.coalesce(r, F.lit(False))
    return df.withColumn("PSEUDO_LABEL", hit.cast("int"))


def contamination_flag(df: DataFrame, score: str, share: float = 0.01) -> DataFrame:
    """-1 for scores below the share-quantile, else 1."""
    q = quantile(df, score, share)
    return df.withColumn("prediction", F.when(F.col(score) < F.lit(q), -1).otherwise(1))


def by_service(df: DataFrame) -> DataFrame:
    """Alerts by service beside all transfers, in one pass."""
    a = F.col("ALERTE") == 1
    out = df.groupBy("SERVICE_TYPE").agg(F.count("*").alias("total"), F.count_if(a).alias("n_alertes"), F.avg(F.when(a, F.col("RISK_SCORE"))).alias("score_moyen"), F.max(F.when(a, F.col("RISK_SCORE"))).alias("score_max"), F.sum(F.when(a, F.col("TRANSACTION_AMOUNT"))).alias("montant"))
    return out.withColumn("taux_alerte", F.col("n_alertes") / F.col("total"))


def by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("CREATED_ON").alias("heure")).agg(F.count("*").alias("n"), F.avg("RISK_SCORE").alias("score_moyen"), F.count_if(F.col("ALERTE") == 1).alias("n_alertes"))


def permutation_importance(model: dict, sample, columns: list[str], seed: int = 42) -> dict[str, float]:
    """Mean change of the isolation score when a column of a bounded sample is shuffled."""
    import numpy as np

    rng, base, out = np.random.default_rng(seed), forest.scores(model, sample), {}
    for k, c in enumerate(columns):
        x = sample.copy()
        x[:, k] = rng.permutation(x[:, k])
        out[c] = float(np.abs(forest.scores(model, x) - base).mean())
    return out


__all__ = ["by_hour", "by_service", "contamination_flag", "peer_deviation", "permutation_importance", "pseudo_labels", "score", "segmented"]
