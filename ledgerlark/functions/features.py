"""The four feature blocks: per row, calendar, causal per account, and categorical."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import UNKNOWN, WITHOUT_BALANCE, clip, flag
from ..tables import stored
from . import scans

TRANSACTIONAL = ["f_log_montant", "f_ratio_montant_solde", "f_delta_solde", "f_log_incoherence", "f_solde_apres_nul", "f_montant_arrondi", "f_montant_tres_arrondi", "f_log_solde_avant", "f_incoherence_recvr"]
CALENDAR = ["f_heure_sin", "f_heure_cos", "f_jour_sin", "f_jour_cos", "f_est_nuit", "f_est_soiree", "f_est_weekend"]
BEHAVIOUR = ["f_velocite_7j", "f_log_velocite_7j", "f_montant_7j", "f_log_montant_7j", "f_ratio_vs_profil", "f_zscore_montant", "f_nb_dest_cumul", "f_taux_echec_hist", "f_anciennete_jours", "f_rang_tx"]
# How the names of block D begin.
CONTEXTUAL = ("f_statut_", "f_attempt_", "f_gw_", "f_stype_", "f_rtype_", "f_freq_", "f_has_error")
# Parts of the names of features that are known only after the transfer.
LEAKS = ["incoherence", "delta_solde", "solde_apres", "statut", "has_error", "attempt"]


def transactional(df: DataFrame) -> DataFrame:
    """Block A: amounts and balances of the row alone."""
    amount, pre, post = (F.col(c) for c in ("TRANSACTION_AMOUNT", "SENDER_PRE_BAL", "SENDER_POST_BAL"))
    change = F.col("RECEIVER_POST_BAL") - F.col("RECEIVER_PRE_BAL")
    ratio = F.when(F.coalesce(F.col("SERVICE_TYPE").isin(WITHOUT_BALANCE), F.lit(False)), -2.0).when(pre > 0, clip(amount / (F.when(pre > 0, pre) + 1), 0, 10)).otherwise(-1.0)
    return df.withColumns({
        "f_log_montant": F.log1p(clip(amount, 0, None)),
        "f_ratio_montant_solde": ratio,
        "f_delta_solde": post - pre,
        "f_log_incoherence": F.log1p(F.abs(post - pre + amount)),
        "f_solde_apres_nul": flag(post <= 0),
        "f_montant_arrondi": flag(amount % 1000 == 0),
        "f_montant_tres_arrondi": flag(amount % 10000 == 0),
        "f_log_solde_avant": F.log1p(clip(pre, 0, None)),
        "f_incoherence_recvr": F.log1p(F.abs(change - amount)),
    })


def transactional_training(df: DataFrame) -> DataFrame:
    """What only fitting uses of the row: low balance, a phone number, a financial flag, and the minute's angle."""
    out = {"f_solde_avant_faible": F.when(F.coalesce(F.col("SERVICE_TYPE").isin(WITHOUT_BALANCE), F.lit(False)), 0).otherwise(flag(F.col("SENDER_PRE_BAL") < 1000))}
    if "OTHER_MSISDN" in df.columns:
        out["f_has_msisdn"] = F.col("OTHER_MSISDN").isNotNull().cast("int")
    if "IS_FINANCIAL" in df.columns:
        out["f_is_financial"] = flag(F.col("IS_FINANCIAL") == "Y")
    minute = F.minute("CREATED_ON") * (2 * math.pi / 60)
    return df.withColumns(out | {"f_minute_sin": F.sin(minute), "f_minute_cos": F.cos(minute)})


def calendar(df: DataFrame) -> DataFrame:
    """Block B: hour and weekday as angles, and night, evening, weekend."""
    hour, day = F.hour("CREATED_ON"), F.weekday("CREATED_ON")
    return df.withColumns({
        "f_heure_sin": F.sin(hour * (2 * math.pi / 24)),
        "f_heure_cos": F.cos(hour * (2 * math.pi / 24)),
        "f_jour_sin": F.sin(day * (2 * math.pi / 7)),
        "f_jour_cos": F.cos(day * (2 * math.pi / 7)),
        "f_est_nuit": flag(hour.between(0, 5)),
        "f_est_soiree": flag(hour.between(20, 23)),
        "f_est_weekend": flag(day.isin(5, 6)),
    })


def _windowed(known: DataFrame) -> DataFrame:
    """Running figures of accounts, each sorted by one task. Rows are dealt by account once; the pairs of an account lie in its task."""
    known = known.repartition("SENDER_USER_ID")
    rows = W.partitionBy("SENDER_USER_ID").orderBy("CREATED_ON", "_row_id")
    upto, before = rows.rowsBetween(W.unboundedPreceding, 0), rows.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("SENDER_USER_ID")
    # rows older than seven days, by time; what is left of the rows up to this one is the seven-day frame
    old = "over (partition by SENDER_USER_ID order by CREATED_ON range between unbounded preceding and interval '7 00:00:00.000001' day to second preceding)"
    receiver = W.partitionBy("SENDER_USER_ID", "RECEIVER_USER_ID").orderBy("CREATED_ON", "_row_id")
    known = known.withColumn("_new", (F.row_number().over(receiver) == 1).cast("int"))
    amount = F.col("_amount")
    return known.withColumns({
        "_v": F.count("*").over(upto) - F.expr(f"count(*) {old}"),
        "_s": F.sum(amount).over(upto) - F.coalesce(F.expr(f"sum(_amount) {old}"), F.lit(0.0)),
        "_mean": F.coalesce(F.avg(amount).over(before), F.first(amount).over(rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))),
        "_std": F.coalesce(F.stddev_samp(amount).over(before), F.lit(0.0)),
        "_dest": F.sum("_new").over(upto),
        "_fail": F.coalesce(F.avg(flag(F.col("TRANSFER_STATUS") == "TF")).over(before), F.lit(0.0)),
        "_born": F.min("CREATED_ON").over(whole),
        "_rank": F.row_number().over(rows) - 1,
        "_all": F.count("*").over(whole),
    })


def _chunked(known: DataFrame, few: DataFrame, chunk: int) -> DataFrame:
    """The same figures of large accounts, from sums carried over chunks."""
    r = scans.scanned(known, few, "SENDER_USER_ID", "CREATED_ON", "_row_id", "_amount", "RECEIVER_USER_ID", F.col("TRANSFER_STATUS") == "TF", chunk)
    d, n = F.col("_amount") - F.col("_r_mean"), F.nullif(F.col("_r_n") - 1, F.lit(0))  # without the row itself
    s1, s2 = F.col("_r_s1") - d, F.col("_r_s2") - d * d
    spread = F.sqrt(F.greatest((s2 - s1 * s1 / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    bad = F.col("_r_bad") - flag(F.col("TRANSFER_STATUS") == "TF")
    born = F.expr("cast(timestamp_micros(_r_born) as timestamp_ntz)") if dict(known.dtypes)["CREATED_ON"] == "timestamp_ntz" else F.timestamp_micros("_r_born")
    out = r.withColumns({
        "_v": F.col("_r_v"),
        "_s": F.col("_r_s"),
        "_mean": F.when(n > 0, F.col("_r_mean") + s1 / n).otherwise(F.col("_amount")),
        "_std": F.when(n > 1, spread).otherwise(0.0),
        "_dest": F.col("_r_new"),
        "_fail": F.when(n > 0, bad / n).otherwise(0.0),
        "_born": born,
        "_rank": F.col("_r_n") - 1,
    })
    sizes = F.broadcast(few.select(F.col("account").alias("_account"), F.col("n").alias("_all")))  # at most rows / chunk short rows
    out = out.join(sizes, F.col("SENDER_USER_ID") == F.col("_account")).drop("_account")
    return out.drop(*[c for c in out.columns if c.startswith("_r_")]).withColumn("_new", F.lit(0))


def behaviour(df: DataFrame, chunk: int = scans.CHUNK, volume: str | None = None) -> DataFrame:
    """Block C: what an account did before, by windows over (account, time, _row_id).

    Rows without a date are dropped. Rows without an account have constant features and stay out of the windows, so
    that their one large group is never sorted into one task. Accounts with more than `chunk` rows are scanned in chunks.
    volume: the name of a column for the number of rows that the row's account has here.
    """
    sender = F.col("SENDER_USER_ID")
    blank = sender.isNull() | sender.isin("nan", "None", "", UNKNOWN)
    df = df.where(F.col("CREATED_ON").isNotNull()).withColumn("SENDER_USER_ID", F.when(blank, UNKNOWN).otherwise(sender))
    df = df.withColumn("_amount", F.coalesce("TRANSACTION_AMOUNT", F.lit(0.0)))
    known, unknown = df.where(sender != UNKNOWN), df.where(sender == UNKNOWN)

    few = scans.large(known, "SENDER_USER_ID", chunk)
    if few.isEmpty():
        known = _windowed(known)
    else:
        small, big = scans.apart(known, "SENDER_USER_ID", few)
        known = _windowed(small).unionByName(_chunked(big, few, chunk))
    amount, counted = F.col("_amount"), {} if volume is None else {volume: F.col("_all")}
    days = (F.unix_micros(F.col("CREATED_ON").cast("timestamp")) - F.unix_micros(F.col("_born").cast("timestamp"))) / 86_400_000_000.0
    known = known.withColumns({
        "f_velocite_7j": F.least("_v", F.lit(5000)).cast("double"),
        "f_log_velocite_7j": F.log1p(F.col("_v").cast("double")),
        "f_montant_7j": F.col("_s"),
        "f_log_montant_7j": F.log1p(clip(F.col("_s"), 0, None)),
        "f_ratio_vs_profil": F.when(F.col("_mean") > 0, clip(amount / (F.when(F.col("_mean") > 0, F.col("_mean")) + 1), 0, 50)).otherwise(1.0),
        "f_zscore_montant": F.when(F.col("_std") > 0, clip((amount - F.col("_mean")) / (F.col("_std") + 1), -10, 10)).otherwise(0.0),
        "f_nb_dest_cumul": F.least("_dest", F.lit(200)).cast("double"),
        "f_taux_echec_hist": F.col("_fail"),
        "f_anciennete_jours": clip(days, 0, 32),
        "f_rang_tx": F.least("_rank", F.lit(1000)).cast("double"),
    } | counted).drop("_v", "_s", "_mean", "_std", "_dest", "_fail", "_born", "_rank", "_new", "_amount", "_all")
    first = unknown.agg(F.min("CREATED_ON").alias("_born"), F.count("*").alias("_all"))
    unknown = unknown.join(F.broadcast(first)).withColumns({  # one row
        "f_velocite_7j": F.lit(1.0),
        "f_log_velocite_7j": F.lit(0.0),
        "f_montant_7j": amount,
        "f_log_montant_7j": F.log1p(clip(amount, 0, None)),
        "f_ratio_vs_profil": F.lit(1.0),
        "f_zscore_montant": F.lit(0.0),
        "f_nb_dest_cumul": F.lit(1.0),
        "f_taux_echec_hist": F.lit(0.0),
        "f_anciennete_jours": clip(days, 0, 32),
        "f_rang_tx": F.lit(0.0),
    } | counted).drop("_born", "_amount", "_all")
    return known.unionByName(unknown)


def behaviour_training(df: DataFrame, chunk: int = scans.CHUNK) -> DataFrame:
    """Unshifted variants that fitting uses: running sum, mean, deviation, distinct services, capped rank. Accounts with more than `chunk`
    rows are scanned in chunks; rows without a date come first."""
    few = scans.large(df, "SENDER_USER_ID", chunk)
    names = ["f_montant_cumul", "f_moyenne", "f_ecart", "f_nb_services", "f_rang_tx_compte"]
    if few.isEmpty():
        return _windowed_training(df)
    small, big = scans.apart(df, "SENDER_USER_ID", few)
    big = big.withColumn("_at", F.coalesce(F.col("CREATED_ON").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    r = scans.scanned(big, few, "SENDER_USER_ID", "_at", "_row_id", "TRANSACTION_AMOUNT", "SERVICE_TYPE", F.lit(False), chunk)
    n, k, s1, s2 = (F.col(f"_r_{c}") for c in ("n", "k", "s1", "s2"))
    r = r.withColumns({
        "f_montant_cumul": F.when(k > 0, s1 + k * F.col("_r_mean")),
        "f_moyenne": F.when(k > 0, F.col("_r_mean") + s1 / k),
        "f_ecart": F.when(k > 1, F.sqrt(F.greatest((s2 - s1 * s1 / F.nullif(k, F.lit(0))) / F.nullif(k - 1, F.lit(0)), F.lit(0.0)))).otherwise(0.0),
        "f_nb_services": F.col("_r_new"),
        "f_rang_tx_compte": F.least(n - 1, F.lit(500)),
    })
    return _windowed_training(small).unionByName(r.select(*df.columns, *names))


def _windowed_training(df: DataFrame) -> DataFrame:
    upto = W.partitionBy("SENDER_USER_ID").orderBy("CREATED_ON", "_row_id").rowsBetween(W.unboundedPreceding, 0)
    new = F.row_number().over(W.partitionBy("SENDER_USER_ID", "SERVICE_TYPE").orderBy("CREATED_ON", "_row_id")) == 1
    df = df.withColumn("_new", new.cast("int"))
    return df.withColumns({
        "f_montant_cumul": F.sum("TRANSACTION_AMOUNT").over(upto),
        "f_moyenne": F.avg("TRANSACTION_AMOUNT").over(upto),
        "f_ecart": F.coalesce(F.stddev_samp("TRANSACTION_AMOUNT").over(upto), F.lit(0.0)),
        "f_nb_services": F.sum("_new").over(upto),
        "f_rang_tx_compte": F.least(F.count("*").over(upto) - 1, F.lit(500)),
    }).drop("_new")


def levels(df: DataFrame, column: str) -> list[str]:
    """Distinct values of a categorical column, sorted; its cardinality bounds what the driver gets."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, column: str, prefix: str, values: list[str] | None = None, most: int | None = None) -> DataFrame:
    """A 0/1 column for each value; values freezes them. With more than `most` values nothing is added."""
    values = levels(df, column) if values is None else values
    if most is not None and len(values) > most:
        return df
    return df.withColumns({f"{prefix}{v}": flag(F.col(column) == v) for v in values})


def frequency(df: DataFrame, column: str, name: str, fill: float | None = None) -> DataFrame:
    """Share of the value among non-null ones; null gives null, or fill."""
    table = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    table = table.join(F.broadcast(table.agg(F.sum("_n").alias("_all")))).select("_value", (F.col("_n") / F.col("_all")).alias("_share"))
    share = F.col("_share") if fill is None else F.coalesce("_share", F.lit(float(fill)))
    return df.join(table, F.col(column) == F.col("_value"), "left").withColumn(name, share).drop("_value", "_share")


def adaptive(df: DataFrame, column: str, name: str, most: int = 15, least_rows: int = 1000) -> DataFrame:
    """One-hot up to `most` values, else frequency; columns with too few values stay out."""
    n, k = df.agg(F.count(column), F.countDistinct(column)).first()
    if n <= least_rows:
        return df
    return one_hot(df, column, f"{name}_") if k <= most else frequency(df, column, f"{name}_freq", 0)


# The columns that block D encodes; 0/1 columns: (column, prefix, most values), shares: (column, name, fill).
HOT = [("TRANSFER_STATUS", "f_statut_", None), ("ATTEMPT_STATUS", "f_attempt_", None), ("GATEWAY_TYPE", "f_gw_", 5), ("SENDER_USER_TYPE", "f_stype_", 6), ("RECEIVER_USER_TYPE", "f_rtype_", 6)]
SHARES = [("SERVICE_TYPE", "f_freq_service", None), ("SENDER_CITY", "f_freq_ville", 0), ("TRANSFER_SUBTYPE", "f_freq_subtype", 0), ("TRANSACTION_TAG", "f_freq_tag", 0)]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of the non-null values of all columns, stored: one pass over df."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return stored(df.select(pairs).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n")))


def context(df: DataFrame, frozen: dict[str, list[str]] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Block D: one-hot and frequency encodings, and whether there is an error code. counts: value_counts of the same rows."""
    frozen = frozen or {}
    hot, shares = [x for x in HOT if x[0] in df.columns], [x for x in SHARES if x[0] in df.columns]
    if hot or shares:
        counts = value_counts(df, [x[0] for x in (*hot, *shares)]) if counts is None else counts
        sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.count("*").alias("values"), F.sum("n").alias("n")).collect()}
        few = [c for c, _, most in hot if c not in frozen and (most is None or c in sizes and sizes[c]["values"] <= most)]
        found: dict[str, list[str]] = {c: [] for c in few}
        for r in counts.where(F.col("column").isin(few)).select("column", "value").collect() if few else []:  # statuses and types
            found[r["column"]].append(r["value"])
        for column, prefix, most in hot:
            df = one_hot(df, column, prefix, sorted(found[column]) if column in found else frozen.get(column, []), most)
        for k, (column, name, fill) in enumerate(shares):
            total = sizes[column]["n"] if column in sizes else 1
            table = counts.where(F.col("column") == column).select(F.col("value").alias(f"_v{k}"), (F.col("n") / F.lit(total)).alias(f"_n{k}"))
            share = F.col(f"_n{k}") if fill is None else F.coalesce(f"_n{k}", F.lit(float(fill)))
            df = df.join(table, F.col(column).cast("string") == F.col(f"_v{k}"), "left").withColumn(name, share).drop(f"_v{k}", f"_n{k}")
    if "ERROR_CODE" in df.columns:
        df = df.withColumn("f_has_error", F.col("ERROR_CODE").isNotNull().cast("int"))
    return df


def build(df: DataFrame, frozen: dict[str, list[str]] | None = None, volume: str | None = None) -> DataFrame:
    """All four blocks. The values of block D are counted on the rows as they come in, not on those that the windows give. volume: as for behaviour()."""
    dated = df.where(F.col("CREATED_ON").isNotNull())
    encoded = [x[0] for x in (*HOT, *SHARES) if x[0] in df.columns]
    # blocks A and B are of the row alone: added after the windows, they need not be dealt and sorted
    return context(calendar(transactional(behaviour(dated, volume=volume))), frozen, value_counts(dated, encoded) if encoded else None)


def names(df: DataFrame) -> dict[str, list[str]]:
    """The features that df has, by block; those of block D follow from its values."""
    have = [c for c in df.columns if c.startswith("f_")]
    fixed = {"A": TRANSACTIONAL, "B": CALENDAR, "C": BEHAVIOUR}
    out = {block: [c for c in own if c in have] for block, own in fixed.items()}
    return out | {"D": [c for c in have if c.startswith(CONTEXTUAL)]}


def constant(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without spread (fewer than two values, or one finite value only), by one aggregation.

    Least and greatest value tell: a deviation merged from partial means of equal values may be a little above 0."""
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    same = [(F.count(v) < 2) | (F.min(v) == F.max(v)) & (F.abs(F.max(v)) < float("inf")) for v in x]
    got = df.agg(*[s.alias(f"c{k}") for k, s in enumerate(same)]).first()
    return [c for k, c in enumerate(columns) if got[k]]


def gaps(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns in which a value is missing, by one aggregation: no other needs a median to be filled with."""
    got = df.agg(*[F.count_if(F.col(f"`{c}`").cast("double").isNull()).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [c for k, c in enumerate(columns) if got[k]]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median of each column, 0 where it has no value."""
    from ..operators.stats import exact_quantiles

    got = exact_quantiles(df, columns, [0.5]).get(None, {}) if columns else {}
    return {c: got[c][0] if got.get(c) else 0.0 for c in columns}


def imputed(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(v))) for c, v in values.items()})


def leaking(columns: list[str]) -> list[str]:
    """Features whose names say that they know the outcome."""
    return [c for c in columns if any(x in c.lower() for x in LEAKS)]


# The levels, badges, units and bands of the three functions below, as consumers of the exports expect them.
def risk_level(score: Column) -> Column:
    """Right-closed levels of a score from 0 to 100; null outside."""
    return F.when((score < 0) | (score > 100) | score.isNull(), None).when(score <= 70, "Normal").when(score <= 85, "Modéré").when(score <= 95, "Élevé").otherwise("Critique")


def badge(score: Column) -> Column:
    """Left-closed levels, as shown beside a score."""
    return F.when(score >= 95, "CRITIQUE").when(score >= 85, "ÉLEVÉ").when(score >= 70, "MODÉRÉ").otherwise("NORMAL")


def money(x: Column, unit: str = "MGA") -> Column:
    """An amount in the unit that fits its size; halves of whole numbers go to the even one."""
    return F.when(x.isNull(), "—").when(x >= 1e9, F.format_string(f"%.2f Mrd {unit}", x / 1e9)).when(x >= 1e6, F.format_string(f"%.1f M {unit}", x / 1e6)).when(x >= 1e3, F.format_string(f"%.0f K {unit}", F.bround(x / 1e3, 0))).otherwise(F.format_string(f"%.0f {unit}", F.bround(x, 0)))


def segment(volume: Column, low: int = 10, mid: int = 100, high: int = 1000) -> Column:
    """Band of an account by its number of transfers."""
    return F.when(volume <= low, "faible").when(volume <= mid, "moyen").when(volume <= high, "eleve").when(volume > high, "technique")


def reasons(default: str, *rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that hold, joined; the default where none does."""
    said = F.concat_ws(" + ", *[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in rules])
    return F.when(said == "", default).otherwise(said)
