"""Reconciliation: declared links, then record linkage within blocks, then confidence bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import flag, number
from ..tables import stored

# Prefixes that complement each other, names of the decisions.
PAIRS = {"TC": "CO", "XX": "RC"}
AUTO, SUGGESTED, MANUAL = "AUTOMATIQUE", "A_VALIDER", "MANUEL"


def parsed(df: DataFrame, unique: bool = True) -> DataFrame:
    """Rows with prefix, date, session and block of the id; if unique, one for each TRANSFER_ID, the first by _row_id."""
    d = df
    if unique:
        first = F.row_number().over(W.partitionBy("TRANSFER_ID").orderBy("_row_id"))
        d = df.withColumn("_k", first).where("_k = 1").drop("_k")
    parts = F.split(F.col("TRANSFER_ID"), "[.]")
    head = F.get(parts, F.lit(0))
    d = d.withColumns({"TRANSACTION_AMOUNT": F.coalesce(number(F.col("TRANSACTION_AMOUNT")), F.lit(0.0)), "prefixe": F.substring(head, 1, 2), "id_date": F.substring(head, 3, 1 << 20), "session": F.coalesce(F.get(parts, F.lit(1)), F.lit(""))})
    return d.withColumn("bloc", F.concat_ws("_", "id_date", "session"))


def declared(d: DataFrame) -> DataFrame:
    """Rows that declare a counterpart, with its fields (null where there is none)."""
    right = d.select(F.col("TRANSFER_ID").alias("_to"), F.col("TRANSACTION_AMOUNT").alias("j_montant"), F.col("CREATED_ON").alias("j_date"), F.col("bloc").alias("bloc_jumeau"), F.col("prefixe").alias("pref_jumeau"))
    left = d.where(F.col("RECONCILIATION_FOR").isNotNull())
    return left.join(right, F.col("RECONCILIATION_FOR") == F.col("_to"), "left")


def direct(rec: DataFrame, hours: float = 24) -> DataFrame:
    """Declared links that exist, with their confidence."""
    gap = F.abs(F.unix_micros(F.col("CREATED_ON").cast("timestamp")) - F.unix_micros(F.col("j_date").cast("timestamp"))) / 3_600_000_000.0
    trust = 40 + 30 * flag(F.abs(F.col("TRANSACTION_AMOUNT") - F.col("j_montant")) < 1) + 15 * flag(F.col("bloc") == F.col("bloc_jumeau")) + 15 * flag(gap < hours)
    return rec.where("j_montant is not null").select("TRANSFER_ID", F.col("RECONCILIATION_FOR").alias("jumeau_propose"), trust.alias("confiance"), F.lit("lien_direct").alias("source_appariement"), F.lit("lien déclaré contrôlé sur montant, bloc et délai").alias("RAISON"))


def blocked(orphans: DataFrame, d: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """The best counterpart of each orphan in its block: amount alike, then expected prefix if any has it, then the same
    parties if any has them, then nearest in time.

    The amounts of a pair differ by less than 1, so their floors are the same or next to each other: a second join key. Orphans, not the pool, are
    repeated for it. The best one is the least of an order, so candidates are reduced to one where the join makes them.
    """
    expected = F.coalesce(*[F.when(F.col("prefixe") == k, v) for k, v in (PAIRS if pairs is None else pairs).items()], F.lit(None).cast("string"))
    o = orphans.select("TRANSFER_ID", F.col("bloc").alias("o_bloc"), F.col("TRANSACTION_AMOUNT").alias("o_amount"), F.col("CREATED_ON").alias("o_date"), F.col("SENDER_USER_ID").alias("o_s"), F.col("RECEIVER_USER_ID").alias("o_r"), expected.alias("wanted"))
    o = o.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor("o_amount") + k)))
    c = d.select(F.col("TRANSFER_ID").alias("c_id"), "bloc", F.col("TRANSACTION_AMOUNT").alias("c_amount"), F.col("CREATED_ON").alias("c_date"), F.col("prefixe").alias("c_prefix"), F.col("SENDER_USER_ID").alias("c_s"), F.col("RECEIVER_USER_ID").alias("c_r"), F.col("_row_id").alias("c_row"))
    near = (F.col("o_bloc") == F.col("bloc")) & (F.col("cell") == F.floor("c_amount")) & (F.abs(F.col("c_amount") - F.col("o_amount")) < 1) & (F.col("c_id") != F.col("TRANSFER_ID"))
    same = ((F.col("c_s") == F.col("o_s")) & (F.col("c_r") == F.col("o_r"))) | ((F.col("c_s") == F.col("o_r")) & (F.col("c_r") == F.col("o_s")))
    gap = F.abs(F.unix_micros(F.col("c_date").cast("timestamp")) - F.unix_micros(F.col("o_date").cast("timestamp")))
    x = o.join(c, near).select("TRANSFER_ID", "c_id", "c_row", flag(F.col("c_prefix") == F.col("wanted")).alias("p"), flag(same).alias("q"), gap.alias("gap"))
    first = F.struct(-F.col("p"), -F.col("q"), F.col("gap").isNull(), "gap", "c_row")
    x = x.groupBy("TRANSFER_ID").agg(F.min_by(F.struct("c_id", "p", "q"), first).alias("best"), F.count("*").alias("n"), F.count_if(F.col("p") == 1).alias("n_p"))
    # parties count where there was something left to choose
    several = F.when(F.col("best.p") == 1, F.col("n_p")).otherwise(F.col("n")) > 1
    score = 1 + F.col("best.p") + 2 * F.col("best.q") * several.cast("int")
    return x.select("TRANSFER_ID", F.col("best.c_id").alias("jumeau_propose"), F.least(40 + 15 * score, F.lit(100)).alias("confiance"), score.alias("score_criteres"), F.lit("blocking").alias("source_appariement"), F.lit("candidat trouvé par bloc, montant, préfixe et parties").alias("RAISON"))


def reconcile(df: DataFrame, pairs: dict[str, str] | None = None, hours: float = 24, auto: float = 85, unique: bool = True) -> DataFrame:
    """A decision for every row that declares a counterpart. Where rows that share an id are kept (unique: false), there is one for each declared link,
    and one best counterpart for each id of orphans."""
    d = stored(parsed(df, unique))  # read by every step below
    rec = stored(declared(d))
    links = direct(rec, hours)
    orphans = rec.where("j_montant is null")
    found = stored(blocked(orphans, d, pairs).drop("score_criteres"))
    none = orphans.join(found.select("TRANSFER_ID"), "TRANSFER_ID", "left_anti").select("TRANSFER_ID", F.lit(None).cast("string").alias("jumeau_propose"), F.lit(0).alias("confiance"), F.lit("aucun_candidat").alias("source_appariement"), F.lit("aucun candidat compatible trouvé").alias("RAISON"))
    some = links.unionByName(found).withColumn("decision", F.when(F.col("confiance") >= auto, AUTO).otherwise(SUGGESTED))
    return some.unionByName(none.withColumn("decision", F.lit(MANUAL)))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: totals by decision, share settled, hours saved at 3 minutes a case."""
    d = decisions.agg(F.count("*").alias("total"), F.count_if(F.col("decision") == AUTO).alias("n_auto_fiable"), F.count_if(F.col("decision") == SUGGESTED).alias("n_suggestion"), F.count_if(F.col("decision") == MANUAL).alias("n_manuel"))
    return d.withColumn("taux_auto_pct", F.round(F.expr("try_divide(n_auto_fiable * 100.0D, total)"), 1)).withColumn("gain_heures", F.round(F.col("n_auto_fiable") * 3 / 60).cast("long"))


def complete(stats: dict) -> None:
    """Every declared row has exactly one decision."""
    if stats["n_auto_fiable"] + stats["n_suggestion"] + stats["n_manuel"] != stats["total"]:
        raise AssertionError("decisions do not cover the declared rows")


def for_analysts(df: DataFrame, decisions: DataFrame, unique: bool = True) -> DataFrame:
    """The declared rows that no automatic or suggested decision settles, with what an analyst needs."""
    rec = declared(parsed(df, unique))
    settled = decisions.where(F.col("decision") != MANUAL).select("TRANSFER_ID")
    return rec.join(settled, "TRANSFER_ID", "left_anti").select("TRANSFER_ID", "TRANSACTION_AMOUNT", "CREATED_ON", "bloc")


def prefix_modes(rec: DataFrame) -> DataFrame:
    """The commonest counterpart prefix of each prefix, the smallest on ties."""
    return rec.where("pref_jumeau is not null").groupBy("prefixe").agg(F.mode("pref_jumeau", True).alias("complement"))


def block_sizes(d: DataFrame) -> DataFrame:
    n = d.groupBy("bloc").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_blocs"), F.avg("n").alias("mean_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"))


def linkage_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of proposals (TRANSFER_ID, jumeau_propose) against truth (TRANSFER_ID, jumeau): all pairs of rows of one id,
    which are counted, as an id may have many rows on both sides."""
    times = lambda df, n: df.groupBy(*df.columns).agg(F.count("*").alias(n))
    x = times(truth.select("TRANSFER_ID", "jumeau"), "_t").join(times(found.select("TRANSFER_ID", "jumeau_propose"), "_f"), "TRANSFER_ID", "left")
    hit, pairs = F.col("jumeau_propose") == F.col("jumeau"), F.col("_t") * F.coalesce("_f", F.lit(1))
    total = lambda c: F.coalesce(F.sum(F.when(c, pairs)), F.lit(0))
    got = x.agg(total(hit).alias("tp"), total(F.col("jumeau_propose").isNotNull() & ~hit).alias("fp"), total(F.col("jumeau_propose").isNull()).alias("nr"))
    return got.select("*", F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(tp, tp + fp + nr)").alias("recall"))


def pair_diagnostics(d: DataFrame) -> DataFrame:
    """Of the declared pairs: share in one block, and with the same or reversed parties."""
    right = d.select(F.col("TRANSFER_ID").alias("_to"), F.col("bloc").alias("b"), F.col("SENDER_USER_ID").alias("s"), F.col("RECEIVER_USER_ID").alias("r"))
    x = d.join(right, F.col("RECONCILIATION_FOR") == F.col("_to"))
    same = (F.col("s") == F.col("SENDER_USER_ID")) & (F.col("r") == F.col("RECEIVER_USER_ID")) | (F.col("r") == F.col("SENDER_USER_ID")) & (F.col("s") == F.col("RECEIVER_USER_ID"))
    return x.agg(F.avg(flag(F.col("bloc") == F.col("b")).cast("double")).alias("same_block"), F.avg(flag(same).cast("double")).alias("same_parties"))
