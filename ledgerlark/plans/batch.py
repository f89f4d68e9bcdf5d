"""The batch: validation, drift, features once, five engines each on its own, exports and a report."""

from __future__ import annotations

import math
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..operators import anomalies, commissions, failure, graph, quality, reconcile
from ..schema import EngineError, ScoringError
from ..sources.transfers import normalise, write_csv, write_json
from ..tables import stored
from . import registry, runs
from .log import logger

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Engine:
    """score: (batch, or its features if `featured`; artefacts; parameters) -> tables by name."""

    name: str
    score: Callable[[DataFrame, dict, registry.Parameters], Tables]
    featured: bool = False


def _fraud(df: DataFrame, art: dict, get: registry.Parameters) -> Tables:
    bands = get("seuils_segments", {"faible": 10, "moyen": 100, "eleve": 1000})
    x = anomalies.segmented(df, (bands["faible"], bands["moyen"], bands["eleve"]))
    x = stored(anomalies.score(features.imputed(x, art["medians"]), art["models"], art["FEATURE_COLS"], get("budget_alertes_jour", 200), keep=["TRANSFER_ID", "CREATED_ON", "SENDER_USER_ID", "TRANSACTION_AMOUNT", "SERVICE_TYPE", "SEGMENT"]))
    level = features.risk_level(F.col("RISK_SCORE")).alias("RISK_LEVEL")
    alerts = x.where("ALERTE = 1").select("TRANSFER_ID", "CREATED_ON", "SENDER_USER_ID", "TRANSACTION_AMOUNT", "SERVICE_TYPE", "SEGMENT", "RISK_SCORE", level, "RAISON")
    return {"alertes": alerts.orderBy(F.col("RISK_SCORE").desc()), "scores": x.select("TRANSFER_ID", "SEGMENT", "RISK_SCORE", "ALERTE")}


def mules(df: DataFrame, get: registry.Parameters, scaler: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(relays with pagerank, cluster, score and reasons; edges)."""
    e = stored(graph.edges(df))
    t = stored(graph.transit(graph.nodes(e)))
    t = stored(t.join(graph.pagerank(graph.between(e, t)), "node", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))))
    near = graph.candidates(t, get("quantile_candidats", 0.90), most=get("max_points_dbscan", 50_000))
    scaled, _ = graph.robust_scaled(near, graph.FEATURES, scaler)
    clusters = graph.dbscan(scaled, [f"{f}_scaled" for f in graph.FEATURES], get("dbscan_eps", 1.5), get("dbscan_min_samples", 5))
    t = t.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return graph.score(t, get("budget_mules", 500)), e


def _mules(df: DataFrame, art: dict, get: registry.Parameters) -> Tables:
    x, e = mules(df, get, art.get("scaler"))
    x = stored(x)
    own = ["node", "in_degree", "out_degree", "in_montant", "out_montant", "ratio_transit", "transit_score", "pagerank", "cluster", "RISK_SCORE"]
    return {"alertes": x.where("ALERTE = 1").select(*own, "RAISON").orderBy(F.col("RISK_SCORE").desc(), "node"), "scores": x.select(*own, "ALERTE"), "aretes": e}


def _commissions(df: DataFrame, art: dict, get: registry.Parameters) -> Tables:
    agg = stored(commissions.daily(df, get("volume_min_pct_mediane", 0.5)))
    alerts = commissions.alerts(agg, art["reference"], get("seuil_z", 2.5)).orderBy(F.abs("z_score").desc())
    return {"alertes": alerts, "scores": agg, "services_inconnus": commissions.unknown_services(agg, art["reference"])}


def _failures(df: DataFrame, art: dict, get: registry.Parameters) -> Tables:
    x = failure.score(df, art["model"], art["FEATURE_COLS"], art["medians"], get("seuil_alerte_proba", 0.80))
    x = stored(x.select("TRANSFER_ID", "CREATED_ON", "SENDER_USER_ID", "TRANSACTION_AMOUNT", "SERVICE_TYPE", "proba_echec", "ALERTE"))
    return {"alertes": x.where("ALERTE = 1").orderBy(F.col("proba_echec").desc()), "scores": x}


def _links(df: DataFrame, art: dict, get: registry.Parameters) -> Tables:
    x = stored(reconcile.reconcile(df, get("complementaires", None), get("delai_max_h", 24), get("seuil_confiance_auto", 85), get("ids_uniques", True)))
    stats = reconcile.summary(x)
    reconcile.complete(stats.first().asDict())
    by = lambda d: x.where(F.col("decision") == d)
    return {"scores": by(reconcile.AUTO), "alertes": by(reconcile.SUGGESTED), "manuels": by(reconcile.MANUAL), "stats": stats}


TABLE = [Engine("m1_fraude", _fraud, True), Engine("m2_mules", _mules), Engine("m4_commissions", _commissions), Engine("m5_echec", _failures, True), Engine("m6_reconciliation", _links)]
ENGINES = [e.name for e in TABLE]
#: Tables that are also written as CSV, with the mark that spreadsheets look for, when they have rows.
FOR_PEOPLE = ("alertes", "manuels")


def selected(asked: list[str] | None, config: dict) -> list[str]:
    """Engines that are asked for (in any case) and not switched off; unknown names are refused."""
    names = [a.lower() for a in asked] if asked else ENGINES
    if unknown := [n for n in names if n not in ENGINES]:
        raise EngineError(f"unknown engines: {unknown}")
    return [n for n in ENGINES if n in names and config.get(n, {}).get("actif", True)]


# The keys of each engine's figures, and how many digits they have.
def _fraud_figures(t: Tables, counts: dict, art: dict, get: registry.Parameters) -> dict:
    a = F.col("ALERTE") == 1
    got = t["scores"].agg(F.count_if(a).alias("n"), F.avg(a.cast("int")).alias("share"), F.avg(F.when(a, F.col("RISK_SCORE"))).alias("mean")).first()
    segments = {r[0]: r[1] for r in t["scores"].where(F.col("SEGMENT").isNotNull()).groupBy("SEGMENT").count().collect()}
    return {"n_alertes": got["n"], "pct_alertes": round((got["share"] or 0.0) * 100, 4), "budget_jour": get("budget_alertes_jour", 200), "segments": segments, "score_moyen_alertes": None if got["mean"] is None else round(got["mean"], 1)}


def _mule_figures(t: Tables, counts: dict, art: dict, get: registry.Parameters) -> dict:
    top = t["scores"].agg(F.max("cluster")).first()[0]
    return {"n_alertes": counts["n_alertes"], "n_transit": counts["n_scores"], "n_clusters": 0 if top is None else top + 1, "n_aretes": counts["n_aretes"]}


def _commission_figures(t: Tables, counts: dict, art: dict, get: registry.Parameters) -> dict:
    unknown = sorted(str(r[0]) for r in t["services_inconnus"].collect())  # names of services
    return {"moteur": "z_score_historique", "seuil_z": get("seuil_z", 2.5), "n_alertes": counts["n_alertes"], "n_jours_services": counts["n_scores"], "services_inconnus": unknown}


def _failure_figures(t: Tables, counts: dict, art: dict, get: registry.Parameters) -> dict:
    got = t["scores"].agg(F.sum("ALERTE").alias("n"), F.avg("ALERTE").alias("share"), F.avg("proba_echec").alias("mean")).first()
    return {"n_alertes": got["n"] or 0, "pct_alertes": round((got["share"] or 0.0) * 100, 3), "proba_moyenne": None if got["mean"] is None else round(got["mean"], 4), "seuil": get("seuil_alerte_proba", 0.80)}


def _link_figures(t: Tables, counts: dict, art: dict, get: registry.Parameters) -> dict:
    """Halves of the share go up, as SQL rounds."""
    auto, asked, manual = counts["n_scores"], counts["n_alertes"], counts["n_manuels"]
    total = auto + asked + manual
    return {"n_alertes": asked, "n_a_reconcilier": total, "n_auto_fiable": auto, "n_suggestion": asked, "n_manuel": manual, "taux_auto_pct": math.floor(auto / max(total, 1) * 100 * 10 + 0.5) / 10, "gain_heures": round(auto * 3 / 60, 0)}


FIGURES = dict(zip(ENGINES, (_fraud_figures, _mule_figures, _commission_figures, _failure_figures, _link_figures), strict=True))


def written(tables: Tables, at: str) -> tuple[Tables, dict]:
    """An engine's tables, written as Parquet and read back, and how many rows each has."""
    back, counts = {}, {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        back[name] = df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")
        counts[f"n_{name}"] = back[name].count()
    return back, counts


def exported(tables: Tables, figures: dict, at: str) -> None:
    """The people's tables as CSV, and the figures as JSON."""
    for name in FOR_PEOPLE:
        if name in tables:
            write_csv(tables[name], f"{at}/{name}_csv")
    write_json(figures, f"{at}/stats.json")


def execute(df: DataFrame, artefacts: dict[str, dict] | str, root: str, engines: list[str] | None = None, config: dict | None = None, references: dict | str | None = None, row_id: str | None = None, run_id: str | None = None, version: str = "latest") -> dict:
    """Run the engines over a batch and write what they give under root/runs/<id>/<engine>/<table>.

    artefacts: by engine, or the root of a registry; references: by column, or the path of a file of them. A failing
    engine, or failing features, leave the others alone; an export that fails leaves its engine's scores; a report is always
    written. The day's log lies under root/logs.
    """
    config, began = config or {}, datetime.now()
    run_id = run_id or f"{began:%Y%m%d_%H%M%S}"
    report: dict = {"modeles": {}, "erreurs": {}, "traces": {}, "exports": {}}
    log = logger("ledgerlark.batch", f"{root}/logs")
    runs.place(root, run_id).mkdir(parents=True, exist_ok=True)

    def failed(what: str, e: Exception) -> None:
        report["erreurs"][what] = f"{type(e).__name__}: {e}"[:500]
        report["traces"][what] = traceback.format_exc()[-4000:]
        log.error("%s failed: %s", what, report["erreurs"][what])

    try:
        chosen = selected(engines, config)
        steps = ["validation", "drift", *(["features"] if any(e.featured for e in TABLE if e.name in chosen) else []), *chosen]

        def reached(step: str) -> None:
            log.info("%s: %s", run_id, step)
            runs.say(root, run_id, step, 100 * steps.index(step) / len(steps))

        reached("validation")
        df = normalise(df, row_id)
        span = quality.totals(df).first()
        report["periode"] = {"debut": span["debut"], "fin": span["fin"], "jours": span["jours"]}
        report["validation"] = quality.validate(df)
        reached("drift")
        known = quality.load_references(references) if isinstance(references, str) else references
        report["drift"] = quality.drift(df, known) if known else None
        featured, broken = None, None
        if "features" in steps:
            reached("features")
            try:
                featured = stored(features.build(df))
            except Exception as e:
                broken = e
                failed("features", e)
        for engine in (e for e in TABLE if e.name in chosen):
            reached(engine.name)
            at = time.time()
            try:
                if engine.featured and broken:
                    raise ScoringError(f"features: {broken}")
                art = registry.artefacts(df.sparkSession, artefacts, engine.name, version) if isinstance(artefacts, str) else artefacts.get(engine.name, {})
                get = registry.Parameters(config.get(engine.name), art)
                place = f"{root}/runs/{run_id}/{engine.name}"
                tables, counts = written(engine.score(featured if engine.featured else df, art, get), place)
                figures = counts | FIGURES[engine.name](tables, counts, art, get)
                report["modeles"][engine.name] = figures | {"n_entree": report["validation"]["n_rows"], "duree_s": round(time.time() - at, 1)}
                try:
                    exported(tables, figures, place)
                except Exception as e:
                    report["exports"][engine.name] = f"{type(e).__name__}: {e}"[:500]
                    log.error("export of %s failed, its scores are written: %s", engine.name, e)
            except Exception as e:
                failed(engine.name, e)
    except Exception as e:
        failed("run", e)
        raise
    finally:
        report = runs.close(root, run_id, began, report)
        runs.say(root, run_id, "terminé", 100)
    return report


def main(args: list[str] | None = None) -> None:
    """python -m ledgerlark.plans.batch --data FILE --models FOLDER --out FOLDER [--engines A,B] [--references FILE] [--config FILE]"""
    import argparse
    import json

    from pyspark.sql import SparkSession

    from ..sources import transfers

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--models", required=True)
    p.add_argument("--out", default="outputs")
    p.add_argument("--engines", default="")
    p.add_argument("--references")
    p.add_argument("--config")
    p.add_argument("--version", default="latest")
    a = p.parse_args(args)
    config = json.loads(open(a.config, encoding="utf-8").read()) if a.config else {}
    spark = SparkSession.builder.getOrCreate()
    report = execute(transfers.read(spark, a.data), a.models, a.out, a.engines.split(",") if a.engines else None, config, a.references, version=a.version)
    print(json.dumps({k: report[k] for k in runs.LINE}, ensure_ascii=False))


if __name__ == "__main__":
    main()
