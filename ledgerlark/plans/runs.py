"""What a run leaves in its folder, and reads of it.

Reports, progress and history are small files that the driver writes and reads, so the root of the runs is a path that the
driver reaches; tables under it go through Spark.
"""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import page
from ..sources.transfers import write_json

# Names of the files, and keys of the report, its line in the history, and the progress.
REPORT, PROGRESS, HISTORY = "rapport_run.json", "progression.json", "historique.jsonl"
LINE = ["run_id", "debut", "fin", "duree_s", "modeles_ok", "modeles_ko"]


def place(root: str, run_id: str) -> Path:
    return Path(root, "runs", run_id)


def say(root: str, run_id: str, step: str, percent: float) -> None:
    """Progress, for those who wait."""
    write_json({"etape": step, "pct": round(percent), "maj": f"{datetime.now().isoformat()}"}, str(place(root, run_id) / PROGRESS))


def close(root: str, run_id: str, began: datetime, report: dict) -> dict:
    """The report with its times, written, and its line added to the history."""
    ended = datetime.now()
    told = {"run_id": run_id, "debut": began.isoformat(), "fin": ended.isoformat(), "duree_s": round((ended - began).total_seconds(), 1)}
    told |= {"modeles_ok": sorted(report["modeles"]), "modeles_ko": sorted(report["erreurs"])}
    whole = report | told
    write_json(whole, str(place(root, run_id) / REPORT))
    with Path(root, HISTORY).open("a", encoding="utf-8") as f:
        print(json.dumps({k: told[k] for k in LINE}, ensure_ascii=False), file=f)
    return whole


def history(spark: SparkSession, root: str, last: int = 20) -> DataFrame:
    """The last runs, newest first, at most 200."""
    return spark.read.json(f"{root}/{HISTORY}").orderBy(F.col("run_id").desc()).limit(min(last, 200))


def _with(root: str, name: str) -> set[str]:
    return {p.parent.name for p in Path(root).glob(f"runs/*/{name}")}


def listing(root: str) -> list[str]:
    """Runs with a report, newest first."""
    return sorted(_with(root, REPORT), reverse=True)


def running(root: str) -> list[str]:
    """Runs with progress but no report yet, newest first."""
    return sorted(_with(root, PROGRESS) - _with(root, REPORT), reverse=True)


def report(root: str, run_id: str) -> dict:
    return json.loads((place(root, run_id) / REPORT).read_text(encoding="utf-8"))


def reports(spark: SparkSession, root: str, last: int = 30) -> DataFrame:
    """A row for each of the last reports and engine, oldest first: run_id, fin, engine, n_alertes."""
    rows = []
    for run_id in reversed(listing(root)[:last]):
        told = report(root, run_id)
        rows += [(run_id, told["fin"], engine, int(x.get("n_alertes", 0))) for engine, x in sorted(told["modeles"].items())]
    return spark.createDataFrame(rows, "run_id string, fin string, engine string, n_alertes long")


def alerts_by_run(spark: SparkSession, root: str, last: int = 30) -> DataFrame:
    """All engines' alerts of each of the last runs."""
    return reports(spark, root, last).groupBy("run_id").agg(F.sum("n_alertes").alias("total")).orderBy("run_id")


def alerts(spark: SparkSession, root: str, run_id: str, engine: str, order: str, limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
    """(how many in all, one page)."""
    df = spark.read.parquet(str(place(root, run_id) / engine / "alertes"))
    return df.count(), page(df, [order], limit, offset)


def scores(spark: SparkSession, root: str, run_id: str, engine: str) -> DataFrame:
    return spark.read.parquet(str(place(root, run_id) / engine / "scores"))


def remaining_seconds(elapsed: float, percent: float) -> float | None:
    return elapsed / percent * (100 - percent) if percent > 0 else None


def drift(root: str, run_id: str) -> dict:
    """What a run's report says of drift."""
    return report(root, run_id).get("drift") or {}
