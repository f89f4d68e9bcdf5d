"""Versions of frozen artefacts in folders, and what the engines read from them.

A model's folder holds a ledger and a folder for each version; a model without a ledger is its own and only version.
"""

from __future__ import annotations

import itertools
import json
import shutil
from datetime import date, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MissingArtefact

# Name and keys of the ledger on disk, and the folders of the engines.
LEDGER = "registry.json"
NAME, NEWEST, VERSIONS = "modele", "latest", "versions"
TAG, WHEN, METRICS, FILES = "tag", "date_publication", "metriques", "fichiers"
FOLDERS = {"m1_fraude": "M1_fraude", "m2_mules": "M2_mules", "m4_commissions": "M4_commissions", "m5_echec": "M5_echec", "m6_reconciliation": "M6_reconciliation"}


def ledger(root: str, model: str) -> dict:
    at = Path(root, model, LEDGER)
    return json.loads(at.read_text(encoding="utf-8")) if at.exists() else {NAME: model, NEWEST: None, VERSIONS: []}


def publish(root: str, model: str, sources: list[str], metrics: dict | None = None, tag: str | None = None) -> str:
    """A new version with copies of files or folders. It shows up as a whole: folder first, then the ledger, each by a rename."""
    book, home = ledger(root, model), Path(root, model)
    used = {v[TAG] for v in book[VERSIONS]}
    if tag is None:
        tag = next(t for t in (f"{date.today():%Y-%m-%d}_v{n}" for n in itertools.count(1)) if t not in used)
    draft = home / f".{tag}.draft"
    shutil.rmtree(draft, ignore_errors=True)
    draft.mkdir(parents=True)
    for source in map(Path, sources):
        copy = shutil.copytree if source.is_dir() else shutil.copy2
        copy(source, draft / source.name)
    draft.rename(home / tag)
    entry = {TAG: tag, WHEN: f"{datetime.now():%Y-%m-%dT%H:%M:%S}", METRICS: metrics or {}, FILES: sorted(Path(s).name for s in sources)}
    page = home / f".{LEDGER}.draft"
    page.write_text(json.dumps(book | {NEWEST: tag, VERSIONS: [*book[VERSIONS], entry]}, ensure_ascii=False, indent=2), encoding="utf-8")
    page.rename(home / LEDGER)
    return tag


def folder(root: str, model: str, version: str = "latest") -> Path:
    tag = ledger(root, model)[NEWEST] if version == "latest" else version
    at = Path(root, model, tag or "")
    if not at.is_dir():
        raise MissingArtefact(f"{model} {version}: no folder {at}")
    return at


def published(root: str) -> list[str]:
    """Models that have a ledger."""
    return sorted(p.parent.name for p in Path(root).glob(f"*/{LEDGER}"))


def params(at: Path) -> dict:
    """The last params*.json by name, so that params_v2 goes before params."""
    if names := sorted(at.glob("params*.json")):
        return json.loads(names[-1].read_text(encoding="utf-8"))
    raise MissingArtefact(f"{at}: params*.json")


def first(at: Path, pattern: str) -> Path:
    """The first file or folder of the pattern, by name."""
    if names := sorted(at.glob(pattern)):
        return names[0]
    raise MissingArtefact(f"{at}: {pattern}")


def table(spark: SparkSession, at: Path, stem: str, key: str) -> DataFrame:
    """A frozen table with a row for each service or the like: stem*.json keyed by the row's name, else Parquet, else CSV."""
    if names := sorted(at.glob(f"{stem}*.json")):
        rows = json.loads(names[-1].read_text(encoding="utf-8"))
        fields = sorted({f for r in rows.values() for f in r})
        kinds = {f: "string" if any(isinstance(r.get(f), str) for r in rows.values()) else "double" for f in fields}
        values = [(k, *(v if (v := r.get(f)) is None or kinds[f] == "string" else float(v) for f in fields)) for k, r in rows.items()]
        return spark.createDataFrame(values, ", ".join([f"`{key}` string", *(f"`{f}` {kinds[f]}" for f in fields)]))
    if names := sorted(at.glob(f"{stem}*.parquet")):
        return spark.read.parquet(str(names[-1]))
    if names := sorted(at.glob(f"{stem}*.csv")):
        df = spark.read.option("header", True).option("inferSchema", True).csv(str(names[-1]))
        return df.withColumnRenamed(df.columns[0], key)
    raise MissingArtefact(f"{at}: {stem}*")


def freeze_table(df: DataFrame, key: str, path: str) -> None:
    """A table with a row for each service or the like, as JSON keyed by the row's name."""
    rows = {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def freeze_forests(models: dict, path: str) -> None:
    plain = {s: {"size": m["size"], "trees": [{k: np.asarray(v).tolist() for k, v in t.items()} for t in m["trees"]]} for s, m in models.items()}
    Path(path).write_text(json.dumps(plain), encoding="utf-8")


def artefacts(spark: SparkSession, root: str, engine: str, version: str = "latest") -> dict:
    """What an engine has frozen: its parameters, and its models and tables beside them."""
    at = folder(root, FOLDERS[engine], version)
    out = params(at)
    if engine == "m1_fraude":
        out["models"] = json.loads(first(at, "forets*.json").read_text(encoding="utf-8"))
    elif engine == "m4_commissions":
        out["reference"] = table(spark, at, "stats_par_service", "SERVICE_TYPE").withColumn("SERVICE_TYPE", F.col("SERVICE_TYPE").cast("string"))
    elif engine == "m5_echec":
        out["model"] = json.loads(first(at, "gbt*.json").read_text(encoding="utf-8"))
    return out


class Parameters:
    """A parameter is taken from the engine's block of the configuration, else from its frozen parameters, else it is the default."""

    def __init__(self, block: dict | None, frozen: dict | None):
        self.levels = [block or {}, frozen or {}]

    def __call__(self, name: str, default):
        return next((level[name] for level in self.levels if level.get(name) is not None), default)
