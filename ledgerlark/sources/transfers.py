"""Reading, normalising and writing transfer records."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COLUMNS, DATE_FORMAT, DATES, NUMERIC, InvalidData, number


def read(spark: SparkSession, path: str, columns: list[str] | None = None, fraction: float | None = None, seed: int = 42, limit: int | None = None, bad: str = "keep") -> DataFrame:
    """Records of a .parquet or .csv path (| separated, ISO-8859-1, header); other suffixes are refused.

    bad: what becomes of CSV lines with too many or too few fields: "drop", "keep" with nulls, or the name of a column that
    holds such a line and is null for the others. fraction samples rows, limit takes some.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        # The layout of an export.
        reader = spark.read.option("sep", "|").option("encoding", "ISO-8859-1").option("header", True).option("enforceSchema", True)
        df = reader.option("mode", "DROPMALFORMED" if bad == "drop" else "PERMISSIVE").csv(path)
        if bad not in ("drop", "keep"):
            kinds = T.StructType([*df.schema.fields, T.StructField(bad, T.StringType())])
            df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(kinds).csv(path)
    else:
        raise InvalidData(f"neither .parquet nor .csv: {path}")
    if columns is not None:
        df = df.select(*[c for c in columns if c in df.columns])
    if fraction is not None:
        df = df.sample(False, fraction, seed)
    return df if limit is None else df.limit(limit)


def peek(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(present, missing) of the kept columns, from the header alone."""
    have = set(read(spark, path).columns)
    return [c for c in COLUMNS if c in have], [c for c in COLUMNS if c not in have]


def exact_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed: the first in the order of a digest of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def normalise(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Tolerant casts of the known columns, NaN and the text "nan" to null, and _row_id, the tiebreak of every ordering.

    _row_id is the given column, or a hash of TRANSFER_ID and all other columns, which does not depend on the file layout.
    """
    out = []
    for c in df.columns:
        x, kind = F.col(c), df.schema[c].dataType
        if c in NUMERIC:
            x = number(x)
        elif c in DATES:
            if isinstance(kind, T.StringType):
                x = F.coalesce(F.try_to_timestamp(x, F.lit(DATE_FORMAT)), x.try_cast("timestamp"))
            x = x.cast("timestamp_ntz")
        elif c in COLUMNS:
            x = F.when(x.cast("string") != "nan", x.cast("string"))
        out.append(x.alias(c))
    rest = F.col(row_id) if row_id else F.xxhash64(*[F.col(c) for c in df.columns])
    return df.select(*out, *([] if "_row_id" in df.columns else [rest.alias("_row_id")]))


def convert(spark: SparkSession, csv: str, parquet: str) -> list[str]:
    """CSV to Parquet with the kept columns and the fixed types, in one distributed job; returns the missing columns."""
    have, missing = peek(spark, csv)
    normalise(read(spark, csv, have)).drop("_row_id").write.mode("overwrite").option("compression", "snappy").parquet(parquet)
    return missing


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header and the mark that spreadsheets look for, only when there are rows. Meant for tables that people read:
    one file, written by one task, row by row."""
    if df.isEmpty():
        return False
    quoted = [F.when(F.col(f"`{c}`").cast("string").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    lines = df.select(F.concat_ws(",", *quoted).alias("value")).coalesce(1)
    header = BOM + ",".join(df.columns)

    def headed(batches):
        import pyarrow as pa

        for k, b in enumerate(batches):
            if not k:
                yield pa.RecordBatch.from_arrays([pa.array([header], b.schema.field(0).type)], schema=b.schema)
            yield b

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)
    return True


def write_json(value: object, path: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)


def resolve(df: DataFrame, *names: str) -> str | None:
    """The first of the names that df has, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)
