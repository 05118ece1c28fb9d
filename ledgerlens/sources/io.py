"""Sources and sinks (SRC-*): parquet / CSV / JSON tables, CSV and JSON
exports, fitted-artifact persistence and append-only logs.

Writes are whole-directory, Spark-native (one file per task, atomic commit
through the output committer), so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC-1: dispatch on the extension; unknown extensions are an error.

    CSV is read as strings with a header (no inference pass over the data);
    ING-2 parses the money columns afterwards."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = _READERS.get(ext)
    if fmt is None:
        raise ValueError(f"unsupported file type {ext!r} for {path}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("inferSchema", False).csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> str:
    """SRC-2: columnar sink; '.parquet' appended when missing; overwrite.
    ``partition_by=['year']`` lets later year filters prune whole folders."""
    if not path.endswith(".parquet"):
        path = path + ".parquet"
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SRC-3: CSV export with header (nested columns as JSON text)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        cols.append(F.to_json(F.col(f.name)).alias(f.name) if t in ("array", "struct", "map") else F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SRC-4: JSON-lines sink (one object per row)."""
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC-4: JSON-lines scan."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def save_model(model, path: str) -> str:
    """SRC-6: persist a fitted MLlib model / pipeline (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str, kind=None):
    """SRC-6: load a persisted model; ``kind`` defaults to PipelineModel."""
    if kind is None:
        from pyspark.ml import PipelineModel as kind  # noqa: N813
    return kind.load(path)


def save_artifact_table(df: DataFrame, path: str) -> str:
    """SRC-6: fitted tables (vocabulary, SVD basis, feature list) as parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def append_log(df: DataFrame, path: str, ts_col: str = "created_at", json_cols=("features", "details")) -> str:
    """SRC-7: append prediction / activity rows, partitioned by day.
    Struct/map payload columns are stored as JSON text (``to_json``)."""
    cols = []
    for f in df.schema.fields:
        if f.name in json_cols and f.dataType.typeName() in ("struct", "map", "array"):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = df.select(*cols, F.to_date(ts_col).alias("log_date"))
    out.write.mode("append").partitionBy("log_date").parquet(path)
    return path
