"""Ingest, schema normalisation and type cleaning (ING-*).

Column-name work is metadata only (``toDF``/``select`` aliases, no job);
value cleaning is one projection + filter, pushed down with the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import rules
from ledgerlens.functions.exprs import NUMERIC_TYPES, title_case


def canonical_name(name: str, strict: bool = False, synonyms=rules.COLUMN_SYNONYMS) -> str:
    """ING-1 for one name: lower + trim, whitespace -> '_' (``strict=True``
    deletes it like the reference, quirk Q1), drop chars outside
    [a-zA-Z0-9_], collapse and strip '_', then the synonym map (last entry
    for a key wins, quirk Q2)."""
    s = str(name).lower().strip()
    if not strict:
        s = re.sub(r"\s+", "_", s)
    s = re.sub(r"[^a-zA-Z0-9_]", "", s)
    s = re.sub(r"_+", "_", s).strip("_")
    mapping = dict(synonyms)
    return mapping.get(s, s)


def normalize_columns(df: DataFrame, strict: bool = False) -> DataFrame:
    """ING-1: canonical column names.  Several sources mapping to one target
    become one column holding the first non-null value in source order
    (quirk Q3)."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(canonical_name(c, strict), []).append(c)
    cols = []
    for target, srcs in groups.items():
        if len(srcs) == 1:
            cols.append(F.col(f"`{srcs[0]}`").alias(target))
        else:
            cols.append(F.coalesce(*[F.col(f"`{s}`") for s in srcs]).alias(target))
    return df.select(*cols)


def parse_money(df: DataFrame, cols: Sequence[str] = rules.MONEY_COLUMNS, accounting: bool = False) -> DataFrame:
    """ING-2: money text -> double.  Strips everything but digits, '.' and
    '-'; unparsable -> NULL.  '(1,234)' loses its parentheses and becomes
    positive (quirk Q4) unless ``accounting=True``."""
    new = {}
    for f in df.schema.fields:
        if f.name not in cols or not isinstance(f.dataType, T.StringType):
            continue
        raw = F.col(f.name)
        v = F.expr(f"try_cast(regexp_replace(`{f.name}`, '(?U)[^\\\\d.-]', '') AS DOUBLE)")
        if accounting:
            v = F.when(F.trim(raw).rlike(r"^\(.*\)$"), -v).otherwise(v)
        new[f.name] = v
    return df.withColumns(new) if new else df


def clean_year(df: DataFrame, lo: int = 2000, hi: int = 2030, col: str = "year") -> DataFrame:
    """ING-3: coerce the year (via double, so '2021.0' parses), keep lo..hi."""
    if col not in df.columns:
        return df
    y = F.expr(f"try_cast(CAST(`{col}` AS STRING) AS DOUBLE)")
    return df.withColumn(col, y).filter(F.col(col).between(lo, hi)).withColumn(col, F.col(col).cast("int"))


def clean_entity_names(df: DataFrame, col: str = "entity_name",
                       null_like: Sequence[str] = rules.NULL_LIKE_NAMES) -> DataFrame:
    """ING-4: trim, title-case (pandas semantics), keep length > 2, drop
    null-like names compared lower-case (quirk Q5)."""
    if col not in df.columns:
        return df
    t = title_case(F.trim(F.col(col)))
    out = df.withColumn(col, t)
    return out.filter(F.col(col).isNotNull() & (F.length(col) > 2) & ~F.lower(F.col(col)).isin(list(null_like)))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """ING-5: drop rows whose every column is NULL."""
    return df.na.drop(how="all")


def validate_required(df: DataFrame, required: str = "entity_name") -> DataFrame:
    """ING-6: the entity column must exist and the table must not be empty."""
    if required not in df.columns:
        raise ValueError(f"required column {required!r} is missing")
    if df.isEmpty():
        raise ValueError("dataset is empty")
    return df


def dataset_profile(df: DataFrame) -> DataFrame:
    """ING-7: per column its type class and null count, from one aggregation
    unpivoted to long form."""
    num = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}
    agg = df.agg(*[(F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias(c) for c in df.columns])
    lon = agg.unpivot([], df.columns, "column_name", "null_count")
    kind = F.when(F.col("column_name").isin(list(num)) if num else F.lit(False), "numeric").otherwise("categorical")
    return lon.select("column_name", kind.alias("column_class"), F.col("null_count").cast("long"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """ING-7: rows, columns, numeric / categorical counts, year range, entities."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs.append(F.min("year").alias("year_min") if "year" in df.columns else F.lit(None).alias("year_min"))
    aggs.append(F.max("year").alias("year_max") if "year" in df.columns else F.lit(None).alias("year_max"))
    aggs.append(F.count_distinct("entity_name").alias("unique_entities") if "entity_name" in df.columns
                else F.lit(None).alias("unique_entities"))
    return df.agg(*aggs).select("rows", F.lit(len(df.columns)).alias("columns"),
                                F.lit(len(num)).alias("numeric_columns"),
                                F.lit(len(df.columns) - len(num)).alias("categorical_columns"),
                                "year_min", "year_max", "unique_entities")


def ingest(df: DataFrame, year_lo: int = 2000, year_hi: int = 2030, strict: bool = False,
           accounting: bool = False, out: str | None = None) -> DataFrame:
    """ING-8: normalise names -> parse money -> year -> names -> drop empty
    rows -> validate, optionally persisted (partitioned by year)."""
    d = normalize_columns(df, strict)
    d = parse_money(d, accounting=accounting)
    d = clean_year(d, year_lo, year_hi)
    d = clean_entity_names(d)
    d = drop_empty_rows(d)
    validate_required(d)
    if out:
        from ledgerlens.sources.io import write_table
        write_table(d, out, partition_by=["year"] if "year" in d.columns else None)
        d = df.sparkSession.read.parquet(out if out.endswith(".parquet") else out + ".parquet")
    return d
