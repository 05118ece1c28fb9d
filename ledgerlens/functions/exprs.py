"""Column-expression helpers (all JVM-side, codegen-able).

pandas semantics the reference relies on are mapped onto SQL semantics here:
x/0 -> NULL (``try_divide``), coerce -> ``try_cast``, NaN comparisons -> 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b with NULL for a zero or NULL denominator."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def eps_div(a, b, eps: float = 1e-6) -> Column:
    """a / (b + eps), the reference's guarded ratio."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double") + F.lit(eps))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 integer; NULL (pandas NaN comparison) becomes 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def title_case(c) -> Column:
    """pandas ``str.title``: upper-case a letter that follows a non-letter."""
    parts = F.regexp_extract_all(F.lower(col_(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(
        F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def keyword_regex(words: Iterable[str]) -> str:
    """Alternation of literal substrings."""
    return "|".join(re.escape(w) for w in words)


def contains_any(c, words: Sequence[str]) -> Column:
    """Substring test against a keyword list, case-insensitive, NULL -> false."""
    lc = F.lower(col_(c))
    cond = None
    for w in words:
        t = lc.contains(w)
        cond = t if cond is None else (cond | t)
    return F.coalesce(cond if cond is not None else F.lit(False), F.lit(False))


def classify_by_keywords(c, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """First matching rule wins; ``rules`` is [(label, [substring, ...]), ...]."""
    expr = None
    for label, words in rules:
        cond = contains_any(c, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def count_present(c, words: Sequence[str]) -> Column:
    """Number of distinct keywords present as substrings (case-sensitive)."""
    total = F.lit(0)
    for w in dict.fromkeys(words):
        total = total + F.coalesce(col_(c).contains(w), F.lit(False)).cast("int")
    return total


@F.pandas_udf(T.StringType())
def _fixed2(v: pd.Series, grouped: pd.Series) -> pd.Series:
    """Two-decimal text with correct rounding of the exact binary value (Java's
    Formatter rounds the shortest decimal form half-up, which differs on ties),
    optionally with thousands separators.  A small Arrow-batched helper."""
    out = [None if x is None or x != x else (f"{x:,.2f}" if g else f"{x:.2f}") for x, g in zip(v, grouped)]
    return pd.Series(out, dtype=object)


def format_currency(c, currency: str = "GHS") -> Column:
    """FN-1: ``GHS 0`` for null/0; B/M/K with two decimals; else thousands separators."""
    x = col_(c).cast("double")
    scaled = (F.when(x >= 1e9, x / 1e9).when(x >= 1e6, x / 1e6).when(x >= 1e3, x / 1e3).otherwise(x))
    unit = F.when(x >= 1e9, "B").when(x >= 1e6, "M").when(x >= 1e3, "K").otherwise("")
    txt = _fixed2(scaled, x < 1e3)
    return F.when(x.isNull() | (x == 0), F.lit(f"{currency} 0")).otherwise(
        F.concat(F.lit(f"{currency} "), txt, unit))


def risk_category(p) -> Column:
    """FN-9: High > .7, Medium > .3, else Low."""
    p = col_(p)
    return F.when(p > 0.7, "High").when(p > 0.3, "Medium").otherwise("Low")


def confidence(p) -> Column:
    p = col_(p)
    return F.greatest(p, F.lit(1.0) - p)


def risk_level(score) -> Column:
    """FN-10: Critical >= .7, High >= .4, Medium >= .2, else Low."""
    s = col_(score)
    return (F.when(s >= 0.7, "Critical").when(s >= 0.4, "High")
            .when(s >= 0.2, "Medium").otherwise("Low"))


def priority(score) -> Column:
    """FN-12: priority by score > .7 / > .4."""
    s = col_(score)
    return F.when(s > 0.7, "High").when(s > 0.4, "Medium").otherwise("Low")


def resolution_note(score) -> Column:
    """FN-12: note on a resolved case by its score > .7 / > .4."""
    from ledgerlens.functions.rules import RESOLUTION_NOTES as notes
    s = col_(score)
    return F.when(s > 0.7, notes["High"]).when(s > 0.4, notes["Medium"]).otherwise(notes["Low"])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (for comparing results across engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """FEA-11: first candidate present in the schema (metadata only)."""
    cols = set(df.columns)
    for c in candidates:
        if c in cols:
            return c
    return None
