"""Cleaning and encoding (CLN-*) of a table by its own statistics.

Fitted statistics of all columns are computed together and enter the transform
as literals; ``operators.fitted`` holds the transformers that keep them for
other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.exprs import NUMERIC_TYPES, contains_any, numeric_columns, string_columns
from ledgerlens.operators.ordered import columns_with_more_values


def _finite(c):
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """CLN-1 fit: exact linear medians (bracketed by sketches, ranked only
    inside the brackets)."""
    from ledgerlens.operators.ordered import exact_quantiles_multi
    if not cols:
        return {}
    d = df.select(*[_finite(c).alias(c) for c in cols])
    return {c: v[0] for c, v in exact_quantiles_multi(d, cols, [0.5]).items()}


def impute_median(df: DataFrame, cols: Sequence[str] | None = None, medians: dict | None = None) -> DataFrame:
    """CLN-1: +-inf -> NULL, then NULL -> column median (fit once, reusable)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    med = medians if medians is not None else fit_medians(df, cols)
    new = {}
    for c in cols:
        x = _finite(c) if isinstance(df.schema[c].dataType, NUMERIC_TYPES) else F.col(c)
        m = med.get(c)
        v = F.coalesce(x, F.lit(m)) if m is not None else x
        new[c] = v.cast(df.schema[c].dataType) if m is not None else v
    return df.withColumns(new) if new else df


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """CLN-2 fit: most frequent value per column, lowest on ties (two-level
    aggregation over all columns: counts per value, then the arg-max)."""
    from ledgerlens.operators.ordered import mode_values
    return mode_values(df, cols)


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None, modes: dict | None = None) -> DataFrame:
    """CLN-2: NULL -> most frequent value (lowest on ties)."""
    cols = list(cols) if cols is not None else string_columns(df)
    mo = modes if modes is not None else fit_modes(df, cols)
    new = {c: F.coalesce(F.col(c), F.lit(mo[c])) for c in cols if mo.get(c) is not None}
    return df.withColumns(new) if new else df


def entity_name_features(df: DataFrame, col: str = "entity_name", flags=rules.NAME_FLAGS) -> DataFrame:
    """CLN-4: name length and six keyword flags (substring semantics)."""
    if col not in df.columns:
        return df
    new = {"entity_name_length": F.length(col).cast("long")}
    for name, words in flags:
        new[name] = contains_any(col, words).cast("int")
    return df.withColumns(new)


def flag_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr") -> DataFrame:
    """CLN-5/6/7: per-column outlier flags (IQR 1.5 fences or |z| > 3 with
    sample std), skipping columns with <= 2 distinct values, plus the row
    total.  Fitted on and applied to the same rows."""
    from ledgerlens.operators.fitted import OutlierFlags
    return OutlierFlags(inputCols=None if cols is None else list(cols), method=method).fit(df).transform(df)


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """CLN-8: 0-based index of the value in sorted order, of any cardinality;
    ``fitted.LabelEncoder`` keeps the dictionary for other rows."""
    from ledgerlens.operators.fitted import LabelEncoder
    return LabelEncoder(inputCol=col, outputCol=out).fit(df).transform(df)


def one_hot(df: DataFrame, col: str, max_categories: int = 10, drop_first: bool = True) -> DataFrame:
    """CLN-9: one column ``col_value`` (1.0/0.0) per sorted category, first
    dropped, source dropped; ``fitted.OneHot`` keeps the categories for other
    rows.  More than ``max_categories`` values are an error."""
    from ledgerlens.operators.fitted import OneHot
    model = OneHot(inputCol=col, maxCategories=max_categories, dropFirst=drop_first, handleUnseen="error").fit(df)
    return model.transform(df)


def standard_scale(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """CLN-10: (x - mean) / population std; zero variance divides by 1.
    ``fitted.Scaler`` keeps the moments for other rows."""
    from ledgerlens.operators.fitted import Scaler
    return Scaler(inputCols=None if cols is None else list(cols)).fit(df).transform(df)


def encode_categoricals(df: DataFrame, max_categories: int = 10, entity: str = "entity_name") -> DataFrame:
    """CLN-8/9 composition: entity name -> entity_id (name kept), other
    string columns one-hot when <= 10 distinct, else label-encoded in place."""
    out = df
    cats = string_columns(df)
    many = columns_with_more_values(df, [c for c in cats if c != entity], max_categories)
    for c in cats:
        if c == entity:
            out = label_encode(out, c, "entity_id")
        elif c not in many:
            out = one_hot(out, c, max_categories)
        else:
            out = label_encode(out, c)
    return out


def zero_fill(df: DataFrame) -> DataFrame:
    """CLN-11: numeric +-inf / NaN / NULL -> 0 (strings untouched)."""
    new = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            x = F.col(f.name)
            if f.dataType.typeName() in ("double", "float"):
                x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
            new[f.name] = F.coalesce(x, F.lit(0).cast(f.dataType))
    return df.withColumns(new) if new else df


def preprocess(df: DataFrame, standardize_names: bool = False, name_threshold: int = 85) -> DataFrame:
    """CLN-12: missing values -> (name standardisation) -> name features ->
    lags -> IQR outliers -> encoding -> scaling -> zero fill, fitted on and
    applied to the same rows (``fitted.fit_preprocess`` keeps the pipeline).

    The reference scales before ratios are computed (quirk Q6); callers that
    engineer features run them on raw values and scale last (``plans.chains``)."""
    from ledgerlens.operators.fitted import fit_preprocess
    d = df
    if standardize_names and "entity_name" in d.columns:
        from ledgerlens.operators.fuzzy import standardize_names as _std
        d = _std(impute_mode(d, ["entity_name"]), threshold=name_threshold)
    return fit_preprocess(d, handle_unseen="error").transform(d)
