"""Fitted transformers that can be saved, loaded and applied to new rows (SRC-6, CLN-1/2, CLN-5..10, CLN-12).

Each is a Spark ML ``Estimator`` / ``Model`` pair, so they chain in a
``Pipeline`` and persist with it.  What a fit has learned is kept as tables:
dictionaries stay DataFrames of any size, joined after a counted size check,
and statistics are one row per column.  A value that the fit has not seen gets
a slot of its own (``handleUnseen='keep'``), null (``'null'``) or raises
(``'error'``); null values stay null, or 0 in one-hot columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import flag, numeric_columns, string_columns
from ledgerlens.operators.joins import broadcast_if_few
from ledgerlens.operators.ordered import columns_with_more_values, exact_quantiles_multi, row_index
from ledgerlens.session import materialize

UNSEEN = ("keep", "null", "error")


class TableModel(Model, MLWritable, MLReadable):
    """A fitted model whose state is named tables beside its params."""

    def __init__(self):
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    def write(self) -> MLWriter:
        return TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls)


class TableWriter(MLWriter):
    """Params as Spark ML metadata, every table as Parquet below it."""

    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         extraMetadata={"tables": sorted(self.instance.tables)})
        for name, df in self.instance.tables.items():
            df.write.parquet(f"{path}/tables/{name}")


class TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.tables = {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in metadata["tables"]}
        return instance


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=converter)


class ColumnParams(Params):
    """Params of the encoders and statistics; an unset list of columns means all that fit."""

    inputCol = _param("inputCol", "column to read", TypeConverters.toString)
    outputCol = _param("outputCol", "column to write", TypeConverters.toString)
    inputCols = _param("inputCols", "columns to read", TypeConverters.toListString)
    handleUnseen = _param("handleUnseen", "values the fit has not seen: keep, null or error", TypeConverters.toString)
    maxCategories = _param("maxCategories", "most categories of a one-hot column", TypeConverters.toInt)
    dropFirst = _param("dropFirst", "leave out the first category", TypeConverters.toBoolean)
    method = _param("method", "iqr or zscore", TypeConverters.toString)
    size = _param("size", "number of values seen", TypeConverters.toInt)

    def configure(self, **params):
        """Set the given params; None leaves one unset."""
        if params.get("handleUnseen", "keep") not in UNSEEN:
            raise ValueError(f"handleUnseen must be one of {UNSEEN}")
        return self._set(**{k: v for k, v in params.items() if v is not None})

    def value(self, name: str):
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None


class _Fitting(Estimator, ColumnParams, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator configured by keywords whose model takes over its params."""

    model_class: type

    def __init__(self, **params):
        super().__init__()
        self._setDefault(handleUnseen="keep", maxCategories=10, dropFirst=True, method="iqr")
        self.configure(**params)

    def _model(self, tables: dict[str, DataFrame], **learned):
        model = self.model_class()
        for param in self.params:
            if self.isDefined(param):
                model._set(**{param.name: self.getOrDefault(param)})
        model.tables = {name: materialize(df, f"fitted-{name}") for name, df in tables.items()}
        return model.configure(**learned)


class _Fitted(TableModel, ColumnParams):
    def rows(self, name: str) -> list:
        """A table of one row per column or category, in the order of the fit."""
        return sorted(self.tables[name].collect(), key=lambda r: r["index"])


def _numbered(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fitted values with their order: one row per column or category."""
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"index int, {schema}")


# ---- CLN-8 -----------------------------------------------------------------

class LabelEncoderModel(_Fitted):
    """Adds the fitted 0-based index of a value; ``size`` is the slot of unseen values."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col, out, unseen = self.value("inputCol"), self.value("outputCol"), self.value("handleUnseen")
        labels = broadcast_if_few(self.tables["labels"])
        j = df.alias("d").join(labels.alias("m"), F.col(f"d.`{col}`") == F.col("m.value"), "left")
        value, index = F.col(f"d.`{col}`"), F.col("m.index")
        new = F.when(value.isNull(), F.lit(None).cast("int")).otherwise(index)
        if unseen == "keep":
            new = F.when(value.isNotNull(), F.coalesce(index, F.lit(self.value("size"))))
        elif unseen == "error":
            new = F.when(value.isNotNull() & index.isNull(),
                         F.raise_error(F.concat(F.lit(f"{col} has a value that was not fitted: "), value.cast("string"))).cast("int")).otherwise(index)
        cols = [new.alias(c) if c == out else F.col(f"d.`{c}`") for c in df.columns]
        return j.select(*cols, *([] if out in df.columns else [new.alias(out)]))


class LabelEncoder(_Fitting):
    """CLN-8 fit: the sorted distinct values and their positions, by a distributed prefix sum."""

    model_class = LabelEncoderModel

    def _fit(self, df: DataFrame) -> LabelEncoderModel:
        col = self.value("inputCol")
        values = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct()
        labels = row_index(values, ["value"], "index").select("value", F.col("index").cast("int").alias("index"))
        model = self._model({"labels": labels}, outputCol=self.value("outputCol") or col)
        return model.configure(size=model.tables["labels"].count())


# ---- CLN-9 -----------------------------------------------------------------

class OneHotModel(_Fitted):
    """A 1.0 / 0.0 column for each fitted category, the source dropped; ``{col}_unseen`` marks others where they are kept."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col, unseen = self.value("inputCol"), self.value("handleUnseen")
        values = [r["value"] for r in self.rows("categories")]
        seen = F.col(col).isin(values) if values else F.lit(False)
        other = F.coalesce(~seen, F.lit(False))
        hit = lambda v: F.when(F.col(col) == v, 1.0).otherwise(0.0)
        if unseen == "error":
            message = F.concat(F.lit(f"{col} has a value that was not fitted: "), F.col(col).cast("string"))
            hit = lambda v: F.when(other, F.raise_error(message).cast("double")).when(F.col(col) == v, 1.0).otherwise(0.0)
        elif unseen == "null":
            hit = lambda v: F.when(~other, F.when(F.col(col) == v, 1.0).otherwise(0.0))
        new = {f"{col}_{v}": hit(v) for v in values[1 if self.value("dropFirst") else 0:]}
        if unseen == "keep":
            new[f"{col}_unseen"] = F.when(other, 1.0).otherwise(0.0)
        return df.withColumns(new).drop(col) if new else df.drop(col)


class OneHot(_Fitting):
    """CLN-9 fit: the sorted categories, checked to be at most ``maxCategories`` before they reach the driver."""

    model_class = OneHotModel

    def _fit(self, df: DataFrame) -> OneHotModel:
        col, most = self.value("inputCol"), self.value("maxCategories")
        values = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{col} has more than {most} categories")
        kind = df.schema[col].dataType.simpleString()
        return self._model({"categories": _numbered(df, [(v,) for v in values], f"value {kind}")})


# ---- CLN-10 ----------------------------------------------------------------

class ScalerModel(_Fitted):
    """(x - mean) / population std of the fitted rows; a std of 0 divides by 1, columns that are absent are passed over."""

    def _transform(self, df: DataFrame) -> DataFrame:
        new = {r["column"]: (F.col(r["column"]) - r["mean"]) / (r["std"] if r["std"] else 1.0)
               for r in self.rows("moments") if r["mean"] is not None and r["column"] in df.columns}
        return df.withColumns(new) if new else df


class Scaler(_Fitting):
    """CLN-10 fit: mean and population std of ``inputCols``, or of all columns that the rule of CLN-10 scales."""

    model_class = ScalerModel

    def _fit(self, df: DataFrame) -> ScalerModel:
        cols = self.value("inputCols")
        cols = scale_columns(df) if cols is None else cols
        row = df.agg(F.lit(0).alias("_"), *[F.struct(F.avg(c), F.stddev_pop(c)).alias(f"_{c}") for c in cols]).first()
        table = [(c, *row[f"_{c}"]) for c in cols]
        return self._model({"moments": _numbered(df, table, "column string, mean double, std double")}, inputCols=cols)


def scale_columns(df: DataFrame, exclude: Sequence[str] = ("year", "audit_flag", "entity_id")) -> list[str]:
    """CLN-10 column choice: numeric, not ``is_*``/year/flag/id, > 2 distinct."""
    cand = [c for c in numeric_columns(df) if not c.startswith("is_") and c not in exclude]
    return columns_with_more_values(df, cand, 2)


# ---- CLN-1/2 ---------------------------------------------------------------

class FillMissingModel(_Fitted):
    """Null and non-finite numbers become the fitted median, null texts the fitted mode."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from ledgerlens.operators.clean import impute_median, impute_mode
        rows = [r for r in self.rows("fills") if r["column"] in df.columns]
        medians = {r["column"]: r["number"] for r in rows if not r["is_text"]}
        modes = {r["column"]: r["text"] for r in rows if r["is_text"]}
        return impute_mode(impute_median(df, list(medians), medians), list(modes), modes)


class FillMissing(_Fitting):
    """CLN-1/2 fit: medians of the numeric columns and modes of the text columns."""

    model_class = FillMissingModel

    def _fit(self, df: DataFrame) -> FillMissingModel:
        from ledgerlens.operators.clean import fit_medians, fit_modes
        cols = self.value("inputCols")
        numbers, words = ([c for c in of(df) if cols is None or c in cols] for of in (numeric_columns, string_columns))
        table = [(c, False, v, None) for c, v in fit_medians(df, numbers).items()] + [(c, True, None, v) for c, v in fit_modes(df, words).items()]
        return self._model({"fills": _numbered(df, table, "column string, is_text boolean, number double, text string")})


# ---- CLN-5/6/7 -------------------------------------------------------------

class OutlierFlagsModel(_Fitted):
    """``{col}_outlier`` by the fitted fences (iqr) or moments (zscore), and their total in a row."""

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = [r for r in self.rows("bounds") if r["column"] in df.columns]
        if not rows:
            return df
        new = {}
        for r in rows:
            x, a, b = F.col(r["column"]), r["a"], r["b"]
            if self.value("method") == "iqr":
                cond = (x < a) | (x > b)
            elif not b:                      # no spread: every other value is out; no std: none is
                cond = F.lit(False) if b is None else (x - a) != 0
            else:
                cond = F.abs((x - a) / b) > 3
            new[f"{r['column']}_outlier"] = flag(cond)
        total = sum((F.col(c) for c in new), F.lit(0))
        return df.withColumns(new).withColumn("total_outlier_count", total)


class OutlierFlags(_Fitting):
    """CLN-5/6 fit over ``inputCols`` (or all numeric columns) with more than two values: 1.5 IQR fences, or mean and sample std."""

    model_class = OutlierFlagsModel

    def _fit(self, df: DataFrame) -> OutlierFlagsModel:
        cols, method = self.value("inputCols"), self.value("method")
        use = columns_with_more_values(df, numeric_columns(df) if cols is None else cols, 2)
        if method == "iqr":
            quartiles = exact_quantiles_multi(df, use, [0.25, 0.75])
            table = [(c, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in quartiles.items()]
        elif method == "zscore":
            row = df.agg(F.lit(0).alias("_"), *[F.struct(F.avg(c), F.stddev_samp(c)).alias(f"_{c}") for c in use]).first()
            table = [(c, *row[f"_{c}"]) for c in use]
        else:
            raise ValueError(method)
        return self._model({"bounds": _numbered(df, table, "column string, a double, b double")}, inputCols=use)


# ---- CLN-12 ----------------------------------------------------------------

class _Plain(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A step without fitted state."""


class NameFeatures(_Plain):
    """CLN-4 as a pipeline step."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from ledgerlens.operators.clean import entity_name_features
        return entity_name_features(df)


class LagFeatures(_Plain):
    """WIN-1 as a pipeline step, where the table has entities and years."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from ledgerlens.operators.ordered import lag_features
        return lag_features(df) if {"year", "entity_name"} <= set(df.columns) else df


class ZeroFill(_Plain):
    """CLN-11 as a pipeline step."""

    def _transform(self, df: DataFrame) -> DataFrame:
        from ledgerlens.operators.clean import zero_fill
        return zero_fill(df)


def fit_preprocess(df: DataFrame, handle_unseen: str = "keep", max_categories: int = 10, entity: str = "entity_name") -> PipelineModel:
    """CLN-12 fit: missing values, name features, lags, IQR outliers, encoding, scaling and zero fill as one
    pipeline model that can be saved and applied to new rows.

    The table is written once after the lags and once after the joins of the encoders, which the later fits read."""
    front = Pipeline(stages=[FillMissing(), NameFeatures(), LagFeatures()]).fit(df)
    d = materialize(front.transform(df), "preprocess-lags")
    words = string_columns(d)
    many = columns_with_more_values(d, [c for c in words if c != entity], max_categories)
    encoders = [LabelEncoder(inputCol=c, outputCol="entity_id" if c == entity else c, handleUnseen=handle_unseen) if c == entity or c in many
                else OneHot(inputCol=c, maxCategories=max_categories, handleUnseen=handle_unseen) for c in words]
    middle = Pipeline(stages=[OutlierFlags(), *encoders]).fit(d)
    d = materialize(middle.transform(d), "preprocess-encoded")
    back = Pipeline(stages=[Scaler(), ZeroFill()]).fit(d)
    return PipelineModel(stages=[*front.stages, *middle.stages, *back.stages])
