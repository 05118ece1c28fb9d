"""Drift, model monitoring and case workflow (MON-*, CAS-1)."""

from __future__ import annotations

import math

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.functions import rules
from ledgerlens.operators.aggs import distinct_years
from ledgerlens.operators.ordered import prefix_sums

#: Product of the sample sizes up to which the drift p-value is exact.
EXACT_CELLS = 10_000
METRICS = ["roc_auc", "precision_at_10", "f1_score"]


def _long(df: DataFrame, cols: Sequence[str], side: str) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .withColumn("side", F.lit(side)))


def kolmogorov_p(d: F.Column, n: F.Column, m: F.Column, terms: int = 20) -> F.Column:
    """Asymptotic two-sample KS p-value: Q_KS(lambda), lambda =
    (sqrt(en) + 0.12 + 0.11 / sqrt(en)) * D, en = n*m/(n+m), as a JVM-side
    series (no Python); clipped to [0, 1].  The alternating series converges
    fast for large lambda, its theta-function twin for small lambda; a few
    terms of the right one are exact to double precision."""
    n, m = n.cast("double"), m.cast("double")
    en = n * (m / (n + m))
    lam = (F.sqrt(en) + 0.12 + 0.11 / F.sqrt(en)) * d
    ks = F.sequence(F.lit(1), F.lit(terms))
    large = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    odd = lambda k: (2 * k - 1).cast("double")
    small = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.exp(-odd(k) * odd(k) * (math.pi ** 2 / 8) / (lam * lam)))
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1.18, 1.0 - math.sqrt(2 * math.pi) / lam * small).otherwise(2.0 * large)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def exact_kolmogorov_p(d: float, n: int, m: int) -> float:
    """Exact two-sample p-value: the share of the lattice paths from (0, 0) to (n, m), all
    equally likely without drift, that touch |i / n - j / m| >= d."""
    limit = round(d * n * m)
    ways = [0] * (m + 1)  # paths to (i, j) that stay inside
    for i in range(n + 1):
        for j in range(m + 1):
            below = ways[j - 1] if j else int(i == 0)
            ways[j] = 0 if abs(i * m - j * n) >= limit else below if i == 0 else ways[j] + (below if j else 0)
    total = math.comb(n + m, n)
    return (total - ways[m]) / total


@F.pandas_udf(DoubleType())
def _small_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([exact_kolmogorov_p(x, int(a), int(b)) if 0 < a * b <= EXACT_CELLS else None for x, a, b in zip(d, n, m)], dtype="float64")


def ks_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str] | None = None,
             threshold: float = rules.DRIFT_P_THRESHOLD) -> DataFrame:
    """MON-1: two-sample KS per numeric column.

    Both samples are unpivoted to (feature, value), counted per value
    (map-side combined), and PFX over (feature, value) gives both empirical
    CDFs; D = max |F_ref - F_cur| per feature.  The work is per distinct
    value, so ties and hot values cost nothing extra.  p is exact up to
    EXACT_CELLS = n_ref * n_cur, the asymptotic series above; null if a side is empty.
    """
    from ledgerlens.functions.exprs import numeric_columns
    cols = [c for c in (cols or numeric_columns(current)) if c in reference.columns]
    lon = _long(reference, cols, "ref").unionByName(_long(current, cols, "cur"))
    vc = lon.groupBy("feature", "value").agg(
        F.count(F.when(F.col("side") == "ref", 1)).alias("r"),
        F.count(F.when(F.col("side") == "cur", 1)).alias("c"))
    pf = prefix_sums(vc, ["value"], ["r", "c"], partition=["feature"])
    n = vc.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    j = pf.join(n, "feature")
    diff = F.abs((F.col("r_below") + F.col("r")) / F.col("n_ref") - (F.col("c_below") + F.col("c")) / F.col("n_cur"))
    d = j.groupBy("feature", "n_ref", "n_cur").agg(F.max(diff).alias("ks_statistic"))
    sizes = F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")
    d = d.withColumn("p_value", F.when(F.col("n_ref") * F.col("n_cur") <= EXACT_CELLS, _small_p(*sizes)).otherwise(kolmogorov_p(*sizes)))
    return d.select("feature", "n_ref", "n_cur", "ks_statistic", "p_value",
                    (F.col("p_value") < threshold).alias("drift_detected"),
                    F.when(F.col("p_value") < 0.01, "High").when(F.col("p_value") < 0.05, "Medium")
                    .otherwise("Low").alias("drift_severity"))


def drift_summary(drift: DataFrame, overall_share: float = 0.3) -> DataFrame:
    """MON-1 summary: features, drifted, share, overall drift if share > 30%."""
    g = drift.agg(F.count(F.lit(1)).alias("total_features"),
                  F.count(F.when(F.col("drift_detected"), 1)).alias("drifted_features"))
    share = F.coalesce(F.try_divide(F.col("drifted_features").cast("double"), F.col("total_features")), F.lit(0.0))
    return g.select("*", share.alias("drift_percentage"), (share > overall_share).alias("overall_drift"))


def split_reference_current(df: DataFrame, year: str = "year") -> tuple[DataFrame, DataFrame]:
    """MON-2: sorted distinct years halved at len // 2 (first half reference).

    The distinct-year list is bounded (``distinct_years`` checks it); it
    becomes two pushed-down ``isin`` filters."""
    years = distinct_years(df, year)
    half = len(years) // 2
    return df.filter(F.col(year).isin(years[:half])), df.filter(F.col(year).isin(years[half:]))


def metrics_long(metrics: DataFrame, id_cols: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    return metrics.unpivot(list(id_cols), [n for n in names if n in metrics.columns], "metric", "value")


def absolute_alerts(metrics: DataFrame, id_cols: Sequence[str] = ("model_name",),
                    thresholds: dict[str, float] = rules.ALERT_THRESHOLDS) -> DataFrame:
    """MON-3: a row per metric below its floor (floors are literals)."""
    lon = metrics_long(metrics, id_cols, list(thresholds))
    thr = F.element_at(F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]),
                       F.col("metric"))
    return (lon.withColumn("threshold", thr).filter(F.coalesce(F.col("value"), F.lit(0.0)) < F.col("threshold"))
            .withColumn("alert_type", F.lit("absolute")))


def relative_drops(current: DataFrame, history: DataFrame, model: str = "model_name", order: str = "date",
                   last: int = 5, drop: float = rules.DEGRADATION_THRESHOLD) -> DataFrame:
    """MON-4: drop ratio of the current value against the mean of each model's
    last ``last`` history rows; alert above ``drop``.  ``row_number <= k``
    runs as a window group limit (top-k per partition before the shuffle)."""
    w = Window.partitionBy(model).orderBy(F.desc(order))
    recent = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last)
    avg = (metrics_long(recent, [model]).groupBy(model, "metric")
           .agg(F.avg("value").alias("recent_avg")))
    cur = metrics_long(current, [model])
    j = cur.join(avg, [model, "metric"])
    ratio = F.when(F.col("recent_avg") > 0, (F.col("recent_avg") - F.coalesce("value", F.lit(0.0))) / F.col("recent_avg")) \
        .otherwise(F.lit(0.0))
    return (j.withColumn("drop_ratio", ratio).filter(F.col("drop_ratio") > drop)
            .withColumn("alert_type", F.lit("relative")))


def monitoring_status(metrics: DataFrame, alerts: DataFrame, model: str = "model_name") -> DataFrame:
    """MON-5: status by alert count of the best model (max ROC AUC, ties by
    name): 0 Healthy, <= 2 Warning, else Critical."""
    best = metrics.agg(F.count(F.lit(1)).alias("models_monitored"),
                       F.min_by(model, F.struct(-F.col("roc_auc"), F.col(model))).alias("best_model"))
    n_alerts = alerts.groupBy(model).agg(F.count(F.lit(1)).alias("n_alerts"))
    j = best.join(n_alerts, best.best_model == n_alerts[model], "left").select(
        "models_monitored", "best_model", F.coalesce("n_alerts", F.lit(0)).alias("alert_count"))
    return j.withColumn("performance_status", F.when(F.col("alert_count") == 0, "Healthy")
                        .when(F.col("alert_count") <= 2, "Warning").otherwise("Critical"))


def metric_timeline(history: DataFrame, thresholds: dict[str, float] = rules.ALERT_THRESHOLDS) -> DataFrame:
    """MON-6: history with its threshold columns, ordered by date."""
    return history.withColumns({f"{k}_threshold": F.lit(v) for k, v in thresholds.items()}).orderBy("date", "model_name")


def case_status(events: DataFrame, case: str = "case_id", status: str = "status", ts: str = "ts") -> DataFrame:
    """CAS-1: current status = latest event per case (``max_by``, a partial
    aggregate, so a hot case is reduced map-side)."""
    return events.groupBy(case).agg(F.max_by(status, F.struct(ts, status)).alias("current_status"),
                                    F.max(ts).alias("updated_at"), F.count(F.lit(1)).alias("events"))


def case_events(df: DataFrame, action: str, ts, case_cols: Sequence[str] = ("entity_name", "year")) -> DataFrame:
    """CAS-1: turn selected rows into workflow events (reviewed / investigating / resolved)."""
    status = {"review": "reviewed", "investigate": "investigating", "resolve": "resolved"}[action]
    return df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in case_cols]).alias("case_id"),
                     F.lit(status).alias("status"), F.lit(ts).cast("timestamp_ntz").alias("ts"))
