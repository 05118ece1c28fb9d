"""Registered evaluation, monitoring and case-workflow queries (EVL-*, MON-*, CAS-1)."""

from pyspark.sql import functions as F

from ledgerlens.functions import rules as RL
from ledgerlens.operators import evaluate as EV, monitor as MO
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.oracle_fixtures import EY, HIST, ISS, SC, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx

r = S.r


def _sc(spark, sf):
    return fx.scored(spark, sf).withColumn("y_pred", (F.col("score") > 0.5).cast("int"))


@register("evl_confusion_matrix", with_(SC) + """SELECT a.actual, b.predicted,
  (SELECT count(*) FROM sc WHERE y = a.actual AND CAST(score > 0.5 AS INT) = b.predicted) AS count
FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted)""")
def q_confusion(spark, sf):
    """EVL-1: confusion matrix on the full 2x2 grid."""
    return EV.confusion_matrix(_sc(spark, sf), "y", "y_pred")


_CNT = "(SELECT count(*) FROM sc WHERE y = {a} AND CAST(score > 0.5 AS INT) = {b})"


def _report_sql():
    parts = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = _CNT.format(a=k, b=k), _CNT.format(a=o, b=k), _CNT.format(a=k, b=o)
        prec = f"coalesce({tp} * 1.0 / nullif({tp} + {fp}, 0), 0)"
        rec = f"coalesce({tp} * 1.0 / nullif({tp} + {fn}, 0), 0)"
        parts.append(f"SELECT {k} AS label, {r(prec)} AS precision, {r(rec)} AS recall, "
                     f"{r(f'coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0)')} AS f1_score, "
                     f"{tp} + {fn} AS support")
    return with_(SC) + " UNION ALL ".join(parts)


@register("evl_classification_report", _report_sql())
def q_report(spark, sf):
    """EVL-2: per-class precision / recall / F1 / support."""
    return EV.classification_report(_sc(spark, sf), "y", "y_pred")


_CUM = """, c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY score),
t AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
  (SELECT sum(y) FROM sc) AS P, (SELECT sum(1 - y) FROM sc) AS N FROM c)"""


@register("evl_roc_auc", with_(SC) + _CUM + f""" SELECT {r('sum(pos * ((N - fp) + neg / 2.0)) / (max(P) * max(N))')} AS roc_auc FROM t""")
def q_roc_auc(spark, sf):
    """EVL-3: ROC AUC (rank statistic, half ties)."""
    return EV.roc_auc(fx.scored(spark, sf))


@register("evl_roc_curve", with_(SC) + _CUM + f""" SELECT CAST(score AS DOUBLE) AS threshold, {r('fp / N')} AS fpr,
  {r('tp / P')} AS tpr FROM t UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def q_roc_curve(spark, sf):
    """EVL-3: ROC curve points."""
    return EV.roc_curve(fx.scored(spark, sf))


@register("evl_pr_curve", with_(SC) + _CUM + f""" SELECT CAST(score AS DOUBLE) AS threshold, {r('tp / (tp + fp)')} AS precision,
  {r('tp / P')} AS recall FROM t""")
def q_pr_curve(spark, sf):
    """EVL-4: PR curve points."""
    return EV.pr_curve(fx.scored(spark, sf))


@register("evl_pr_auc", with_(SC) + _CUM + f""", o AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0,
  lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM t)
SELECT {r('sum((tp - tp0) / P * (tp / (tp + fp) + CASE WHEN tp0 + fp0 = 0 THEN 1.0 ELSE tp0 / (tp0 + fp0) END) / 2.0)')} AS pr_auc,
  {r('max(P) / (max(P) + max(N))')} AS baseline FROM o""")
def q_pr_auc(spark, sf):
    """EVL-4: trapezoid PR AUC and baseline."""
    return EV.pr_auc(fx.scored(spark, sf))


def _pct_sql(k):
    thr = f"(SELECT quantile_cont(score, {1 - k}) FROM sc)"
    return (f"{r(f'coalesce(sum(CASE WHEN score >= {thr} THEN y END) * 1.0 / nullif(count(CASE WHEN score >= {thr} THEN 1 END), 0), 0)')}"
            f" AS precision_at_{int(round(k * 100))}pct")


@register("evl_precision_at_pct", with_(SC) + f"SELECT {', '.join(_pct_sql(k) for k in (0.05, 0.1, 0.2))} FROM sc")
def q_precision_at_pct(spark, sf):
    """EVL-5: precision at top 5/10/20 %."""
    return EV.precision_at_pct(fx.scored(spark, sf))


@register("evl_precision_at_k", with_(SC) + f""", o AS (SELECT y, row_number() OVER (ORDER BY score DESC, entity_name, year) AS pos FROM sc)
SELECT k, {r('sum(CASE WHEN pos <= least(k, (SELECT count(*) FROM sc)) THEN y ELSE 0 END) * 1.0 / least(k, (SELECT count(*) FROM sc))')} AS precision_at_k
FROM o, (VALUES (10), (20), (50)) v(k) GROUP BY k""")
def q_precision_at_k(spark, sf):
    """EVL-6: precision at k = 10, 20, 50."""
    return EV.precision_at_k(fx.scored(spark, sf), (10, 20, 50))


@register("evl_precision_at_k_curve", with_(SC) + f""", o AS (SELECT y, row_number() OVER (ORDER BY score DESC, entity_name, year) AS pos FROM sc),
c AS (SELECT pos, sum(y) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hits FROM o)
SELECT CAST(pos AS BIGINT) AS k, {r('hits * 1.0 / pos')} AS precision_at_k FROM c WHERE (pos - 1) % 5 = 0 AND pos <= 100""")
def q_precision_at_k_curve(spark, sf):
    """EVL-6: precision@k curve at k = 1, 6, 11, ... <= 100."""
    return EV.precision_at_k_curve(fx.scored(spark, sf), 100, 5)


@register("evl_score_histogram", with_(SC) + """SELECT least(CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 51
  ELSE CAST(floor(50 * (score - 0.0) / (1.0 - 0.0)) AS BIGINT) + 1 END, 50) AS bin,
  count(*) AS count, CAST(sum(y) AS BIGINT) AS positives FROM sc GROUP BY 1""")
def q_score_histogram(spark, sf):
    """EVL-9: 50-bin score distribution."""
    return EV.score_histogram(fx.scored(spark, sf), 50)


# ---- drift -------------------------------------------------------------------

KS_COLS = ["revenue", "expenditure", "total_assets", "total_liabilities", "cash", "payroll_expense",
           "contract_count", "single_source_contracts", "employee_count", "audit_flag"]
_UNP = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, side FROM s WHERE {c} IS NOT NULL" for c in KS_COLS)
_KS_SQL = with_(EY) + f""", yrs AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT year FROM ey WHERE year IS NOT NULL) z),
s AS (SELECT ey.*, CASE WHEN yrs.i < yrs.n // 2 THEN 'ref' ELSE 'cur' END AS side FROM ey JOIN yrs ON ey.year = yrs.year),
l AS ({_UNP}),
vc AS (SELECT feature, value, count(CASE WHEN side = 'ref' THEN 1 END) AS r, count(CASE WHEN side = 'cur' THEN 1 END) AS c
  FROM l GROUP BY feature, value),
cum AS (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS n_ref,
  sum(c) OVER (PARTITION BY feature) AS n_cur FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)),
d AS (SELECT feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
  max(abs(cr / n_ref - cc / n_cur)) AS ks_statistic FROM cum GROUP BY feature),
p AS (SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur))) * ks_statistic AS lam FROM d),
q AS (SELECT *, CASE WHEN lam <= 0 THEN 1.0 WHEN lam > 1 THEN least(1.0, 2 * (exp(-2 * lam * lam) - exp(-8 * lam * lam) + exp(-18 * lam * lam) - exp(-32 * lam * lam) + exp(-50 * lam * lam)))
  ELSE greatest(0.0, 1 - sqrt(2 * pi()) / lam * (exp(-pi() * pi() / (8 * lam * lam)) + exp(-9 * pi() * pi() / (8 * lam * lam)) + exp(-25 * pi() * pi() / (8 * lam * lam)))) END AS p_value FROM p)"""


@register("mon_ks_drift", _KS_SQL + f""" SELECT feature, n_ref, n_cur, {r('ks_statistic')} AS ks_statistic,
  {r('p_value')} AS p_value, p_value < 0.05 AS drift_detected,
  CASE WHEN p_value < 0.01 THEN 'High' WHEN p_value < 0.05 THEN 'Medium' ELSE 'Low' END AS drift_severity FROM q""")
def q_ks_drift(spark, sf):
    """MON-1/2: KS drift per numeric column between the first and second half of the years."""
    ey = fx.entity_year(spark, sf)
    ref, cur = MO.split_reference_current(ey)
    return MO.ks_drift(ref, cur, KS_COLS)


@register("mon_drift_summary", _KS_SQL + f""" SELECT count(*) AS total_features,
  count(CASE WHEN p_value < 0.05 THEN 1 END) AS drifted_features,
  {r('coalesce(count(CASE WHEN p_value < 0.05 THEN 1 END) * 1.0 / nullif(count(*), 0), 0)')} AS drift_percentage,
  coalesce(count(CASE WHEN p_value < 0.05 THEN 1 END) * 1.0 / nullif(count(*), 0), 0) > 0.3 AS overall_drift FROM q""")
def q_drift_summary(spark, sf):
    """MON-1: drift summary."""
    ey = fx.entity_year(spark, sf)
    ref, cur = MO.split_reference_current(ey)
    return MO.drift_summary(MO.ks_drift(ref, cur, KS_COLS))


@register("mon_reference_split", with_(EY) + """, yrs AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i,
  count(*) OVER () AS n FROM (SELECT DISTINCT year FROM ey WHERE year IS NOT NULL) z)
SELECT CASE WHEN yrs.i < yrs.n // 2 THEN 'reference' ELSE 'current' END AS side, count(*) AS rows,
  min(ey.year) AS min_year, max(ey.year) AS max_year FROM ey JOIN yrs ON ey.year = yrs.year GROUP BY 1""")
def q_reference_split(spark, sf):
    """MON-2: reference / current halves by sorted distinct years."""
    ref, cur = MO.split_reference_current(fx.entity_year(spark, sf))
    summ = lambda d, s: d.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("rows"),
                              F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    return summ(ref, "reference").unionByName(summ(cur, "current"))


_THR = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in RL.ALERT_THRESHOLDS.items())
_HL = """, hl AS (SELECT date, model_name, 'roc_auc' AS metric, roc_auc AS value FROM hist
  UNION ALL SELECT date, model_name, 'precision_at_10', precision_at_10 FROM hist
  UNION ALL SELECT date, model_name, 'f1_score', f1_score FROM hist)"""


@register("mon_absolute_alerts", with_(HIST) + _HL + f""", th(metric, threshold) AS (VALUES {_THR})
SELECT hl.date, hl.model_name, hl.metric, {r('hl.value')} AS value, {r('th.threshold')} AS threshold, 'absolute' AS alert_type
FROM hl JOIN th ON hl.metric = th.metric WHERE coalesce(hl.value, 0) < th.threshold""")
def q_absolute_alerts(spark, sf):
    """MON-3: absolute-threshold alerts over the metric history."""
    return MO.absolute_alerts(fx.metric_history(spark, sf), ["date", "model_name"])


_CUR = """, lastd AS (SELECT model_name, max(date) AS d FROM hist GROUP BY model_name),
cur AS (SELECT h.* FROM hist h JOIN lastd l ON h.model_name = l.model_name AND h.date = l.d),
prev AS (SELECT h.* FROM hist h JOIN lastd l ON h.model_name = l.model_name AND h.date < l.d)"""


@register("mon_relative_drops", with_(HIST) + _CUR + f""", rec AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY model_name ORDER BY date DESC) AS rn FROM prev) z WHERE rn <= 5),
ra AS (SELECT model_name, avg(roc_auc) AS roc_auc, avg(precision_at_10) AS precision_at_10, avg(f1_score) AS f1_score
  FROM rec GROUP BY model_name),
al AS (SELECT c.model_name, m.metric, m.cv AS value, m.av AS recent_avg FROM cur c JOIN ra a ON c.model_name = a.model_name,
  LATERAL (VALUES ('roc_auc', c.roc_auc, a.roc_auc), ('precision_at_10', c.precision_at_10, a.precision_at_10),
           ('f1_score', c.f1_score, a.f1_score)) m(metric, cv, av))
SELECT model_name, metric, {r('value')} AS value, {r('recent_avg')} AS recent_avg,
  {r('CASE WHEN recent_avg > 0 THEN (recent_avg - coalesce(value, 0)) / recent_avg ELSE 0 END')} AS drop_ratio,
  'relative' AS alert_type FROM al
WHERE CASE WHEN recent_avg > 0 THEN (recent_avg - coalesce(value, 0)) / recent_avg ELSE 0 END > 0.1""")
def q_relative_drops(spark, sf):
    """MON-4: relative drop vs the mean of the last five history rows."""
    h = fx.metric_history(spark, sf)
    last = h.groupBy("model_name").agg(F.max("date").alias("_d"))
    hj = h.join(last, "model_name")
    cur = hj.filter(F.col("date") == F.col("_d")).drop("_d")
    prev = hj.filter(F.col("date") < F.col("_d")).drop("_d")
    return MO.relative_drops(cur.drop("date"), prev)


@register("mon_status", with_(HIST) + _CUR + f""", th(metric, threshold) AS (VALUES {_THR}),
best AS (SELECT count(*) AS models_monitored, arg_min(model_name, (-roc_auc, model_name)) AS best_model FROM cur),
cl AS (SELECT model_name, 'roc_auc' AS metric, roc_auc AS value FROM cur UNION ALL
  SELECT model_name, 'precision_at_10', precision_at_10 FROM cur UNION ALL SELECT model_name, 'f1_score', f1_score FROM cur),
na AS (SELECT cl.model_name, count(*) AS n FROM cl JOIN th ON cl.metric = th.metric WHERE coalesce(cl.value, 0) < th.threshold
  GROUP BY cl.model_name)
SELECT models_monitored, best_model, coalesce(na.n, 0) AS alert_count,
  CASE WHEN coalesce(na.n, 0) = 0 THEN 'Healthy' WHEN coalesce(na.n, 0) <= 2 THEN 'Warning' ELSE 'Critical' END AS performance_status
FROM best LEFT JOIN na ON best.best_model = na.model_name""")
def q_status(spark, sf):
    """MON-5: monitoring status of the best current model."""
    h = fx.metric_history(spark, sf)
    last = h.groupBy("model_name").agg(F.max("date").alias("_d"))
    cur = h.join(last, "model_name").filter(F.col("date") == F.col("_d")).drop("_d", "date")
    return MO.monitoring_status(cur, MO.absolute_alerts(cur))


@register("mon_metric_timeline", with_(HIST) + f"""SELECT date, model_name, {r('roc_auc')} AS roc_auc,
  {r('precision_at_10')} AS precision_at_10, {r('f1_score')} AS f1_score,
  {', '.join(f"CAST({v} AS DOUBLE) AS {k}_threshold" for k, v in RL.ALERT_THRESHOLDS.items())} FROM hist""")
def q_metric_timeline(spark, sf):
    """MON-6: metric timeline with threshold columns."""
    return MO.metric_timeline(fx.metric_history(spark, sf))


_CASE_EV = """, ev AS (
  SELECT entity_name || '|' || CAST(year AS VARCHAR) AS case_id, 'reviewed' AS status, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM iss WHERE audit_flag = 1
  UNION ALL SELECT entity_name || '|' || CAST(year AS VARCHAR), 'investigating', TIMESTAMP '2024-01-02 00:00:00' FROM iss WHERE severity = 'high' AND audit_flag = 1
  UNION ALL SELECT entity_name || '|' || CAST(year AS VARCHAR), 'resolved', TIMESTAMP '2024-01-03 00:00:00' FROM iss WHERE irregularity_score >= 8)"""


@register("cas_case_status", with_(ISS) + _CASE_EV + """ SELECT case_id, arg_max(status, (ts, status)) AS current_status,
  max(ts) AS updated_at, count(*) AS events FROM ev GROUP BY case_id""")
def q_case_status(spark, sf):
    """CAS-1: review / investigate / resolve events -> current status per case."""
    d = fx.entity_year(spark, sf, labelled=True)
    ev = (MO.case_events(d.filter(F.col("audit_flag") == 1), "review", "2024-01-01 00:00:00")
          .unionByName(MO.case_events(d.filter((F.col("severity") == "high") & (F.col("audit_flag") == 1)),
                                      "investigate", "2024-01-02 00:00:00"))
          .unionByName(MO.case_events(d.filter(F.col("irregularity_score") >= 8), "resolve", "2024-01-03 00:00:00")))
    return MO.case_status(ev)
