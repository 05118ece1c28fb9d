"""Registered aggregation queries (AGG-*) over the entity-year fixtures."""

from pyspark.sql import functions as F

from ledgerlens.operators import aggs
from ledgerlens.plans.oracle_fixtures import EY, EYX, ISS, PRED, USR, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.tables import table

R = 6  # rounding digits in the oracle, equal to registry.DIGITS


def r(expr: str) -> str:
    return f"(round({expr}, {R}) + 0.0)"


_RISK_T = """t AS (SELECT entity_name, max(audit_flag) AS ever_flagged, CAST(sum(audit_flag) AS BIGINT) AS total_flags,
  count(audit_flag) AS total_records, coalesce(sum(expenditure), 0) AS total_expenditure,
  avg(expenditure) AS avg_expenditure, count(year) AS record_count, count(DISTINCT year) AS years_active
  FROM ey WHERE entity_name IS NOT NULL GROUP BY entity_name)"""

_RISK_S = """s AS (SELECT *, ever_flagged * 3.0 + total_flags / total_records * 2.0
  + total_expenditure / (SELECT CASE WHEN max(total_expenditure) > 0 THEN max(total_expenditure) ELSE 1 END FROM t) * 1.0
  + years_active / (SELECT CASE WHEN max(years_active) > 0 THEN max(years_active) ELSE 1 END FROM t) * 0.5 AS risk_score
  FROM t)"""

_RISK_LEVEL = """CASE WHEN ever_flagged = 1 THEN (CASE WHEN risk_score >= 4.0 THEN 'Critical'
  WHEN risk_score >= 3.0 THEN 'High' ELSE 'Medium' END)
  ELSE (CASE WHEN risk_score >= 2.0 THEN 'Medium' WHEN risk_score >= 1.0 THEN 'Low' ELSE 'Very Low' END) END"""

RISK_RANKING_SQL = with_(EY, _RISK_T, _RISK_S) + f"""
SELECT entity_name, ever_flagged, total_flags, total_records, {r('total_expenditure')} AS total_expenditure,
  {r('avg_expenditure')} AS avg_expenditure, record_count, years_active, {r('risk_score')} AS risk_score,
  {_RISK_LEVEL} AS risk_level
FROM s ORDER BY ever_flagged DESC, risk_score DESC, entity_name LIMIT 20"""


@register("agg_entity_risk_ranking", RISK_RANKING_SQL)
def q_entity_risk_ranking(spark, sf):
    """AGG-4 flagship: top-20 entities by (ever flagged, risk score)."""
    return aggs.entity_risk_ranking(fx.entity_year(spark, sf), 20, exp_col="expenditure")


@register("agg_entity_risk_table", with_(EY, _RISK_T) + f"""
SELECT entity_name, ever_flagged, total_flags, total_records, {r('total_expenditure')} AS total_expenditure,
  {r('avg_expenditure')} AS avg_expenditure, record_count, years_active FROM t""")
def q_entity_risk_table(spark, sf):
    """AGG-3: per-entity risk table over all entities."""
    return aggs.entity_risk_table(fx.entity_year(spark, sf, materialize=False), exp_col="expenditure")


@register("agg_entity_risk_scores_all", with_(EY, _RISK_T, _RISK_S) + f"""
SELECT entity_name, ever_flagged, total_flags, total_records, {r('total_expenditure')} AS total_expenditure,
  {r('avg_expenditure')} AS avg_expenditure, record_count, years_active, {r('risk_score')} AS risk_score,
  {_RISK_LEVEL} AS risk_level FROM s""")
def q_entity_risk_scores_all(spark, sf):
    """AGG-4 without the top-N cut: every entity scored and levelled."""
    return aggs.entity_risk_ranking(fx.entity_year(spark, sf), None, exp_col="expenditure")

from ledgerlens.functions import rules as RL  # noqa: E402
from ledgerlens.functions.exprs import classify_by_keywords  # noqa: E402
from ledgerlens.plans import sqlgen as S  # noqa: E402

#: Years of the driver's orders, for the SQL's columns; the operator takes them from the data.
YEARS = list(range(1995, 2002))


@register("agg_kpi_metrics", with_(EY) + f"""
, b AS (SELECT count(DISTINCT entity_name) AS te, count(DISTINCT CASE WHEN audit_flag = 1 THEN entity_name END) AS fe,
  coalesce(sum(CASE WHEN audit_flag = 1 THEN expenditure END), 0) * 0.05 AS tia, avg(audit_flag) AS ars,
  coalesce(sum(expenditure), 0) AS tx FROM ey),
rp AS (SELECT count(*) AS c FROM (SELECT entity_name FROM ey WHERE audit_flag = 1 AND entity_name IS NOT NULL
  GROUP BY entity_name HAVING count(*) >= 2) z)
SELECT te AS total_entities, fe AS flagged_entities, {r('coalesce(fe * 100.0 / nullif(te, 0), 0)')} AS flagged_percentage,
  {r('tia')} AS total_irregularity_amount, {r('ars')} AS avg_risk_score, rp.c AS high_risk_entities,
  {r('tx')} AS total_expenditure, {r('coalesce(tx / nullif(te, 0), 0)')} AS avg_expenditure_per_entity
FROM b, rp""")
def q_kpi_metrics(spark, sf):
    """AGG-1: KPI row."""
    return aggs.kpi_metrics(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_yearly_trend", with_(EY) + f"""
SELECT year, CAST(sum(audit_flag) AS BIGINT) AS flagged_count, count(audit_flag) AS total_records,
  count(DISTINCT entity_name) AS unique_entities,
  {r('sum(audit_flag) * 100.0 / nullif(count(DISTINCT entity_name), 0)')} AS flagged_percentage
FROM ey WHERE year IS NOT NULL GROUP BY year""")
def q_yearly_trend(spark, sf):
    """AGG-2: yearly trend."""
    return aggs.yearly_trend(fx.entity_year(spark, sf, materialize=False))


_TYPE_SQL = S.classify("trim(u)", RL.ISSUE_TYPE_RULES, None)


@register("agg_issue_type_counts", with_(ISS) + f"""
, x AS (SELECT {_TYPE_SQL} AS issue_type FROM (SELECT unnest(string_split(detected_issues, ',')) AS u FROM iss) z),
types(issue_type) AS (VALUES {", ".join(f"('{t}')" for t, _ in RL.ISSUE_TYPE_RULES)})
SELECT t.issue_type, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM types t
LEFT JOIN (SELECT issue_type, count(*) AS n FROM x WHERE issue_type IS NOT NULL GROUP BY issue_type) c
ON t.issue_type = c.issue_type""")
def q_issue_type_counts(spark, sf):
    """AGG-5: issue-type counts, always four rows."""
    return aggs.issue_type_counts(fx.entity_year(spark, sf, labelled=True))


_YCOLS = ", ".join(f"{r(f'coalesce(max(CASE WHEN year = {y} THEN value END), 0)')} AS y{y}" for y in YEARS)


@register("agg_intensity_matrix", with_(EY) + f"""
, g AS (SELECT entity_name, year, sum(audit_flag) AS flags, count(audit_flag) AS records,
  sum(audit_flag) / count(audit_flag) AS value FROM ey GROUP BY entity_name, year),
top AS (SELECT entity_name, CAST(sum(flags) AS BIGINT) AS tot FROM g GROUP BY entity_name ORDER BY tot DESC, entity_name LIMIT 20)
SELECT g.entity_name, top.tot, {_YCOLS} FROM g JOIN top ON g.entity_name = top.entity_name GROUP BY g.entity_name, top.tot""")
def q_intensity_matrix(spark, sf):
    """AGG-6: top-20 entity x year flag intensity matrix."""
    return aggs.intensity_matrix(fx.entity_year(spark, sf))


@register("agg_expenditure_intensity_matrix", with_(EY) + f"""
, g AS (SELECT entity_name, year, sum(expenditure) AS expenditure, ln(1 + sum(expenditure)) AS value
  FROM ey GROUP BY entity_name, year),
top AS (SELECT entity_name, sum(expenditure) AS tot FROM g GROUP BY entity_name ORDER BY tot DESC, entity_name LIMIT 20)
SELECT g.entity_name, {r('top.tot')} AS tot, {_YCOLS} FROM g JOIN top ON g.entity_name = top.entity_name GROUP BY g.entity_name, top.tot""")
def q_expenditure_intensity_matrix(spark, sf):
    """AGG-7: intensity on log expenditure (no flag column)."""
    return aggs.intensity_matrix(fx.entity_year(spark, sf), exp_col="expenditure", flag_col=None)


_DASH_TYPE_SQL = S.classify("entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD)


@register("agg_type_flag_contingency", with_(EY) + f"""
SELECT {_DASH_TYPE_SQL} AS inferred_type, count(CASE WHEN audit_flag = 0 THEN 1 END) AS normal,
  count(CASE WHEN audit_flag = 1 THEN 1 END) AS flagged FROM ey GROUP BY 1""")
def q_type_flag_contingency(spark, sf):
    """AGG-8: inferred type x flag contingency."""
    ey = fx.entity_year(spark, sf)
    ey = ey.withColumn("inferred_type", classify_by_keywords(
        "entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD))
    return aggs.type_flag_contingency(ey)


@register("agg_severity_value_counts", with_(ISS) + f"""
SELECT severity, count(*) AS count, {r('count(*) / (SELECT count(*) FROM iss)')} AS share FROM iss GROUP BY severity""")
def q_severity_value_counts(spark, sf):
    """AGG-9: severity value counts and share."""
    return aggs.value_counts(fx.entity_year(spark, sf, labelled=True), "severity")


@register("agg_flag_value_counts", with_(EY) + f"""
SELECT audit_flag, count(*) AS count, {r('count(*) / (SELECT count(*) FROM ey)')} AS share FROM ey GROUP BY audit_flag""")
def q_flag_value_counts(spark, sf):
    """AGG-9: flag value counts and share."""
    return aggs.value_counts(fx.entity_year(spark, sf), "audit_flag")


@register("agg_year_coverage", with_(EY) + """
SELECT min(year) AS min_year, max(year) AS max_year, count(DISTINCT year) AS years_covered,
  2002 - max(year) AS data_age,
  CASE WHEN 2002 - max(year) <= 1 THEN 'Current' WHEN 2002 - max(year) <= 2 THEN 'Recent' ELSE 'Outdated' END AS freshness
FROM ey""")
def q_year_coverage(spark, sf):
    """AGG-10: year coverage and freshness (as of 2002)."""
    return aggs.year_coverage(fx.entity_year(spark, sf, materialize=False), 2002)


_EY_COLS = ["entity_name", "year", "region", "entity_type", "revenue", "expenditure", "total_assets",
            "total_liabilities", "cash", "payroll_expense", "contract_count", "single_source_contracts",
            "employee_count", "audit_flag"]
_MISS_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM ey" for c in _EY_COLS)


@register("agg_missing_report", with_(EY) + f"""
SELECT column_name, missing, {r('missing_pct')} AS missing_pct FROM ({_MISS_UNION}) z WHERE missing > 0
ORDER BY missing_pct DESC, column_name LIMIT 10""")
def q_missing_report(spark, sf):
    """AGG-11: missing % per column."""
    return aggs.missing_report(fx.entity_year(spark, sf), 10)


_NULLS = " + ".join(f"(count(*) - count({c}))" for c in _EY_COLS)


@register("agg_completeness", with_(EY) + f"""
SELECT count(*) AS total_records, CAST({_NULLS} AS BIGINT) AS missing_cells,
  {r(f'(1 - ({_NULLS}) / (count(*) * {len(_EY_COLS)}.0)) * 100')} AS completeness, {len(_EY_COLS)} AS total_features,
  CASE WHEN (1 - ({_NULLS}) / (count(*) * {len(_EY_COLS)}.0)) * 100 >= 95 THEN 'Excellent'
       WHEN (1 - ({_NULLS}) / (count(*) * {len(_EY_COLS)}.0)) * 100 >= 85 THEN 'Good' ELSE 'Needs Improvement' END AS grade
FROM ey""")
def q_completeness(spark, sf):
    """AGG-11: completeness and grade."""
    return aggs.completeness(fx.entity_year(spark, sf))


@register("agg_describe_expenditure", with_(EY) + f"""
SELECT count(expenditure) AS count, {r('avg(expenditure)')} AS mean, {r('stddev_samp(expenditure)')} AS std,
  {r('min(expenditure)')} AS min, {r('quantile_cont(expenditure, 0.25)')} AS q25,
  {r('quantile_cont(expenditure, 0.5)')} AS median, {r('quantile_cont(expenditure, 0.75)')} AS q75,
  {r('max(expenditure)')} AS max,
  (SELECT count(*) FROM ey WHERE expenditure > (SELECT quantile_cont(expenditure, 0.75)
     + 1.5 * (quantile_cont(expenditure, 0.75) - quantile_cont(expenditure, 0.25)) FROM ey)) AS outliers
FROM ey""")
def q_describe_expenditure(spark, sf):
    """AGG-12: numeric describe + IQR outlier count."""
    return aggs.describe_numeric(fx.entity_year(spark, sf), "expenditure")


@register("agg_entity_flag_rate_stats", with_(EY) + f"""
, p AS (SELECT entity_name, avg(audit_flag) AS flag_rate FROM ey WHERE entity_name IS NOT NULL GROUP BY entity_name)
SELECT {r('avg(flag_rate)')} AS avg_flag_rate, {r('max(flag_rate)')} AS max_flag_rate,
  (SELECT entity_name FROM p ORDER BY flag_rate DESC, entity_name LIMIT 1) AS highest_risk_entity,
  count(CASE WHEN flag_rate > 0.5 THEN 1 END) AS high_risk,
  count(CASE WHEN flag_rate > 0.2 AND flag_rate <= 0.5 THEN 1 END) AS medium_risk,
  count(CASE WHEN flag_rate <= 0.2 THEN 1 END) AS low_risk FROM p""")
def q_entity_flag_rate_stats(spark, sf):
    """AGG-13: entity flag-rate statistics."""
    return aggs.entity_flag_rate_stats(fx.entity_year(spark, sf))


_SEV_P = """p AS (SELECT entity_name, CAST(sum(audit_flag) AS BIGINT) AS total_flags, count(audit_flag) AS total_records,
  avg(audit_flag) AS flag_rate, sum(expenditure) AS total_expenditure FROM ey WHERE entity_name IS NOT NULL GROUP BY entity_name),
sv AS (SELECT *, CASE WHEN flag_rate >= 0.7 AND total_flags >= 3 THEN 'Critical'
  WHEN flag_rate >= 0.4 AND total_flags >= 2 THEN 'High' WHEN flag_rate >= 0.2 OR total_flags >= 1 THEN 'Medium'
  ELSE 'Low' END AS severity FROM p)"""


@register("agg_severity_distribution", with_(EY, _SEV_P) + f"""
SELECT severity, count(*) AS count, {r('count(*) * 100.0 / (SELECT count(*) FROM sv)')} AS pct FROM sv GROUP BY severity""")
def q_severity_distribution(spark, sf):
    """AGG-14: entity severity level distribution."""
    return aggs.severity_distribution(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_entity_severity", with_(EY, _SEV_P) + f"""
SELECT entity_name, total_flags, total_records, {r('flag_rate')} AS flag_rate,
  {r('total_expenditure')} AS total_expenditure, severity FROM sv""")
def q_entity_severity(spark, sf):
    """AGG-14: per-entity severity level."""
    return aggs.entity_severity(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_top_critical", with_(EY, _SEV_P) + f"""
SELECT entity_name, total_flags, total_records, {r('flag_rate')} AS flag_rate,
  {r('total_expenditure')} AS total_expenditure, severity FROM sv WHERE severity = 'Critical'
ORDER BY flag_rate DESC, entity_name LIMIT 5""")
def q_top_critical(spark, sf):
    """AGG-14: top-5 critical entities."""
    return aggs.top_critical(fx.entity_year(spark, sf), 5, exp_col="expenditure")


@register("agg_risk_trend", with_(EY) + f"""
, y AS (SELECT year, avg(audit_flag) * 100 AS rate FROM ey WHERE year IS NOT NULL GROUP BY year),
t AS (SELECT arg_max(rate, year) AS last_rate, arg_min(rate, year) AS first_rate, count(*) AS n_years FROM y),
e AS (SELECT sum(expenditure) AS tx, coalesce(sum(CASE WHEN audit_flag = 1 THEN expenditure END), 0) AS fx FROM ey)
SELECT {r('last_rate')} AS last_rate, {r('first_rate')} AS first_rate, n_years,
  CASE WHEN n_years <= 1 THEN NULL WHEN last_rate > first_rate THEN 'Increasing' ELSE 'Decreasing' END AS trend,
  {r('tx')} AS total_expenditure, {r('fx')} AS at_risk_expenditure,
  {r('CASE WHEN tx > 0 THEN fx / tx * 100 END')} AS risk_exposure FROM t, e""")
def q_risk_trend(spark, sf):
    """AGG-15: risk trend and exposure."""
    return aggs.risk_trend(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_case_summary", with_(EY) + f"""
SELECT count(*) AS total_cases, CAST(coalesce(sum(audit_flag), 0) AS BIGINT) AS flagged_cases,
  {r('coalesce(sum(expenditure), 0)')} AS total_expenditure,
  {r('coalesce(sum(audit_flag) * 100.0 / nullif(count(*), 0), 0)')} AS flag_rate FROM ey""")
def q_case_summary(spark, sf):
    """AGG-16: case summary."""
    return aggs.case_summary(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_case_trend", with_(EY) + f"""
SELECT year, count(*) AS count, CAST(sum(audit_flag) AS BIGINT) AS flagged, {r('sum(expenditure)')} AS expenditure
FROM ey GROUP BY year""")
def q_case_trend(spark, sf):
    """AGG-17: case trend by year."""
    return aggs.case_trend(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_year_over_year", with_(EY) + f"""
SELECT year, count(audit_flag) AS flag_count, CAST(sum(audit_flag) AS BIGINT) AS flag_sum,
  {r('round(avg(audit_flag), 2)')} AS flag_mean, {r('round(sum(expenditure), 2)')} AS expenditure_sum,
  {r('round(avg(expenditure), 2)')} AS expenditure_mean FROM ey GROUP BY year""")
def q_year_over_year(spark, sf):
    """AGG-18: year-over-year table."""
    return aggs.year_over_year(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_findings_summary", with_(ISS) + f"""
SELECT CAST(coalesce(sum(audit_flag), 0) AS BIGINT) AS flagged, count(CASE WHEN severity = 'high' THEN 1 END) AS high_severity,
  CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_total,
  count(detected_issues) AS entities_with_issues,
  {r('coalesce(count(detected_issues) * 100.0 / nullif(count(*), 0), 0)')} AS keyword_match_rate,
  count(DISTINCT entity_name) AS unique_entities,
  (SELECT upper(substr(severity, 1, 1)) || substr(severity, 2) FROM iss GROUP BY severity
   ORDER BY count(*) DESC, severity LIMIT 1) AS modal_severity
FROM iss""")
def q_findings_summary(spark, sf):
    """AGG-19: findings summary."""
    return aggs.findings_summary(fx.entity_year(spark, sf, labelled=True))


@register("agg_issue_categories", with_(ISS) + f"""
SELECT {S.classify('detected_issues', RL.ISSUE_CATEGORY_RULES, RL.ISSUE_CATEGORY_DEFAULT)} AS category, count(*) AS count
FROM iss WHERE detected_issues IS NOT NULL GROUP BY 1""")
def q_issue_categories(spark, sf):
    """AGG-20: 8-way issue categories."""
    return aggs.issue_categories(fx.entity_year(spark, sf, labelled=True))


@register("agg_findings_table", with_(ISS) + """
SELECT entity_name, year, severity, irregularity_score, evidence_count,
  CASE WHEN length(detected_issues) > 100 THEN substr(detected_issues, 1, 100) || '...' ELSE detected_issues END AS issues,
  CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank
FROM iss WHERE audit_flag = 1""")
def q_findings_table(spark, sf):
    """AGG-21: flagged findings table, severity-ranked."""
    return aggs.findings_table(fx.entity_year(spark, sf, labelled=True))


@register("agg_prediction_stats", with_(PRED) + f"""
SELECT count(*) AS total_predictions, count(CASE WHEN prediction THEN 1 END) AS positive_predictions,
  count(CASE WHEN NOT prediction THEN 1 END) AS negative_predictions, {r('avg(confidence)')} AS avg_confidence,
  {r('avg(risk_score)')} AS avg_risk_score, count(DISTINCT entity_name) AS unique_entities FROM pred""")
def q_prediction_stats(spark, sf):
    """AGG-22: prediction statistics."""
    return aggs.prediction_stats(fx.predictions(spark, sf))


_TC = ["customer", "orders", "lineitem", "events", "documents"]


@register("agg_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TC))
def q_table_counts(spark, sf):
    """AGG-23: row counts over a set of tables."""
    return aggs.table_counts({t: table(spark, sf, t) for t in _TC})


@register("agg_account_activity", with_(USR) + f"""
SELECT count(*) AS total_users, count(CASE WHEN role = 'admin' THEN 1 END) AS admins,
  count(CASE WHEN role = 'auditor' THEN 1 END) AS auditors, count(CASE WHEN role = 'viewer' THEN 1 END) AS viewers,
  count(CASE WHEN date_diff('day', CAST(last_login AS DATE), DATE '2024-02-01') <= 30 THEN 1 END) AS active_30d,
  count(CASE WHEN last_login IS NULL THEN 1 END) AS never_logged_in,
  {r("avg(date_diff('day', CAST(created_at AS DATE), DATE '2024-02-01'))")} AS avg_account_age_days FROM usr""")
def q_account_activity(spark, sf):
    """AGG-24: account activity summary."""
    return aggs.account_activity(fx.users(spark, sf), "2024-02-01 00:00:00")


@register("agg_latest_logins", with_(USR) + """
SELECT id, username, role, last_login FROM usr WHERE last_login IS NOT NULL ORDER BY last_login DESC, id LIMIT 10""")
def q_latest_logins(spark, sf):
    """AGG-24: ten latest logins."""
    return aggs.latest_logins(fx.users(spark, sf), 10)


@register("agg_entity_overview", with_(EY) + f"""
SELECT entity_name, count(*) AS records, count(DISTINCT year) AS years, {r('coalesce(sum(expenditure), 0)')} AS total_expenditure,
  CAST(coalesce(sum(audit_flag), 0) AS BIGINT) AS audit_flags, {r('avg(audit_flag)')} AS flag_rate
FROM ey WHERE entity_name IS NOT NULL GROUP BY entity_name""")
def q_entity_overview(spark, sf):
    """AGG-25: entity overview."""
    return aggs.entity_overview(fx.entity_year(spark, sf), exp_col="expenditure")


@register("agg_entity_year_summary", with_(EY) + f"""
SELECT entity_name, year, CAST(sum(audit_flag) AS BIGINT) AS flags, count(*) AS records, {r('avg(audit_flag)')} AS flag_rate,
  {r('sum(expenditure)')} AS expenditure FROM ey WHERE entity_name IS NOT NULL GROUP BY entity_name, year""")
def q_entity_year_summary(spark, sf):
    """AGG-26: entity-year summary."""
    return aggs.entity_year_summary(fx.entity_year(spark, sf, materialize=False), exp_col="expenditure")


@register("agg_data_quality_report", with_(EY) + f"""
, b AS (SELECT count(*) AS rows, CAST({_NULLS} AS BIGINT) AS null_cells FROM ey),
d AS (SELECT count(*) AS dr FROM (SELECT DISTINCT * FROM ey) z),
s AS (SELECT rows, {len(_EY_COLS)} AS columns, null_cells, rows - dr AS duplicate_rows,
  null_cells / (rows * {len(_EY_COLS)}.0) AS ns, (rows - dr) / rows AS ds FROM b, d)
SELECT rows, columns, null_cells, duplicate_rows, {r('ns * 100')} AS null_pct, {r('((1 - ns) + (1 - ds)) / 2')} AS quality_score,
  CASE WHEN ((1 - ns) + (1 - ds)) / 2 > 0.9 THEN 'Excellent' WHEN ((1 - ns) + (1 - ds)) / 2 > 0.7 THEN 'Good'
       WHEN ((1 - ns) + (1 - ds)) / 2 > 0.5 THEN 'Fair' ELSE 'Poor' END AS grade FROM s""")
def q_data_quality_report(spark, sf):
    """AGG-27: data-quality report."""
    return aggs.data_quality_report(fx.entity_year(spark, sf))


@register("agg_facet_entities", with_(EY) + "SELECT DISTINCT entity_name FROM ey WHERE entity_name IS NOT NULL")
def q_facet_entities(spark, sf):
    """AGG-29: sorted distinct entity names."""
    return aggs.facet_values(fx.entity_year(spark, sf), "entity_name")


@register("agg_facet_types", with_(EY) + f"SELECT DISTINCT {_DASH_TYPE_SQL} AS inferred_type FROM ey")
def q_facet_types(spark, sf):
    """AGG-29: sorted distinct inferred entity types."""
    ey = fx.entity_year(spark, sf).withColumn("inferred_type", classify_by_keywords(
        "entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD))
    return aggs.facet_values(ey, "inferred_type")
