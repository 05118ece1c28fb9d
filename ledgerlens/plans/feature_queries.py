"""Registered filter, feature and window queries (FLT-*, FEA-*, WIN-*, TOP, SET)."""

from pyspark.sql import functions as F

from ledgerlens.functions import rules as RL
from ledgerlens.functions.exprs import classify_by_keywords, format_currency, resolution_note, risk_category, confidence, \
    risk_level, priority
from ledgerlens.operators import aggs, features as FE, filters as FL, ordered as OR
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.oracle_fixtures import EY, EYX, ISS, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx

r = S.r
KEY = ["entity_name", "year"]
EY_COLS = ("entity_name, year, region, entity_type, revenue, expenditure, total_assets, total_liabilities, cash, "
           "payroll_expense, contract_count, single_source_contracts, employee_count, audit_flag")
EY_R = ("entity_name, year, region, entity_type, round(revenue, 6) AS revenue, round(expenditure, 6) AS expenditure, "
        "round(total_assets, 6) AS total_assets, round(total_liabilities, 6) AS total_liabilities, "
        "round(cash, 6) AS cash, round(payroll_expense, 6) AS payroll_expense, contract_count, "
        "single_source_contracts, employee_count, audit_flag")


# ---- filters ---------------------------------------------------------------

@register("flt_year_range", with_(EY) + f"SELECT {EY_R} FROM ey WHERE year BETWEEN 1997 AND 1999")
def q_year_range(spark, sf):
    """FLT-1: inclusive year range."""
    return FL.year_range(fx.entity_year(spark, sf, materialize=False), 1997, 1999)


@register("flt_flagged_only", with_(EY) + f"SELECT {EY_R} FROM ey WHERE audit_flag = 1")
def q_flagged_only(spark, sf):
    """FLT-2: flag selector = Flagged."""
    return FL.flag_selector(fx.entity_year(spark, sf, materialize=False), "Flagged")


@register("flt_severity_high", with_(ISS) + "SELECT entity_name, year, severity, irregularity_score FROM iss WHERE severity = 'high'")
def q_severity_high(spark, sf):
    """FLT-3: severity equality."""
    return FL.severity_equals(fx.entity_year(spark, sf, labelled=True, materialize=False), "high").select(
        "entity_name", "year", "severity", "irregularity_score")


_CASE_TYPE = S.classify("entity_name", RL.ENTITY_TYPE_RULES_CASES, RL.ENTITY_TYPE_DEFAULT_CASES)


@register("flt_inferred_type", with_(EY) + f"""SELECT entity_name, year FROM ey
WHERE {_CASE_TYPE} IN ('Education', 'Government')""")
def q_inferred_type(spark, sf):
    """FLT-4: inferred-type multi-select (case-viewer rules)."""
    return FL.inferred_type_in(fx.entity_year(spark, sf, materialize=False), ["Education", "Government"], "cases").select(*KEY)


@register("flt_expenditure_range", with_(EY) + "SELECT entity_name, year FROM ey WHERE expenditure BETWEEN 100000 AND 1000000")
def q_expenditure_range(spark, sf):
    """FLT-5: expenditure range."""
    return FL.min_expenditure(fx.entity_year(spark, sf, materialize=False), 1e5, 1e6, exp_col="expenditure").select(*KEY)


@register("flt_name_search", with_(EY) + "SELECT entity_name, year FROM ey WHERE contains(lower(entity_name), 'hospital')")
def q_name_search(spark, sf):
    """FLT-6: case-insensitive literal name search."""
    return FL.name_search(fx.entity_year(spark, sf, materialize=False), "HOSPITAL").select(*KEY)


def _categories(df):
    """FN-7: irregularity categories array (multi-label, fallback by name)."""
    from ledgerlens.operators.text import irregularity_categories
    return irregularity_categories(df)


_CAT_SQL = ("list_filter([" + ", ".join(
    f"CASE WHEN {S.contains_any('detected_issues', ws)} THEN '{lab}' END" for lab, ws in RL.ISSUE_TYPE_RULES)
    + "], lambda x: x IS NOT NULL)")
_FALLBACK_SQL = ("CASE " + " ".join(
    f"WHEN {S.contains_any('entity_name', ws)} THEN [{', '.join(repr(c) for c in cats)}]"
    for cats, ws in RL.ISSUE_FALLBACK_RULES) + f" ELSE [{', '.join(repr(c) for c in RL.ISSUE_FALLBACK_DEFAULT)}] END")
CATEGORIES_SQL = f"CASE WHEN len({_CAT_SQL}) = 0 THEN {_FALLBACK_SQL} ELSE {_CAT_SQL} END"


@register("fn_irregularity_categories", with_(ISS) + f"""SELECT entity_name, year,
  array_to_string({CATEGORIES_SQL}, '|') AS categories FROM iss""")
def q_irregularity_categories(spark, sf):
    """FN-7: irregularity category array per row (joined for comparison)."""
    d = _categories(fx.entity_year(spark, sf, labelled=True, materialize=False))
    return d.select(*KEY, F.array_join("irregularity_categories", "|").alias("categories"))


@register("flt_category_overlap", with_(ISS) + f"""SELECT entity_name, year FROM iss
WHERE list_has_any({CATEGORIES_SQL}, ['Tax', 'Payroll'])""")
def q_category_overlap(spark, sf):
    """FLT-7: category overlap with a selected set."""
    return FL.category_overlap(_categories(fx.entity_year(spark, sf, labelled=True, materialize=False)), ["Tax", "Payroll"]).select(*KEY)


@register("flt_risk_focus_medium", with_(EY) + """SELECT entity_name, year FROM ey WHERE entity_name IN (
  SELECT entity_name FROM ey GROUP BY entity_name HAVING avg(audit_flag) > 0 AND avg(audit_flag) < 0.5)""")
def q_risk_focus_medium(spark, sf):
    """FLT-8: medium risk focus (entities with 0 < mean flag < .5)."""
    return FL.risk_focus(fx.entity_year(spark, sf), "Medium").select(*KEY)


@register("flt_quick_recent", with_(ISS) + "SELECT entity_name, year FROM iss WHERE irregularity_score > 0.6 AND year >= 1999")
def q_quick_recent(spark, sf):
    """FLT-9: quick filters (score > .6 and year >= now - 2, now = 2001)."""
    d = FL.quick_filter(fx.entity_year(spark, sf, labelled=True, materialize=False), "high_score")
    return FL.quick_filter(d, "recent", 2001).select(*KEY)


@register("flt_entity_lookup_partial", with_(EY) + """SELECT entity_name, year FROM ey
WHERE entity_name = 'university' OR (NOT EXISTS (SELECT 1 FROM ey WHERE entity_name = 'university')
  AND contains(lower(entity_name), 'university'))""")
def q_entity_lookup_partial(spark, sf):
    """FLT-10: lookup falls back to partial match when no exact name exists."""
    return FL.entity_lookup(fx.entity_year(spark, sf), "university").select(*KEY)


@register("flt_entity_lookup_exact", with_(EY) + """SELECT entity_name, year FROM ey
WHERE entity_name = 'Customer#000000001 Hospital' OR (NOT EXISTS (SELECT 1 FROM ey WHERE entity_name = 'Customer#000000001 Hospital')
  AND contains(lower(entity_name), lower('Customer#000000001 Hospital')))""")
def q_entity_lookup_exact(spark, sf):
    """FLT-10: exact tier wins when present."""
    return FL.entity_lookup(fx.entity_year(spark, sf), "Customer#000000001 Hospital").select(*KEY)


@register("flt_entity_history", with_(EY) + f"SELECT {EY_R} FROM ey WHERE entity_name = 'Customer#000000002 Commission'")
def q_entity_history(spark, sf):
    """FLT-11: entity history ordered by year."""
    return FL.entity_history(fx.entity_year(spark, sf, materialize=False), "Customer#000000002 Commission")


@register("flt_page", with_(EY) + """SELECT entity_name, year, audit_flag FROM ey
ORDER BY year DESC, entity_name LIMIT 25 OFFSET 50""")
def q_page(spark, sf):
    """FLT-12: third page of 25 rows, newest first."""
    return FL.page(fx.entity_year(spark, sf, materialize=False), [F.desc("year"), F.asc("entity_name")], 2, 25).select(
        "entity_name", "year", "audit_flag")


# ---- scalar functions --------------------------------------------------------

_CUR = """CASE WHEN x IS NULL OR x = 0 THEN 'GHS 0'
  WHEN x >= 1e9 THEN 'GHS ' || printf('%.2f', x / 1e9) || 'B'
  WHEN x >= 1e6 THEN 'GHS ' || printf('%.2f', x / 1e6) || 'M'
  WHEN x >= 1e3 THEN 'GHS ' || printf('%.2f', x / 1e3) || 'K'
  ELSE 'GHS ' || printf('%,.2f', x) END"""


@register("fn_format_currency", with_(EY) + f"""SELECT entity_name, year,
  {_CUR.replace('x', '(expenditure / 1000.0 - 500)')} AS expenditure_text,
  {_CUR.replace('x', 'cash')} AS cash_text FROM ey""")
def q_format_currency(spark, sf):
    """FN-1: currency text over every scale, incl. small and negative values."""
    ey = fx.entity_year(spark, sf)
    return ey.select(*KEY, format_currency(F.col("expenditure") / 1000.0 - 500).alias("expenditure_text"),
                     format_currency("cash").alias("cash_text"))


_DASH = S.classify("entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD)
_PROF = S.classify("entity_name", RL.ENTITY_TYPE_RULES_PROFILE, RL.ENTITY_TYPE_DEFAULT_PROFILE)


@register("fn_entity_types", with_(EY) + f"""SELECT DISTINCT entity_name, {_DASH} AS type_dashboard,
  {_CASE_TYPE} AS type_cases, {_PROF} AS type_profile FROM ey""")
def q_entity_types(spark, sf):
    """FN-6: the three entity-type rule sets."""
    ey = fx.entity_year(spark, sf).select("entity_name").distinct()
    return ey.select("entity_name",
                     classify_by_keywords("entity_name", RL.ENTITY_TYPE_RULES_DASHBOARD, RL.ENTITY_TYPE_DEFAULT_DASHBOARD).alias("type_dashboard"),
                     classify_by_keywords("entity_name", RL.ENTITY_TYPE_RULES_CASES, RL.ENTITY_TYPE_DEFAULT_CASES).alias("type_cases"),
                     classify_by_keywords("entity_name", RL.ENTITY_TYPE_RULES_PROFILE, RL.ENTITY_TYPE_DEFAULT_PROFILE).alias("type_profile"))


@register("fn_issue_category", with_(ISS) + f"""SELECT entity_name, year,
  {S.classify('detected_issues', RL.ISSUE_CATEGORY_RULES, RL.ISSUE_CATEGORY_DEFAULT)} AS issue_category FROM iss""")
def q_issue_category(spark, sf):
    """FN-8: 8-way issue category per row."""
    d = fx.entity_year(spark, sf, labelled=True)
    return d.select(*KEY, classify_by_keywords("detected_issues", RL.ISSUE_CATEGORY_RULES,
                                               RL.ISSUE_CATEGORY_DEFAULT).alias("issue_category"))


_P = "(total_liabilities / total_assets)"


@register("fn_risk_labels", with_(EY) + f"""SELECT entity_name, year,
  CASE WHEN {_P} > 0.7 THEN 'High' WHEN {_P} > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_category,
  {r(f'greatest({_P}, 1 - {_P})')} AS confidence,
  CASE WHEN {_P} >= 0.7 THEN 'Critical' WHEN {_P} >= 0.4 THEN 'High' WHEN {_P} >= 0.2 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN {_P} > 0.7 THEN 'High' WHEN {_P} > 0.4 THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN {_P} > 0.7 THEN {S.q(RL.RESOLUTION_NOTES['High'])} WHEN {_P} > 0.4 THEN {S.q(RL.RESOLUTION_NOTES['Medium'])} ELSE {S.q(RL.RESOLUTION_NOTES['Low'])} END AS resolution_note,
  array_to_string(CASE WHEN {_P} >= 0.7 THEN {list(RL.RISK_RECOMMENDATIONS['Critical'])}
    WHEN {_P} >= 0.4 THEN {list(RL.RISK_RECOMMENDATIONS['High'])} WHEN {_P} >= 0.2 THEN {list(RL.RISK_RECOMMENDATIONS['Medium'])}
    ELSE {list(RL.RISK_RECOMMENDATIONS['Low'])} END, '|') AS recommendations FROM ey""")
def q_risk_labels(spark, sf):
    """FN-9/10/12: risk category, confidence, level, recommendations, priority, resolution note."""
    from ledgerlens.operators.risk import recommendations
    ey = fx.entity_year(spark, sf)
    p = F.col("total_liabilities") / F.col("total_assets")
    return ey.select(*KEY, risk_category(p).alias("risk_category"), confidence(p).alias("confidence"),
                     risk_level(p).alias("risk_level"), priority(p).alias("priority"), resolution_note(p).alias("resolution_note"),
                     F.array_join(recommendations(risk_level(p)), "|").alias("recommendations"))


# ---- features ----------------------------------------------------------------

_FIN_SQL = f"""{r('cash / (total_liabilities + 1e-6)')} AS cash_ratio,
  {r('total_assets / (total_liabilities + 1e-6)')} AS current_ratio, {r('total_liabilities / (total_assets + 1e-6)')} AS debt_ratio,
  {r('revenue / (total_assets + 1e-6)')} AS asset_turnover, {r('expenditure / (revenue + 1e-6)')} AS expense_ratio,
  {r('(revenue - expenditure) / (revenue + 1e-6)')} AS operating_margin, {r('ln(1 + total_assets)')} AS log_total_assets,
  {r('ln(1 + revenue)')} AS log_revenue, {r('equity / (total_assets + 1e-6)')} AS equity_ratio"""
_FIN = ["cash_ratio", "current_ratio", "debt_ratio", "asset_turnover", "expense_ratio", "operating_margin",
        "log_total_assets", "log_revenue", "equity_ratio"]


@register("fea_financial_ratios", with_(EYX) + f"SELECT entity_name, year, {_FIN_SQL} FROM eyx")
def q_financial_ratios(spark, sf):
    """FEA-1: financial ratios."""
    return FE.financial_ratios(fx.entity_year_ext(spark, sf)).select(*KEY, *_FIN)


_PROC = ["single_source_ratio", "avg_contract_value", "contract_to_assets_ratio", "contract_to_expenditure_ratio"]


@register("fea_procurement_indicators", with_(EYX) + f"""SELECT entity_name, year,
  {r('single_source_contracts / (contract_count + 1e-6)')} AS single_source_ratio,
  {r('contract_value / (contract_count + 1e-6)')} AS avg_contract_value,
  {r('contract_value / (total_assets + 1e-6)')} AS contract_to_assets_ratio,
  {r('contract_value / (expenditure + 1e-6)')} AS contract_to_expenditure_ratio FROM eyx""")
def q_procurement_indicators(spark, sf):
    """FEA-2: procurement indicators."""
    return FE.procurement_indicators(fx.entity_year_ext(spark, sf)).select(*KEY, *_PROC)


@register("fea_temporal_flags", with_(EY) + """SELECT entity_name, year, year - 1995 AS years_since_1995,
  CAST(year >= 1999 AS INT) AS is_recent_year FROM ey""")
def q_temporal_flags(spark, sf):
    """FEA-3: temporal flags with base 1995, recent 1999."""
    return FE.temporal_flags(fx.entity_year(spark, sf), 1995, 1999).select(*KEY, "years_since_1995", "is_recent_year")


_HR = ["revenue_per_employee", "expenditure_per_employee", "avg_salary", "payroll_to_expenditure_ratio"]


@register("fea_payroll_features", with_(EY) + f"""SELECT entity_name, year,
  {r('revenue / (employee_count + 1e-6)')} AS revenue_per_employee,
  {r('expenditure / (employee_count + 1e-6)')} AS expenditure_per_employee,
  {r('payroll_expense / (employee_count + 1e-6)')} AS avg_salary,
  {r('payroll_expense / (expenditure + 1e-6)')} AS payroll_to_expenditure_ratio FROM ey""")
def q_payroll_features(spark, sf):
    """FEA-4: HR / payroll ratios."""
    return FE.payroll_features(fx.entity_year(spark, sf)).select(*KEY, *_HR)


_RISK_SQL = """, f AS (SELECT *, total_liabilities / (total_assets + 1e-6) AS debt_ratio,
  expenditure / (revenue + 1e-6) AS expense_ratio, single_source_contracts / (contract_count + 1e-6) AS single_source_ratio,
  ln(1 + total_assets) AS log_total_assets, (revenue - expenditure) / (revenue + 1e-6) AS operating_margin,
  revenue / (total_assets + 1e-6) AS asset_turnover, ln(1 + revenue) AS log_revenue FROM ey),
g AS (SELECT *, CAST(coalesce(debt_ratio > 0.8, false) AS INT) AS high_debt_risk,
  CAST(coalesce(expense_ratio > 1.0, false) AS INT) AS overspending_risk,
  CAST(coalesce(single_source_ratio > 0.5, false) AS INT) AS procurement_risk FROM f),
h AS (SELECT *, high_debt_risk + overspending_risk + procurement_risk AS composite_risk_score,
  CAST(coalesce(total_assets < (SELECT quantile_cont(total_assets, 0.1) FROM ey)
     OR total_assets > (SELECT quantile_cont(total_assets, 0.9) FROM ey), false) AS INT) AS size_risk FROM g)"""


@register("fea_risk_flags", with_(EY) + _RISK_SQL + """
SELECT entity_name, year, high_debt_risk, overspending_risk, procurement_risk, composite_risk_score, size_risk FROM h""")
def q_risk_flags(spark, sf):
    """FEA-5/6/7: threshold flags, composite score, size risk."""
    d = FE.size_risk(FE.risk_flags(FE.procurement_indicators(FE.financial_ratios(fx.entity_year(spark, sf)))))
    return d.select(*KEY, "high_debt_risk", "overspending_risk", "procurement_risk", "composite_risk_score", "size_risk")


@register("fea_interactions", with_(EY) + _RISK_SQL + f"""
SELECT entity_name, year, {r('log_total_assets * operating_margin')} AS size_performance_interaction,
  {r('composite_risk_score * log_total_assets')} AS risk_size_interaction,
  {r('asset_turnover * log_revenue')} AS efficiency_scale_interaction FROM h""")
def q_interactions(spark, sf):
    """FEA-8: interaction features."""
    d = FE.interactions(FE.risk_flags(FE.procurement_indicators(FE.financial_ratios(fx.entity_year(spark, sf)))))
    return d.select(*KEY, "size_performance_interaction", "risk_size_interaction", "efficiency_scale_interaction")


_KPI_SQL = """, lt AS (SELECT entity_name, arg_max(year, year) AS latest_year, count(*) AS years_active,
  avg(audit_flag) AS audit_flag_rate FROM eyx GROUP BY entity_name),
l AS (SELECT e.* FROM eyx e JOIN lt ON e.entity_name = lt.entity_name AND e.year = lt.latest_year),
k AS (SELECT l.entity_name, lt.latest_year, current_assets / (current_liabilities + 1e-6) AS current_ratio,
  total_revenue / (total_assets + 1e-6) AS asset_turnover, total_expenditure / (total_revenue + 1e-6) AS expense_ratio,
  net_profit / (total_revenue + 1e-6) AS profit_margin, net_profit / (total_assets + 1e-6) AS roa,
  total_liabilities / (total_assets + 1e-6) AS debt_ratio, total_liabilities / (equity + 1e-6) AS debt_to_equity,
  lt.years_active, lt.audit_flag_rate FROM l JOIN lt ON l.entity_name = lt.entity_name)"""
_KPIS = ["current_ratio", "asset_turnover", "expense_ratio", "profit_margin", "roa", "debt_ratio", "debt_to_equity",
         "audit_flag_rate"]


@register("fea_profile_kpis", with_(EYX) + _KPI_SQL + f"""
SELECT entity_name, latest_year, years_active, {', '.join(f"{r(c)} AS {c}" for c in _KPIS)} FROM k""")
def q_profile_kpis(spark, sf):
    """FEA-9: latest-row KPIs for every entity in one job."""
    return FE.profile_kpis(fx.entity_year_ext(spark, sf)).select("entity_name", "latest_year", "years_active", *_KPIS)


@register("fea_kpi_health", with_(EYX) + _KPI_SQL + """
SELECT entity_name, CASE WHEN current_ratio BETWEEN 1 AND 3 THEN 'Healthy' ELSE 'Review' END AS current_ratio_status,
  CASE WHEN debt_ratio <= 0.6 THEN 'Good' ELSE 'High' END AS debt_ratio_status,
  CASE WHEN profit_margin > 0 THEN 'Profitable' ELSE 'Loss' END AS profit_margin_status,
  CASE WHEN asset_turnover > 0.5 THEN 'Efficient' ELSE 'Low' END AS asset_turnover_status,
  CASE WHEN expense_ratio < 0.9 THEN 'Controlled' ELSE 'High' END AS expense_ratio_status FROM k""")
def q_kpi_health(spark, sf):
    """FEA-10: KPI health labels."""
    k = FE.kpi_health(FE.profile_kpis(fx.entity_year_ext(spark, sf)))
    return k.select("entity_name", *[c for c in k.columns if c.endswith("_status")])


@register("fea_resolve_columns", with_(EYX) + f"""SELECT entity_name, year, {r('total_revenue')} AS revenue_used,
  {r('total_expenditure')} AS expenditure_used, audit_flag AS flag_used FROM eyx""")
def q_resolve_columns(spark, sf):
    """FEA-11: column fallback resolution (total_revenue -> revenue -> operational_revenue, ...)."""
    from ledgerlens.functions.exprs import resolve_column
    d = fx.entity_year_ext(spark, sf)
    rev = resolve_column(d, FE.REVENUE_CANDIDATES)
    exp = resolve_column(d, FE.EXPENDITURE_CANDIDATES)
    flg = resolve_column(d, FE.FLAG_CANDIDATES)
    return d.select(*KEY, F.col(rev).alias("revenue_used"), F.col(exp).alias("expenditure_used"),
                    F.col(flg).alias("flag_used"))


@register("fea_align_features", with_(EY) + """SELECT entity_name, year, coalesce(cash, 0) AS cash,
  CAST(0 AS DOUBLE) AS missing_feature, coalesce(revenue, 0) AS revenue FROM ey""")
def q_align_features(spark, sf):
    """FEA-13: align to an expected feature list (missing -> 0, null -> 0)."""
    return FE.align_features(fx.entity_year(spark, sf), ["cash", "missing_feature", "revenue"], keep=KEY)


@register("fea_case_table", with_(EYX) + f"""SELECT entity_name AS "Entity Name", year AS "Year",
  CASE WHEN audit_flag = 1 THEN 'Flagged' WHEN audit_flag = 0 THEN 'Normal' END AS "Status",
  CASE WHEN total_revenue IS NULL THEN 'N/A' ELSE {_CUR.replace('x', 'total_revenue')} END AS "Revenue",
  CASE WHEN total_expenditure IS NULL THEN 'N/A' ELSE {_CUR.replace('x', 'total_expenditure')} END AS "Expenditure" FROM eyx""")
def q_case_table(spark, sf):
    """FEA-14: case-table display projection."""
    d = fx.entity_year_ext(spark, sf).select("entity_name", "year", "audit_flag", "total_revenue", "total_expenditure")
    return FE.case_table(d)


# ---- windows -----------------------------------------------------------------

def _lag_sql(c):
    lag = f"lag({c}) OVER (PARTITION BY entity_name ORDER BY year)"
    return (f"{r(lag)} AS {c}_lag1, {r(f'{c} - {lag}')} AS {c}_yoy_change, "
            f"{r(f'CASE WHEN {lag} IS NULL OR {c} IS NULL THEN NULL WHEN {lag} <> 0 THEN ({c} - {lag}) / {lag} '
                 f'WHEN {c} - {lag} <> 0 THEN 0.0 ELSE NULL END')} AS {c}_yoy_pct_change")


@register("win_lag_features", with_(EY) + f"SELECT entity_name, year, {', '.join(_lag_sql(c) for c in OR.LAG_COLUMNS)} FROM ey")
def q_lag_features(spark, sf):
    """WIN-1: lag, change and % change per entity."""
    d = OR.lag_features(fx.entity_year(spark, sf))
    return d.select(*KEY, *[f"{c}_{s}" for c in OR.LAG_COLUMNS for s in ("lag1", "yoy_change", "yoy_pct_change")])


@register("win_volatility", with_(EY) + f""", p AS (SELECT entity_name, year,
  CASE WHEN lag(revenue) OVER w IS NULL THEN NULL WHEN lag(revenue) OVER w <> 0 THEN (revenue - lag(revenue) OVER w) / lag(revenue) OVER w
    WHEN revenue - lag(revenue) OVER w <> 0 THEN 0.0 END AS pct FROM ey WINDOW w AS (PARTITION BY entity_name ORDER BY year))
SELECT entity_name, year, {r('stddev_samp(pct) OVER (PARTITION BY entity_name)')} AS revenue_yoy_pct_change_volatility FROM p""")
def q_volatility(spark, sf):
    """WIN-2: per-entity volatility of % change."""
    d = OR.volatility(OR.lag_features(fx.entity_year(spark, sf), ["revenue"]))
    return d.select(*KEY, "revenue_yoy_pct_change_volatility")


@register("win_latest_per_entity", with_(EY) + f""", lt AS (SELECT entity_name, max(year) AS y, count(*) AS n FROM ey GROUP BY entity_name)
SELECT e.entity_name, e.year, {r('e.revenue')} AS revenue, {r('e.expenditure')} AS expenditure, e.audit_flag, lt.n AS _rows
FROM ey e JOIN lt ON e.entity_name = lt.entity_name AND e.year = lt.y""")
def q_latest_per_entity(spark, sf):
    """WIN-3: latest record per entity."""
    ey = fx.entity_year(spark, sf).select("entity_name", "year", "revenue", "expenditure", "audit_flag")
    return FE.latest_per_entity(ey)


@register("win_entity_lookup", with_(EY) + f""", lt AS (SELECT entity_name, max(year) AS y FROM ey GROUP BY entity_name)
SELECT e.entity_name, e.year AS latest_year, e.audit_flag, {r('e.revenue')} AS revenue, {r('e.expenditure')} AS expenditure,
  {r('e.total_assets')} AS total_assets, e.entity_type, 'Unknown' AS sector, e.region
FROM ey e JOIN lt ON e.entity_name = lt.entity_name AND e.year = lt.y""")
def q_entity_lookup(spark, sf):
    """WIN-3: entity lookup from the latest record, defaults for missing columns."""
    return FE.entity_lookup(fx.entity_year(spark, sf))


@register("win_latest_vs_previous", with_(EY) + f""", w AS (SELECT entity_name, year, revenue, expenditure,
  row_number() OVER (PARTITION BY entity_name ORDER BY year DESC) AS rn,
  lead(revenue) OVER (PARTITION BY entity_name ORDER BY year DESC) AS pr,
  lead(expenditure) OVER (PARTITION BY entity_name ORDER BY year DESC) AS pe,
  count(*) OVER (PARTITION BY entity_name) AS cnt FROM ey)
SELECT entity_name, year, {r('revenue')} AS revenue, {r('expenditure')} AS expenditure,
  {r('CASE WHEN cnt > 1 THEN (revenue - pr) / (pr + 1e-6) * 100 ELSE 0.0 END')} AS revenue_change_pct,
  {r('CASE WHEN cnt > 1 THEN (expenditure - pe) / (pe + 1e-6) * 100 ELSE 0.0 END')} AS expenditure_change_pct
FROM w WHERE rn = 1""")
def q_latest_vs_previous(spark, sf):
    """WIN-4: latest vs previous % change."""
    return OR.latest_vs_previous(fx.entity_year(spark, sf), ["revenue", "expenditure"])


_Z = ", ".join(
    f"{r(f'CASE WHEN count(*) OVER t > 1 AND stddev_samp({c}) OVER t > 0 THEN ({c} - avg({c}) OVER t) / stddev_samp({c}) OVER t END')} AS {c}_zscore_within_type"
    for c in ("revenue", "expenditure", "total_assets"))


@register("win_zscore_within_type", with_(EY) + f"SELECT entity_name, year, {_Z} FROM ey WINDOW t AS (PARTITION BY entity_type)")
def q_zscore_within_type(spark, sf):
    """WIN-5: z-score within entity type."""
    d = OR.zscore_within_group(fx.entity_year(spark, sf))
    return d.select(*KEY, *[f"{c}_zscore_within_type" for c in ("revenue", "expenditure", "total_assets")])


@register("win_percentile_rank", with_(EY) + f"""SELECT entity_name, year,
  {r('(rank() OVER (ORDER BY round(total_liabilities / total_assets, 2)) - 1 + (count(*) OVER (PARTITION BY round(total_liabilities / total_assets, 2)) + 1) / 2.0) / count(*) OVER ()')} AS debt_percentile,
  {r('(rank() OVER (ORDER BY expenditure) - 1 + (count(*) OVER (PARTITION BY expenditure) + 1) / 2.0) / count(*) OVER ()')} AS expenditure_percentile
FROM ey""")
def q_percentile_rank(spark, sf):
    """WIN-6: average-tie percentile ranks (heavy ties and unique values)."""
    d = fx.entity_year(spark, sf).select(*KEY, "expenditure",
                                         F.round(F.col("total_liabilities") / F.col("total_assets"), 2).alias("debt"))
    d = OR.percentile_rank(OR.percentile_rank(d, "debt"), "expenditure")
    return d.select(*KEY, "debt_percentile", "expenditure_percentile")


from ledgerlens.plans.agg_queries import _RISK_S, _RISK_T  # noqa: E402


def _ranked(spark, sf):
    s = aggs.entity_risk_ranking(fx.entity_year(spark, sf), None, exp_col="expenditure")
    return OR.rank_entities(s, "risk_score").select("entity_name", "risk_score", "risk_rank")


_RANK_SQL = with_(EY, _RISK_T, _RISK_S) + """, rk AS (SELECT entity_name, risk_score,
  rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM s)"""


@register("win_rank_entities", _RANK_SQL + " SELECT entity_name, round(risk_score, 6) AS risk_score, risk_rank FROM rk")
def q_rank_entities(spark, sf):
    """WIN-7: competition rank of every entity by risk score (PFX, no global window)."""
    return _ranked(spark, sf)


@register("win_top10_highest", _RANK_SQL + """ SELECT entity_name, round(risk_score, 6) AS risk_score, risk_rank FROM rk
ORDER BY risk_score DESC, entity_name LIMIT 10""")
def q_top10_highest(spark, sf):
    """WIN-7 / TOP-1: ten highest-risk entities (orderBy + limit = TakeOrderedAndProject)."""
    return OR.top_k(_ranked(spark, sf), 10, F.desc("risk_score"), F.asc("entity_name"))


@register("win_top10_lowest", _RANK_SQL + """ SELECT entity_name, round(risk_score, 6) AS risk_score, risk_rank FROM rk
ORDER BY risk_score ASC, entity_name DESC LIMIT 10""")
def q_top10_lowest(spark, sf):
    """WIN-7 / TOP-1: ten lowest-risk entities."""
    return OR.top_k(_ranked(spark, sf), 10, F.asc("risk_score"), F.desc("entity_name"))


@register("win_operating_margin", with_(EY) + f"""SELECT entity_name, year,
  {r('(revenue - expenditure) / (revenue + 1e-6) * 100')} AS operating_margin_pct FROM ey""")
def q_operating_margin(spark, sf):
    """WIN-8: operating-margin series."""
    return FE.operating_margin_series(fx.entity_year(spark, sf))


@register("win_time_split", with_(EY) + """SELECT entity_name, year,
  CASE WHEN row_number() OVER (ORDER BY year, entity_name) - 1 < floor(count(*) OVER () * CAST(1 - 0.2 AS DOUBLE))
  THEN 'train' ELSE 'test' END AS split FROM ey""")
def q_time_split(spark, sf):
    """WIN-9: time-aware 80/20 split by (year, entity) position."""
    return OR.time_split(fx.entity_year(spark, sf).select(*KEY), 0.2)


@register("win_stratified_split", with_(EY) + """, k AS (SELECT entity_name, year, audit_flag,
  row_number() OVER (PARTITION BY audit_flag ORDER BY md5(entity_name || '|' || year || '|42'), entity_name, year) AS place,
  floor(count(*) OVER (PARTITION BY audit_flag) * 0.2::DOUBLE + 0.5) AS quota FROM ey)
SELECT entity_name, year, audit_flag, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split FROM k""")
def q_stratified_split(spark, sf):
    """WIN-10: hash-stratified split (no year column), exactly the asked share of every class."""
    d = fx.entity_year(spark, sf).select(*KEY, "audit_flag")
    return OR.stratified_split(d, "audit_flag", 0.2).select(*KEY, "audit_flag", "split")


@register("top_years_per_entity", with_(EY) + f"""SELECT entity_name, year, {r('expenditure')} AS expenditure, rank FROM (
  SELECT entity_name, year, expenditure, row_number() OVER (PARTITION BY entity_name ORDER BY expenditure DESC, year) AS rank
  FROM ey) z WHERE rank <= 3""")
def q_top_years_per_entity(spark, sf):
    """TOP-2: three highest-expenditure years per entity."""
    d = fx.entity_year(spark, sf).select(*KEY, "expenditure")
    return OR.top_k_per_group(d, 3, ["entity_name"], F.desc("expenditure"), F.asc("year"))


@register("set_years_per_entity", with_(EY) + """SELECT entity_name,
  array_to_string(list_sort(list_distinct(list(year))), ',') AS years FROM ey GROUP BY entity_name""")
def q_set_years_per_entity(spark, sf):
    """SET-1: sorted distinct set per group."""
    d = OR.distinct_sorted_set(fx.entity_year(spark, sf), ["entity_name"], "year", "ys")
    return d.select("entity_name", F.array_join("ys", ",").alias("years"))
