"""Feature projections (FEA-*): narrow, codegen-able column expressions.

Every builder is schema-conditional like the reference: a feature is added
only when its source columns exist (decided from ``df.columns``, no job).
Ratios use the reference's ``/(d + 1e-6)`` guard through ``try_divide`` so a
denominator of exactly -1e-6 yields NULL instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import eps_div, flag, resolve_column

REVENUE_CANDIDATES = ["total_revenue", "revenue", "operational_revenue"]
EXPENDITURE_CANDIDATES = ["total_expenditure", "expenditure"]
FLAG_CANDIDATES = ["audit_flag", "dependet_variable", "dependent_variable", "target", "flag"]


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def financial_ratios(df: DataFrame) -> DataFrame:
    """FEA-1: liquidity, leverage, efficiency, size and equity ratios."""
    new = {}
    if _has(df, "cash", "total_liabilities"):
        new["cash_ratio"] = eps_div("cash", "total_liabilities")
    if _has(df, "total_assets", "total_liabilities"):
        new["current_ratio"] = eps_div("total_assets", "total_liabilities")
        new["debt_ratio"] = eps_div("total_liabilities", "total_assets")
    if _has(df, "revenue", "total_assets"):
        new["asset_turnover"] = eps_div("revenue", "total_assets")
    if _has(df, "revenue", "expenditure"):
        new["expense_ratio"] = eps_div("expenditure", "revenue")
        new["operating_margin"] = eps_div(F.col("revenue") - F.col("expenditure"), "revenue")
    if _has(df, "total_assets"):
        new["log_total_assets"] = F.log1p("total_assets")
    if _has(df, "revenue"):
        new["log_revenue"] = F.log1p("revenue")
    if _has(df, "equity", "total_assets"):
        new["equity_ratio"] = eps_div("equity", "total_assets")
    return df.withColumns(new) if new else df


def procurement_indicators(df: DataFrame) -> DataFrame:
    """FEA-2: single-source share, average contract value, contract ratios."""
    new = {}
    if _has(df, "contract_count", "single_source_contracts"):
        new["single_source_ratio"] = eps_div("single_source_contracts", "contract_count")
    if _has(df, "contract_value", "contract_count"):
        new["avg_contract_value"] = eps_div("contract_value", "contract_count")
    if _has(df, "contract_value", "total_assets"):
        new["contract_to_assets_ratio"] = eps_div("contract_value", "total_assets")
    if _has(df, "contract_value", "expenditure"):
        new["contract_to_expenditure_ratio"] = eps_div("contract_value", "expenditure")
    return df.withColumns(new) if new else df


def temporal_flags(df: DataFrame, base: int = 2020, recent: int = 2022) -> DataFrame:
    """FEA-3: years since ``base`` and recent-year flag."""
    if "year" not in df.columns:
        return df
    return df.withColumns({f"years_since_{base}": F.col("year") - base,
                           "is_recent_year": flag(F.col("year") >= recent)})


def payroll_features(df: DataFrame) -> DataFrame:
    """FEA-4: per-employee revenue/expenditure/payroll and payroll share."""
    new = {}
    if _has(df, "revenue", "employee_count"):
        new["revenue_per_employee"] = eps_div("revenue", "employee_count")
    if _has(df, "expenditure", "employee_count"):
        new["expenditure_per_employee"] = eps_div("expenditure", "employee_count")
    if _has(df, "payroll_expense", "employee_count"):
        new["avg_salary"] = eps_div("payroll_expense", "employee_count")
    if _has(df, "payroll_expense", "expenditure"):
        new["payroll_to_expenditure_ratio"] = eps_div("payroll_expense", "expenditure")
    return df.withColumns(new) if new else df


def risk_flags(df: DataFrame) -> DataFrame:
    """FEA-5/6: threshold flags, then composite = sum of every ``*_risk``
    column present (computed before ``size_risk`` exists)."""
    new = {}
    if "debt_ratio" in df.columns:
        new["high_debt_risk"] = flag(F.col("debt_ratio") > 0.8)
    if "expense_ratio" in df.columns:
        new["overspending_risk"] = flag(F.col("expense_ratio") > 1.0)
    if "single_source_ratio" in df.columns:
        new["procurement_risk"] = flag(F.col("single_source_ratio") > 0.5)
    out = df.withColumns(new) if new else df
    risk_cols = [c for c in out.columns if c.endswith("_risk")]
    if risk_cols:
        total = F.lit(0)
        for c in risk_cols:
            total = total + F.coalesce(F.col(c), F.lit(0))
        out = out.withColumn("composite_risk_score", total)
    return out


def size_risk(df: DataFrame, lo: float = 0.1, hi: float = 0.9, col: str = "total_assets") -> DataFrame:
    """FEA-7: size risk when assets are below P10 or above P90 (exact linear
    percentiles from PFX order statistics, inlined as literals)."""
    if col not in df.columns:
        return df
    from ledgerlens.operators.ordered import exact_quantiles
    q = exact_quantiles(df, col, [lo, hi])
    c = F.col(col)
    if q[0] is None:
        return df.withColumn("size_risk", F.lit(0))
    return df.withColumn("size_risk", flag((c < q[0]) | (c > q[1])))


def interactions(df: DataFrame) -> DataFrame:
    """FEA-8: size x performance, risk x size, efficiency x scale."""
    new = {}
    if _has(df, "log_total_assets", "operating_margin"):
        new["size_performance_interaction"] = F.col("log_total_assets") * F.col("operating_margin")
    if _has(df, "composite_risk_score", "log_total_assets"):
        new["risk_size_interaction"] = F.col("composite_risk_score") * F.col("log_total_assets")
    if _has(df, "asset_turnover", "log_revenue"):
        new["efficiency_scale_interaction"] = F.col("asset_turnover") * F.col("log_revenue")
    return df.withColumns(new) if new else df


def latest_per_entity(df: DataFrame, entity: str = "entity_name", order: str = "year",
                      tie: list[str] | None = None) -> DataFrame:
    """WIN-3 core: the latest row per entity (largest ``order``, then the
    largest tie-break columns).  ``max_by`` is a partial aggregate, so a hot
    entity is reduced map-side instead of landing whole in one task."""
    cols = [c for c in df.columns if c != entity]
    key = F.struct(F.col(order), *[F.col(t) for t in (tie or [])])
    g = df.groupBy(entity).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_l"),
                               F.count(F.lit(1)).alias("_rows"))
    return g.select(entity, "_rows", *[F.col(f"_l.{c}").alias(c) for c in cols])


def profile_kpis(df: DataFrame, entity: str = "entity_name", tie: list[str] | None = None) -> DataFrame:
    """FEA-9: KPIs from each entity's latest row, for all entities in one job;
    years active = number of rows, flag rate = mean flag over the history."""
    rev = resolve_column(df, REVENUE_CANDIDATES)
    exp = resolve_column(df, EXPENDITURE_CANDIDATES)
    flg = resolve_column(df, FLAG_CANDIDATES)
    rate = (df.groupBy(entity).agg(F.avg(F.col(flg).cast("double")).alias("audit_flag_rate"))
            if flg else None)
    latest = latest_per_entity(df, entity, tie=tie)
    k = {}
    if _has(df, "current_assets", "current_liabilities"):
        k["current_ratio"] = eps_div("current_assets", "current_liabilities")
    if rev and "total_assets" in df.columns:
        k["asset_turnover"] = eps_div(rev, "total_assets")
    if rev and exp:
        k["expense_ratio"] = eps_div(exp, rev)
    if "net_profit" in df.columns and rev:
        k["profit_margin"] = eps_div("net_profit", rev)
    if _has(df, "net_profit", "total_assets"):
        k["roa"] = eps_div("net_profit", "total_assets")
    if _has(df, "total_liabilities", "total_assets"):
        k["debt_ratio"] = eps_div("total_liabilities", "total_assets")
    eq = resolve_column(df, ["net_assets", "netassets", "equity"])
    if "total_liabilities" in df.columns and eq:
        k["debt_to_equity"] = eps_div("total_liabilities", eq)
    out = latest.select(entity, F.col("year").alias("latest_year"), *[v.alias(n) for n, v in k.items()],
                        F.col("_rows").alias("years_active"))
    if rate is not None:
        out = out.join(rate, entity)
    else:
        out = out.withColumn("audit_flag_rate", F.lit(0.0))
    return out


def kpi_health(kpis: DataFrame) -> DataFrame:
    """FEA-10: health labels for the profile KPIs."""
    new = {}
    c = kpis.columns
    if "current_ratio" in c:
        new["current_ratio_status"] = F.when(F.col("current_ratio").between(1, 3), "Healthy").otherwise("Review")
    if "debt_ratio" in c:
        new["debt_ratio_status"] = F.when(F.col("debt_ratio") <= 0.6, "Good").otherwise("High")
    if "profit_margin" in c:
        new["profit_margin_status"] = F.when(F.col("profit_margin") > 0, "Profitable").otherwise("Loss")
    if "asset_turnover" in c:
        new["asset_turnover_status"] = F.when(F.col("asset_turnover") > 0.5, "Efficient").otherwise("Low")
    if "expense_ratio" in c:
        new["expense_ratio_status"] = F.when(F.col("expense_ratio") < 0.9, "Controlled").otherwise("High")
    return kpis.withColumns(new) if new else kpis


def feature_target_split(df: DataFrame, target: str = "audit_flag",
                         exclude_prefixes: tuple[str, ...] = ("severity", "detected_issues", "irregularity_score",
                                                               "evidence_count")) -> list[str]:
    """FEA-12: numeric feature columns minus id, label and every label-derived
    column (prefix match closes the reference's leakage, quirk Q7)."""
    from ledgerlens.functions.exprs import numeric_columns
    from ledgerlens.functions.rules import LABEL_COLUMNS
    ex = set(LABEL_COLUMNS) | {target, "entity_id"}
    return [c for c in numeric_columns(df) if c not in ex and not c.startswith(exclude_prefixes)]


def align_features(df: DataFrame, expected: list[str], keep: list[str] | None = None) -> DataFrame:
    """FEA-13: expected features in order; missing ones become 0, nulls 0."""
    have = set(df.columns)
    cols = [F.col(k) for k in (keep or [])]
    cols += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
             for c in expected]
    return df.select(*cols)


def case_table(df: DataFrame, currency: str = "GHS") -> DataFrame:
    """FEA-14: case-table display projection (schema-conditional): flag as
    Normal / Flagged, revenue and expenditure as currency text ('N/A' when
    missing), display names, newest year first."""
    from ledgerlens.functions.exprs import format_currency
    c = df.columns
    cols = [F.col("entity_name").alias("Entity Name")]
    if "year" in c:
        cols.append(F.col("year").alias("Year"))
    if "audit_flag" in c:
        cols.append(F.when(F.col("audit_flag") == 1, "Flagged").when(F.col("audit_flag") == 0, "Normal")
                    .alias("Status"))
    for src, name in (("total_revenue", "Revenue"), ("total_expenditure", "Expenditure")):
        if src in c:
            cols.append(F.when(F.col(src).isNull(), F.lit("N/A")).otherwise(format_currency(src, currency)).alias(name))
    for src, name in (("severity", "Severity"), ("detected_issues", "Detected Issues")):
        if src in c:
            cols.append(F.col(src).alias(name))
    out = df.select(*cols)
    return out.orderBy(F.desc("Year"), F.asc("Entity Name")) if "year" in c else out


def operating_margin_series(df: DataFrame, entity: str = "entity_name") -> DataFrame:
    """WIN-8: (rev - exp) / (rev + 1e-6) * 100 per entity-year, year ordered."""
    rev = resolve_column(df, REVENUE_CANDIDATES)
    exp = resolve_column(df, EXPENDITURE_CANDIDATES)
    return (df.select(entity, "year", (eps_div(F.col(rev) - F.col(exp), rev) * 100).alias("operating_margin_pct"))
            .orderBy(entity, "year"))


LOOKUP_FIELDS = [("year", "latest_year", "Unknown"), ("audit_flag", "audit_flag", 0), ("revenue", "revenue", 0),
                 ("expenditure", "expenditure", 0), ("total_assets", "total_assets", 0),
                 ("entity_type", "entity_type", "Unknown"), ("sector", "sector", "Unknown"),
                 ("region", "region", "Unknown")]


def entity_lookup(df: DataFrame, entity: str = "entity_name", tie: list[str] | None = None) -> DataFrame:
    """WIN-3: per entity its latest record's fields, with the reference's
    defaults for missing columns (0 for numbers, 'Unknown' for text)."""
    have = [src for src, _, _ in LOOKUP_FIELDS if src in df.columns]
    latest = latest_per_entity(df.select(entity, *dict.fromkeys(have + ["year"] if "year" in df.columns else have)),
                               entity, tie=tie)
    cols = [F.col(entity)]
    for src, out, default in LOOKUP_FIELDS:
        if src in df.columns:
            cols.append(F.col(src).alias(out))
        else:
            cols.append(F.lit(default).alias(out))
    return latest.select(*cols)
