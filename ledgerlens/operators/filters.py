"""Filters and predicates (FLT-*).  All are Catalyst predicates, so they reach
the parquet scan as pushed filters (and partition filters when the table is
written ``partitionBy('year')``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.exprs import classify_by_keywords

ENTITY = "entity_name"


def year_range(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """FLT-1: inclusive year range."""
    return df.filter(F.col("year").between(lo, hi))


def flag_selector(df: DataFrame, choice: str = "All", flag_col: str = "audit_flag") -> DataFrame:
    """FLT-2: All / Flagged / Normal."""
    if choice == "Flagged":
        return df.filter(F.col(flag_col) == 1)
    if choice == "Normal":
        return df.filter(F.col(flag_col) == 0)
    return df


def severity_equals(df: DataFrame, severity: str | None) -> DataFrame:
    """FLT-3: severity equality (None / 'All' keeps everything)."""
    if severity in (None, "All"):
        return df
    return df.filter(F.col("severity") == severity)


def with_inferred_type(df: DataFrame, rule_set: str = "dashboard", out: str = "inferred_type") -> DataFrame:
    """FN-6 as a column: entity type from name keywords (three rule sets)."""
    table = {
        "dashboard": (rules.ENTITY_TYPE_RULES_DASHBOARD, rules.ENTITY_TYPE_DEFAULT_DASHBOARD),
        "cases": (rules.ENTITY_TYPE_RULES_CASES, rules.ENTITY_TYPE_DEFAULT_CASES),
        "profile": (rules.ENTITY_TYPE_RULES_PROFILE, rules.ENTITY_TYPE_DEFAULT_PROFILE),
    }[rule_set]
    return df.withColumn(out, classify_by_keywords(ENTITY, *table))


def inferred_type_in(df: DataFrame, types: Sequence[str] | str | None, rule_set: str = "dashboard") -> DataFrame:
    """FLT-4: keep rows whose inferred type is selected (empty/None keeps all)."""
    if not types or types == "All":
        return df
    if isinstance(types, str):
        types = [types]
    t = with_inferred_type(df, rule_set, "_t")
    return t.filter(F.col("_t").isin(list(types))).drop("_t")


def min_expenditure(df: DataFrame, minimum: float | None = None, maximum: float | None = None,
                    exp_col: str = "total_expenditure") -> DataFrame:
    """FLT-5: minimum or range of expenditure."""
    c = F.col(exp_col)
    if minimum is not None and maximum is not None:
        return df.filter(c.between(minimum, maximum))
    if minimum is not None:
        return df.filter(c >= minimum)
    if maximum is not None:
        return df.filter(c <= maximum)
    return df


def name_search(df: DataFrame, query: str | None, regex: bool = False) -> DataFrame:
    """FLT-6: case-insensitive name search (literal by default)."""
    if not query:
        return df
    if regex:
        return df.filter(F.col(ENTITY).rlike("(?i)" + query))
    return df.filter(F.lower(ENTITY).contains(query.lower()))


def category_overlap(df: DataFrame, selected: Sequence[str], col: str = "irregularity_categories") -> DataFrame:
    """FLT-7: any selected category in the array cell."""
    if not selected:
        return df
    return df.filter(F.coalesce(F.arrays_overlap(F.col(col), F.array(*[F.lit(s) for s in selected])), F.lit(False)))


def risk_focus(df: DataFrame, focus: str = "All", flag_col: str = "audit_flag") -> DataFrame:
    """FLT-8: High = flagged rows; Low = unflagged rows; Medium = rows of
    entities whose mean flag is strictly between 0 and 0.5 (aggregate, then a
    left-semi join: no per-entity Python, no driver round trip)."""
    if focus == "High":
        return df.filter(F.col(flag_col) == 1)
    if focus == "Low":
        return df.filter(F.col(flag_col) == 0)
    if focus == "Medium":
        med = (df.groupBy(ENTITY).agg(F.avg(F.col(flag_col).cast("double")).alias("m"))
               .filter((F.col("m") > 0) & (F.col("m") < 0.5)).select(ENTITY))
        return df.join(med, ENTITY, "left_semi")
    return df


def quick_filter(df: DataFrame, which: str, current_year: int | None = None) -> DataFrame:
    """FLT-9: 'high_score' = irregularity_score > .6; 'recent' = year >= now-2."""
    if which == "high_score":
        return df.filter(F.col("irregularity_score") > 0.6)
    if which == "recent":
        return df.filter(F.col("year") >= current_year - 2)
    return df


def entity_lookup(df: DataFrame, name: str) -> DataFrame:
    """FLT-10: exact name match, else case-insensitive partial match.

    One pass: the existence of an exact match is an EXISTS subquery (a
    single boolean computed once), so the partial tier is kept only when the
    exact tier is empty -- no cross join, no driver decision.
    """
    exact = F.col(ENTITY) == F.lit(name)
    has_exact = df.filter(exact).exists()
    partial = F.lower(ENTITY).contains(name.lower())
    return df.filter(exact | (~has_exact & partial))


def entity_history(df: DataFrame, name: str) -> DataFrame:
    """FLT-11: one entity's rows ordered by year."""
    return df.filter(F.col(ENTITY) == name).orderBy("year")


def page(df: DataFrame, order: Sequence, page_no: int, page_size: int) -> DataFrame:
    """FLT-12: page ``page_no`` (0-based) of rows in ``order`` (which must end
    in a unique key).  offset+limit runs as a top-(offset+limit) per partition."""
    return df.orderBy(*order).offset(page_no * page_size).limit(page_size)
