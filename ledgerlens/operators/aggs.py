"""Aggregations behind the dashboard, case viewer and report pages (AGG-*).

Every operator is one Spark aggregation (partial + final, map-side combined)
or a two-level aggregation; whole-table maxima/totals enter as scalar
subqueries (``DataFrame.scalar()``), which Spark evaluates once as a 1-row
job and inlines as a literal -- no cross join, no un-partitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.exprs import classify_by_keywords, col_, safe_div

ENTITY = "entity_name"
MAX_YEARS = 1000


def distinct_years(df: DataFrame, year: str = "year") -> list[int]:
    """Sorted distinct years, for a pivot or a split; a column with more than
    ``MAX_YEARS`` values is no calendar year and raises."""
    rows = df.select(year).filter(F.col(year).isNotNull()).distinct().limit(MAX_YEARS + 1).collect()
    if len(rows) > MAX_YEARS:
        raise ValueError(f"column {year} has more than {MAX_YEARS} years")
    return sorted(r[0] for r in rows)


def kpi_metrics(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-1: one KPI row (distinct entities, flagged entities and share, 5%
    of flagged expenditure, mean flag, repeat offenders, expenditure totals).

    Repeat offenders (>= 2 flagged rows) need a second level: per-entity
    flagged counts first, then a count over them, joined as a 1-row scalar.
    """
    flagged = F.col(flag_col) == 1
    per_entity = (df.filter(flagged & F.col(ENTITY).isNotNull()).groupBy(ENTITY)
                  .agg(F.count(F.lit(1)).alias("n_flagged")))
    repeat = per_entity.agg(F.count(F.when(F.col("n_flagged") >= 2, 1)).alias("c")).scalar()
    base = df.agg(
        F.count_distinct(ENTITY).alias("total_entities"),
        F.count_distinct(F.when(flagged, F.col(ENTITY))).alias("flagged_entities"),
        (F.coalesce(F.sum(F.when(flagged, F.col(exp_col))), F.lit(0.0)) * 0.05).alias("total_irregularity_amount"),
        F.avg(F.col(flag_col).cast("double")).alias("avg_risk_score"),
        F.coalesce(F.sum(exp_col), F.lit(0.0)).alias("total_expenditure"),
    )
    return base.select(
        "total_entities", "flagged_entities",
        F.coalesce(safe_div(F.col("flagged_entities") * 100, "total_entities"), F.lit(0.0)).alias("flagged_percentage"),
        "total_irregularity_amount", "avg_risk_score",
        repeat.alias("high_risk_entities"),
        "total_expenditure",
        F.coalesce(safe_div("total_expenditure", "total_entities"), F.lit(0.0)).alias("avg_expenditure_per_entity"),
    )


def yearly_trend(df: DataFrame, flag_col: str = "audit_flag") -> DataFrame:
    """AGG-2: per year flags, records, distinct entities, flagged/distinct*100."""
    g = (df.filter(F.col("year").isNotNull()).groupBy("year")
         .agg(F.sum(flag_col).alias("flagged_count"), F.count(flag_col).alias("total_records"),
              F.count_distinct(ENTITY).alias("unique_entities")))
    return g.withColumn("flagged_percentage", safe_div(F.col("flagged_count") * 100, "unique_entities"))


def entity_risk_table(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-3: per entity ever/total flags, records, expenditure sum/mean, years."""
    return (df.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY).agg(
        F.max(flag_col).alias("ever_flagged"),
        F.sum(flag_col).alias("total_flags"),
        F.count(flag_col).alias("total_records"),
        F.coalesce(F.sum(exp_col), F.lit(0.0)).alias("total_expenditure"),
        F.avg(exp_col).alias("avg_expenditure"),
        F.count("year").alias("record_count"),
        F.count_distinct("year").alias("years_active"),
    ))


def entity_risk_ranking(df: DataFrame, top_n: int | None = 20, exp_col: str = "total_expenditure",
                        flag_col: str = "audit_flag") -> DataFrame:
    """AGG-4 (flagship): entity risk score and level, top N.

    score = 3*ever + 2*flags/records + exp/max(exp) + .5*years/max(years).
    The two maxima are scalar subqueries over the per-entity table; Spark
    reuses the per-entity aggregation's exchange for them.  The top-N is a
    TakeOrderedAndProject (per-partition top-N, then a merge of N*P rows).
    """
    t = entity_risk_table(df, exp_col, flag_col)
    mx = t.agg(F.max("total_expenditure").alias("m"))
    my = t.agg(F.max("years_active").alias("m"))
    max_exp = F.when(mx.scalar() > 0, mx.scalar()).otherwise(F.lit(1.0))
    max_years = F.when(my.scalar() > 0, my.scalar()).otherwise(F.lit(1))
    score = (F.col("ever_flagged") * 3.0
             + F.col("total_flags") / F.col("total_records") * 2.0
             + F.col("total_expenditure") / max_exp * 1.0
             + F.col("years_active") / max_years * 0.5)
    s = t.withColumn("risk_score", score)
    level = (F.when(F.col("ever_flagged") == 1,
                    F.when(F.col("risk_score") >= 4.0, "Critical").when(F.col("risk_score") >= 3.0, "High")
                    .otherwise("Medium"))
             .otherwise(F.when(F.col("risk_score") >= 2.0, "Medium").when(F.col("risk_score") >= 1.0, "Low")
                        .otherwise("Very Low")))
    s = s.withColumn("risk_level", level)
    if top_n is None:
        return s
    return s.orderBy(F.desc("ever_flagged"), F.desc("risk_score"), F.asc(ENTITY)).limit(top_n)


def issue_type_counts(df: DataFrame, issues_col: str = "detected_issues",
                      type_rules: Sequence = rules.ISSUE_TYPE_RULES) -> DataFrame:
    """AGG-5: explode the comma list, first-matching type per issue, counted;
    always one row per type (types with no hit count 0)."""
    issues = (df.select(F.explode(F.split(F.col(issues_col), ",")).alias("issue"))
              .select(F.lower(F.trim("issue")).alias("issue")))
    typed = issues.select(classify_by_keywords(F.col("issue"), type_rules, None).alias("issue_type"))
    counts = typed.filter(F.col("issue_type").isNotNull()).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    types = spark.createDataFrame([(t,) for t, _ in type_rules], "issue_type string")
    return (types.join(F.broadcast(counts), "issue_type", "left")
            .select("issue_type", F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def intensity_matrix(df: DataFrame, years: Sequence[int] | None = None, top_n: int = 20, exp_col: str = "total_expenditure",
                     flag_col: str | None = "audit_flag") -> DataFrame:
    """AGG-6 / AGG-7: per entity-year intensity (flags/records, or log1p of
    expenditure when there is no flag column) pivoted over ``years``; only
    the top-N entities by total flags (or expenditure).  Without ``years``,
    every year of the data becomes a column."""
    years = distinct_years(df) if years is None else years
    if flag_col is not None:
        ey = (df.groupBy(ENTITY, "year").agg(F.sum(flag_col).alias("flags"), F.count(flag_col).alias("records"))
              .withColumn("value", F.col("flags") / F.col("records")))
        rank_by = "flags"
    else:
        ey = (df.groupBy(ENTITY, "year").agg(F.sum(exp_col).alias("expenditure"))
              .withColumn("value", F.log1p("expenditure")))
        rank_by = "expenditure"
    top = (ey.groupBy(ENTITY).agg(F.sum(rank_by).alias("tot"))
           .orderBy(F.desc("tot"), F.asc(ENTITY)).limit(top_n))
    # top has at most top_n rows: a bounded broadcast.
    sel = ey.join(F.broadcast(top.select(ENTITY, "tot")), ENTITY)
    piv = sel.groupBy(ENTITY, "tot").pivot("year", list(years)).agg(F.first("value"))
    return piv.na.fill(0.0).select(ENTITY, "tot", *[F.col(str(y)).alias(f"y{y}") for y in years])


def type_flag_contingency(df: DataFrame, type_col: str = "inferred_type", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-8: type x flag counts, both flag values always present."""
    return (df.groupBy(type_col).pivot(flag_col, [0, 1]).count().na.fill(0)
            .select(type_col, F.col("0").alias("normal"), F.col("1").alias("flagged")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-9: counts and share of each value (share by the 1-row total)."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share", F.col("count") / total))


def year_coverage(df: DataFrame, current_year: int) -> DataFrame:
    """AGG-10: min/max/distinct years and a freshness label from ``current_year``."""
    g = df.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"),
               F.count_distinct("year").alias("years_covered"))
    age = F.lit(current_year) - F.col("max_year")
    return g.withColumn("data_age", age).withColumn(
        "freshness", F.when(age <= 1, "Current").when(age <= 2, "Recent").otherwise("Outdated"))


def missing_report(df: DataFrame, top_n: int | None = 10) -> DataFrame:
    """AGG-11: missing % per column (one aggregation for all columns, then
    unpivoted), columns with any missing value, descending."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in cols])
    long = agg.unpivot("__n", cols, "column_name", "missing").select(
        "column_name", F.col("missing").cast("long").alias("missing"),
        (F.col("missing") / F.col("__n") * 100).alias("missing_pct"))
    long = long.filter(F.col("missing") > 0).orderBy(F.desc("missing_pct"), F.asc("column_name"))
    return long.limit(top_n) if top_n else long


def completeness(df: DataFrame) -> DataFrame:
    """AGG-11: overall completeness % and grade (95 / 85)."""
    cols = df.columns
    missing = sum((F.count(F.lit(1)) - F.count(F.col(c)) for c in cols), F.lit(0))
    g = df.agg(F.count(F.lit(1)).alias("total_records"), missing.alias("missing_cells"))
    comp = (F.lit(1.0) - F.col("missing_cells") / (F.col("total_records") * len(cols))) * 100
    g = g.withColumn("completeness", comp).withColumn("total_features", F.lit(len(cols)))
    return g.withColumn("grade", F.when(F.col("completeness") >= 95, "Excellent")
                        .when(F.col("completeness") >= 85, "Good").otherwise("Needs Improvement"))


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """AGG-12: count, mean, std, min, quartiles (exact linear, from PFX order
    statistics), max, and the count above Q3 + 1.5 IQR."""
    from ledgerlens.operators.ordered import exact_quantiles
    q25, q50, q75 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    thr = (q75 + 1.5 * (q75 - q25)) if q25 is not None else None
    return df.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).alias("min"), F.lit(q25).cast("double").alias("q25"),
                  F.lit(q50).cast("double").alias("median"), F.lit(q75).cast("double").alias("q75"),
                  F.max(col).alias("max"),
                  F.count(F.when(F.col(col) > F.lit(thr), 1)).alias("outliers"))


def entity_flag_rate_stats(df: DataFrame, flag_col: str = "audit_flag") -> DataFrame:
    """AGG-13: per-entity flag rates, then mean, max, arg-max (lowest name on
    ties) and the >.5 / (.2,.5] / <=.2 bucket counts."""
    per = (df.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY)
           .agg(F.avg(F.col(flag_col).cast("double")).alias("flag_rate")))
    return per.agg(
        F.avg("flag_rate").alias("avg_flag_rate"), F.max("flag_rate").alias("max_flag_rate"),
        F.min_by(ENTITY, F.struct(-F.col("flag_rate"), F.col(ENTITY))).alias("highest_risk_entity"),
        F.count(F.when(F.col("flag_rate") > 0.5, 1)).alias("high_risk"),
        F.count(F.when((F.col("flag_rate") > 0.2) & (F.col("flag_rate") <= 0.5), 1)).alias("medium_risk"),
        F.count(F.when(F.col("flag_rate") <= 0.2, 1)).alias("low_risk"),
    )


def entity_severity(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-14: per-entity severity from (flag rate, flags)."""
    per = (df.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY).agg(
        F.sum(flag_col).alias("total_flags"), F.count(flag_col).alias("total_records"),
        F.avg(F.col(flag_col).cast("double")).alias("flag_rate"), F.sum(exp_col).alias("total_expenditure")))
    r, n = F.col("flag_rate"), F.col("total_flags")
    sev = (F.when((r >= 0.7) & (n >= 3), "Critical").when((r >= 0.4) & (n >= 2), "High")
           .when((r >= 0.2) | (n >= 1), "Medium").otherwise("Low"))
    return per.withColumn("severity", sev)


def severity_distribution(df: DataFrame, **kw) -> DataFrame:
    """AGG-14: count and share of entities per severity level."""
    s = entity_severity(df, **kw)
    total = s.agg(F.count(F.lit(1)).alias("n")).scalar()
    return s.groupBy("severity").agg(F.count(F.lit(1)).alias("count")).withColumn("pct", F.col("count") / total * 100)


def top_critical(df: DataFrame, n: int = 5, **kw) -> DataFrame:
    """AGG-14: top-N critical entities by flag rate."""
    s = entity_severity(df, **kw).filter(F.col("severity") == "Critical")
    return s.orderBy(F.desc("flag_rate"), F.asc(ENTITY)).limit(n)


def risk_trend(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-15: last-year vs first-year mean flag; risk exposure = flagged / total expenditure."""
    yearly = df.filter(F.col("year").isNotNull()).groupBy("year").agg(
        (F.avg(F.col(flag_col).cast("double")) * 100).alias("rate"))
    trend = yearly.agg(F.max_by("rate", "year").alias("last_rate"), F.min_by("rate", "year").alias("first_rate"),
                       F.count(F.lit(1)).alias("n_years"))
    tot = df.agg(F.sum(exp_col).alias("total_exp"),
                 F.sum(F.when(F.col(flag_col) == 1, F.col(exp_col))).alias("flagged_exp"))
    t = trend.select("last_rate", "first_rate", "n_years",
                     F.when(F.col("n_years") <= 1, F.lit(None))
                     .when(F.col("last_rate") > F.col("first_rate"), "Increasing").otherwise("Decreasing").alias("trend"))
    return t.select("*", tot.select("total_exp").scalar().alias("total_expenditure"),
                    F.coalesce(tot.select("flagged_exp").scalar(), F.lit(0.0)).alias("at_risk_expenditure"),
                    F.when(tot.select("total_exp").scalar() > 0,
                           F.coalesce(tot.select("flagged_exp").scalar(), F.lit(0.0)) / tot.select("total_exp").scalar() * 100)
                    .alias("risk_exposure"))


def case_summary(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-16: rows, flags, expenditure sum, flag rate %."""
    g = df.agg(F.count(F.lit(1)).alias("total_cases"), F.coalesce(F.sum(flag_col), F.lit(0)).alias("flagged_cases"),
               F.coalesce(F.sum(exp_col), F.lit(0.0)).alias("total_expenditure"))
    return g.withColumn("flag_rate", F.coalesce(safe_div(F.col("flagged_cases") * 100, "total_cases"), F.lit(0.0)))


def case_trend(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-17: by year count, flagged, expenditure."""
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("count"), F.sum(flag_col).alias("flagged"),
                                  F.sum(exp_col).alias("expenditure"))


def year_over_year(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-18: by year count/sum/mean flag, expenditure sum/mean, rounded to 2."""
    return df.groupBy("year").agg(
        F.count(flag_col).alias("flag_count"), F.sum(flag_col).alias("flag_sum"),
        F.round(F.avg(F.col(flag_col).cast("double")), 2).alias("flag_mean"),
        F.round(F.sum(exp_col), 2).alias("expenditure_sum"), F.round(F.avg(exp_col), 2).alias("expenditure_mean"))


def findings_summary(df: DataFrame, flag_col: str = "audit_flag") -> DataFrame:
    """AGG-19: flagged rows, high-severity rows, evidence total, rows with
    issues, keyword match rate (rows with issues / rows), distinct entities,
    and the most common severity (title-cased, lowest on ties)."""
    g = df.agg(
        F.coalesce(F.sum(flag_col), F.lit(0)).alias("flagged"),
        F.count(F.when(F.col("severity") == "high", 1)).alias("high_severity"),
        F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_total"),
        F.count("detected_issues").alias("entities_with_issues"),
        F.coalesce(F.try_divide(F.count("detected_issues") * 100.0, F.count(F.lit(1))), F.lit(0.0))
        .alias("keyword_match_rate"),
        F.count_distinct(ENTITY).alias("unique_entities"),
    )
    from ledgerlens.functions.exprs import title_case
    from ledgerlens.operators.ordered import mode_value
    return g.withColumn("modal_severity", title_case(F.lit(mode_value(df, "severity")).cast("string")))


def issue_categories(df: DataFrame, issues_col: str = "detected_issues") -> DataFrame:
    """AGG-20: 8-way first-match category per row with issues, counted."""
    cat = classify_by_keywords(F.col(issues_col), rules.ISSUE_CATEGORY_RULES, rules.ISSUE_CATEGORY_DEFAULT)
    return (df.filter(F.col(issues_col).isNotNull()).select(cat.alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("count")))


def findings_table(df: DataFrame, flag_col: str = "audit_flag", width: int = 100) -> DataFrame:
    """AGG-21: flagged rows, issue text cut to ``width`` (with '...'), ordered
    by severity rank then score, both descending (unique tie-break)."""
    rank = (F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2)
            .when(F.col("severity") == "low", 1).otherwise(0))
    txt = F.col("detected_issues")
    short = F.when(F.length(txt) > width, F.concat(F.substring(txt, 1, width), F.lit("..."))).otherwise(txt)
    f = df.filter(F.col(flag_col) == 1).select(ENTITY, "year", "severity", "irregularity_score",
                                                 "evidence_count", short.alias("issues"), rank.alias("severity_rank"))
    return f.orderBy(F.desc("severity_rank"), F.desc("irregularity_score"), F.asc(ENTITY), F.asc("year"))


def prediction_stats(pred: DataFrame) -> DataFrame:
    """AGG-22: total, positive, negative, mean confidence and risk, distinct entities."""
    return pred.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count(F.when(F.col("prediction"), 1)).alias("positive_predictions"),
        F.count(F.when(~F.col("prediction"), 1)).alias("negative_predictions"),
        F.avg("confidence").alias("avg_confidence"), F.avg("risk_score").alias("avg_risk_score"),
        F.count_distinct("entity_name").alias("unique_entities"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-23: row count per named table, as one union of 1-row aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def account_activity(users: DataFrame, as_of) -> DataFrame:
    """AGG-24: per role counts plus active in the last 30 days, never logged
    in, mean account age in days (``as_of`` timestamp literal)."""
    now = F.lit(as_of).cast("timestamp")
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count(F.when(F.col("role") == "admin", 1)).alias("admins"),
        F.count(F.when(F.col("role") == "auditor", 1)).alias("auditors"),
        F.count(F.when(F.col("role") == "viewer", 1)).alias("viewers"),
        F.count(F.when(F.datediff(now, F.col("last_login")) <= 30, 1)).alias("active_30d"),
        F.count(F.when(F.col("last_login").isNull(), 1)).alias("never_logged_in"),
        F.avg(F.datediff(now, F.col("created_at")).cast("double")).alias("avg_account_age_days"))


def latest_logins(users: DataFrame, n: int = 10) -> DataFrame:
    """AGG-24: the ten latest logins (never-logged-in accounts excluded)."""
    return (users.filter(F.col("last_login").isNotNull())
            .orderBy(F.desc("last_login"), F.asc("id")).limit(n)
            .select("id", "username", "role", "last_login"))


def entity_overview(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-25: per entity records, distinct years, expenditure, flags, flag rate."""
    return (df.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("year").alias("years"),
        F.coalesce(F.sum(exp_col), F.lit(0.0)).alias("total_expenditure"),
        F.coalesce(F.sum(flag_col), F.lit(0)).alias("audit_flags"),
        F.avg(F.col(flag_col).cast("double")).alias("flag_rate")))


def entity_year_summary(df: DataFrame, exp_col: str = "total_expenditure", flag_col: str = "audit_flag") -> DataFrame:
    """AGG-26: per (entity, year) flags, rows, rate, expenditure."""
    return (df.filter(F.col(ENTITY).isNotNull()).groupBy(ENTITY, "year").agg(
        F.sum(flag_col).alias("flags"), F.count(F.lit(1)).alias("records"),
        F.avg(F.col(flag_col).cast("double")).alias("flag_rate"), F.sum(exp_col).alias("expenditure")))


def data_quality_report(df: DataFrame) -> DataFrame:
    """AGG-27: rows, columns, null cells, duplicate rows, score and grade.

    Duplicates = rows - distinct rows: ``distinct`` is a full shuffle on all
    columns (hash partitioned, spill-capable), counted as a scalar subquery.
    """
    cols = df.columns
    nulls = sum((F.count(F.lit(1)) - F.count(F.col(c)) for c in cols), F.lit(0))
    g = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("null_cells"))
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("d")).scalar()
    g = g.select("rows", F.lit(len(cols)).alias("columns"), "null_cells",
                 (F.col("rows") - distinct_rows).alias("duplicate_rows"))
    null_share = F.col("null_cells") / (F.col("rows") * F.col("columns"))
    dup_share = F.col("duplicate_rows") / F.col("rows")
    g = g.withColumn("null_pct", null_share * 100).withColumn(
        "quality_score", ((F.lit(1.0) - null_share) + (F.lit(1.0) - dup_share)) / 2)
    return g.withColumn("grade", F.when(F.col("quality_score") > 0.9, "Excellent")
                        .when(F.col("quality_score") > 0.7, "Good")
                        .when(F.col("quality_score") > 0.5, "Fair").otherwise("Poor"))


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """AGG-29: sorted distinct non-null values of a column."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
