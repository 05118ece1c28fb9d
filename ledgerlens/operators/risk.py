"""Entity risk scoring and report datasets (MLT-7, MLT-8, FN-10, FN-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.functions.exprs import col_, risk_level


def recommendations(level) -> Column:
    """FN-10: recommendation list for a risk level."""
    lv = col_(level)
    expr = None
    for name, recs in rules.RISK_RECOMMENDATIONS.items():
        arr = F.array(*[F.lit(x) for x in recs])
        expr = F.when(lv == name, arr) if expr is None else expr.when(lv == name, arr)
    return expr.otherwise(F.array().cast("array<string>"))


def additional_recommendations(flags, expenditure, years) -> Column:
    """FN-11: extra recommendations from flags > 0, expenditure > 1e8, years > 5."""
    arr = F.array(F.when(col_(flags) > 0, F.lit(rules.REC_FLAGS)),
                  F.when(col_(expenditure) > 1e8, F.lit(rules.REC_EXPENDITURE)),
                  F.when(col_(years) > 5, F.lit(rules.REC_YEARS)))
    return F.filter(arr, lambda x: x.isNotNull())


def composite_entity_risk(df: DataFrame, scores: DataFrame | None = None, exp_col: str = "total_expenditure",
                          flag_col: str = "audit_flag", entity: str = "entity_name",
                          prob_col: str = "probability") -> DataFrame:
    """MLT-7: overall = .4 audit + .2 financial + .1 activity + .3 mean probability,
    for all entities in one aggregation.

    audit = flags / rows; financial = min(1, cv * .5 + max / 1e7 * .1) with
    cv = sample std / mean of expenditure (nulls as 0; 0 when mean <= 0);
    activity = min(1, distinct years / 10).  ``scores`` (entity, probability)
    supplies model probabilities; without it the term is 0.
    """
    e = F.coalesce(F.col(exp_col).cast("double"), F.lit(0.0))
    g = df.groupBy(entity).agg(
        F.sum(flag_col).alias("_flags"), F.count(F.lit(1)).alias("_rows"),
        F.avg(e).alias("_mean"), F.stddev_samp(e).alias("_std"), F.max(e).alias("_max"),
        F.count_distinct("year").alias("_years"))
    cv = F.when(F.col("_mean") > 0, F.coalesce(F.col("_std"), F.lit(0.0)) / F.col("_mean")).otherwise(F.lit(0.0))
    g = g.select(entity, (F.col("_flags") / F.col("_rows")).alias("audit_risk"),
                 F.least(F.lit(1.0), cv * 0.5 + F.col("_max") / 1e7 * 0.1).alias("financial_risk"),
                 F.least(F.lit(1.0), F.col("_years") / 10.0).alias("activity_risk"),
                 "_flags", "_years")
    if scores is not None:
        p = scores.groupBy(entity).agg(F.avg(prob_col).alias("prediction_confidence"))
        g = g.join(p, entity, "left").withColumn("prediction_confidence",
                                                 F.coalesce("prediction_confidence", F.lit(0.0)))
    else:
        g = g.withColumn("prediction_confidence", F.lit(0.0))
    overall = (F.col("audit_risk") * 0.4 + F.col("financial_risk") * 0.2 + F.col("activity_risk") * 0.1
               + F.col("prediction_confidence") * 0.3)
    g = g.withColumn("overall_score", overall).withColumn("risk_level", risk_level("overall_score"))
    return g.withColumn("recommendations", recommendations("risk_level")).drop("_flags", "_years")


def entity_report_dataset(df: DataFrame, scores: DataFrame | None = None, exp_col: str = "total_expenditure",
                          flag_col: str = "audit_flag", entity: str = "entity_name") -> DataFrame:
    """MLT-8: per-entity report rows: overview (AGG-25), composite risk
    (MLT-7), additional recommendations (FN-11) and the per-year summary
    (AGG-26) nested as an array of structs ordered by year.  The nested list
    is bounded by the number of years per entity."""
    from ledgerlens.operators.aggs import entity_overview, entity_year_summary
    ov = entity_overview(df, exp_col, flag_col)
    risk = composite_entity_risk(df, scores, exp_col, flag_col, entity)
    yrs = (entity_year_summary(df, exp_col, flag_col).groupBy(entity)
           .agg(F.array_sort(F.collect_list(F.struct("year", "flags", "records", "flag_rate", "expenditure")))
                .alias("yearly")))
    j = ov.join(risk, entity).join(yrs, entity)
    return j.withColumn("additional_recommendations",
                        additional_recommendations("audit_flags", "total_expenditure", "years"))
