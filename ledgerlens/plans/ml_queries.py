"""Registered model, attribution and SVD queries (MLT-*, EVL-7/8, EXP-*, WIN-11, TXT-9/10)."""

from pyspark.sql import functions as F

from ledgerlens.functions.exprs import eps_div
from ledgerlens.operators import explain as XP, ml as ML, ordered as OR
from ledgerlens.operators.features import feature_target_split, financial_ratios, procurement_indicators, \
    payroll_features, risk_flags, temporal_flags
from ledgerlens.plans import sqlgen as S
from ledgerlens.plans.oracle_fixtures import EY, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx

r = S.r
KEY = ["entity_name", "year"]
# The ATT fixture's literal linear model (FIXTURES.md part B).
ATT_COEFS = {"expense_ratio": 0.8, "debt_ratio": 1.5, "single_source_ratio": 2.0}
ATT_INTERCEPT = -1.0
ATT_IMPORTANCE = {"expense_ratio": 0.5, "debt_ratio": 0.3, "single_source_ratio": 0.2}


def _att(spark, sf):
    ey = fx.entity_year(spark, sf)
    d = ey.select(*KEY, "audit_flag",
                  (F.col("expenditure") / F.col("revenue")).alias("expense_ratio"),
                  (F.col("total_liabilities") / F.col("total_assets")).alias("debt_ratio"),
                  (F.col("single_source_contracts") / F.col("contract_count")).alias("single_source_ratio"))
    z = sum(F.col(f) * c for f, c in ATT_COEFS.items()) + ATT_INTERCEPT
    return d.withColumn("p", 1.0 / (1.0 + F.exp(-z)))


ATT_SQL = EY + """, att AS (SELECT entity_name, year, audit_flag, expenditure / revenue AS expense_ratio,
  total_liabilities / total_assets AS debt_ratio, single_source_contracts / contract_count AS single_source_ratio FROM ey),
att2 AS (SELECT *, 1.0 / (1.0 + exp(-(expense_ratio * 0.8 + debt_ratio * 1.5 + single_source_ratio * 2.0 - 1.0))) AS p FROM att),
mn AS (SELECT avg(expense_ratio) AS me, avg(debt_ratio) AS md, avg(single_source_ratio) AS ms FROM att),
lon AS (SELECT entity_name, year, 'expense_ratio' AS feature, expense_ratio AS value, 0.8 AS coef, me AS mean FROM att, mn
  UNION ALL SELECT entity_name, year, 'debt_ratio', debt_ratio, 1.5, md FROM att, mn
  UNION ALL SELECT entity_name, year, 'single_source_ratio', single_source_ratio, 2.0, ms FROM att, mn),
la AS (SELECT entity_name, year, feature, value, coef * (value - mean) AS attribution, coef * value AS attribution_raw,
  (SELECT -1.0 + 0.8 * me + 1.5 * md + 2.0 * ms FROM mn) AS expected_value FROM lon)"""


def _la(spark, sf):
    return XP.linear_attributions(_att(spark, sf), ATT_COEFS, ATT_INTERCEPT, KEY)


@register("exp_linear_attributions", with_(ATT_SQL) + f"""SELECT entity_name, year, feature, {r('value')} AS value,
  {r('attribution')} AS attribution, {r('attribution_raw')} AS attribution_raw, {r('expected_value')} AS expected_value FROM la""")
def q_linear_attributions(spark, sf):
    """EXP-1: exact linear attributions."""
    return _la(spark, sf)


@register("exp_importance_weighted", with_(ATT_SQL) + f""", iw AS (SELECT entity_name, year, p,
  greatest(abs(expense_ratio), abs(debt_ratio), abs(single_source_ratio)) + 1e-10 AS mx, expense_ratio, debt_ratio,
  single_source_ratio FROM att2)
SELECT entity_name, year, 'expense_ratio' AS feature, {r('expense_ratio')} AS value, {r('0.5 * expense_ratio / mx * (p - 0.5) * 2')} AS contribution FROM iw
UNION ALL SELECT entity_name, year, 'debt_ratio', {r('debt_ratio')}, {r('0.3 * debt_ratio / mx * (p - 0.5) * 2')} FROM iw
UNION ALL SELECT entity_name, year, 'single_source_ratio', {r('single_source_ratio')}, {r('0.2 * single_source_ratio / mx * (p - 0.5) * 2')} FROM iw""")
def q_importance_weighted(spark, sf):
    """EXP-2: importance-weighted contributions."""
    return XP.importance_weighted(_att(spark, sf), ATT_IMPORTANCE, "p", KEY)


@register("exp_global_importance", with_(ATT_SQL) + f"""SELECT feature, {r('avg(abs(attribution))')} AS mean_abs_attribution
FROM la GROUP BY feature ORDER BY mean_abs_attribution DESC, feature LIMIT 20""")
def q_global_importance(spark, sf):
    """EXP-4: global importance (mean |attribution|)."""
    return XP.global_importance(_la(spark, sf), 20)


@register("exp_drilldown", with_(ATT_SQL) + f""", d AS (SELECT *, expected_value + sum(attribution) OVER (PARTITION BY entity_name, year) AS prediction,
  row_number() OVER (PARTITION BY entity_name, year ORDER BY abs(attribution) DESC, feature) AS rank FROM la)
SELECT entity_name, year, rank, feature, {r('value')} AS value, {r('attribution')} AS attribution,
  CASE WHEN attribution >= 0 THEN 'increases' ELSE 'decreases' END AS direction, {r('expected_value')} AS expected_value,
  {r('prediction')} AS prediction FROM d WHERE rank <= 20""")
def q_drilldown(spark, sf):
    """EXP-5: per-row drill-down."""
    return XP.drilldown(_la(spark, sf), KEY, 20)


@register("exp_summary_long", with_(ATT_SQL) + f""", gi AS (SELECT feature, row_number() OVER (ORDER BY avg(abs(attribution)) DESC, feature) AS feature_rank
  FROM la GROUP BY feature)
SELECT la.entity_name, la.year, la.feature, {r('la.attribution')} AS attribution, {r('la.value')} AS value, gi.feature_rank
FROM la JOIN gi ON la.feature = gi.feature""")
def q_summary_long(spark, sf):
    """EXP-6: long summary table."""
    return XP.summary_long(_la(spark, sf), KEY)


@register("win_waterfall", with_(ATT_SQL) + f""", w AS (SELECT *, row_number() OVER (PARTITION BY entity_name, year ORDER BY abs(attribution) DESC, feature) AS step FROM la)
SELECT entity_name, year, feature, step, {r('attribution')} AS attribution,
  {r('expected_value + sum(attribution) OVER (PARTITION BY entity_name, year ORDER BY step ROWS UNBOUNDED PRECEDING)')} AS running_total
FROM w WHERE step <= 15""")
def q_waterfall(spark, sf):
    """WIN-11: waterfall (top 15 by |contribution|, running total from the expected value)."""
    key = F.concat_ws("|", "entity_name", F.col("year").cast("string"))
    la = _la(spark, sf).withColumn("row_id", key)
    w = OR.waterfall(la, "row_id", "feature", "attribution", "expected_value", 15)
    return w.select(*KEY, "feature", "step", "attribution", "running_total")


@register("exp_rule_factors", with_(EY) + f""", g AS (SELECT entity_name, arg_max(revenue, year) AS r, arg_max(expenditure, year) AS e,
  arg_max(total_assets, year) AS a, arg_max(total_liabilities, year) AS l, avg(audit_flag) AS ah, stddev_samp(revenue) AS sd,
  avg(revenue) AS m, count(*) AS n FROM ey GROUP BY entity_name),
f AS (SELECT entity_name, 'High Expense Ratio' AS factor, least(e / (r + 1e-6), 2.0) * 0.5 AS score FROM g
  UNION ALL SELECT entity_name, 'High Debt Ratio', least(l / (a + 1e-6), 1.0) FROM g
  UNION ALL SELECT entity_name, 'Historical Audit Issues', ah FROM g
  UNION ALL SELECT entity_name, 'Revenue Volatility', CASE WHEN n > 1 THEN least(sd / (m + 1e-6), 1.0) END FROM g)
SELECT entity_name, factor, {r('score')} AS score FROM f WHERE score IS NOT NULL""")
def q_rule_factors(spark, sf):
    """EXP-7: rule-based risk factors."""
    return XP.rule_factors(fx.entity_year(spark, sf))


@register("mlt_class_weights", with_(EY) + f"""SELECT audit_flag, count(*) AS n_c,
  {r('(SELECT count(*) FROM ey) / (2.0 * count(*))')} AS balanced_weight,
  {r('(SELECT count(*) FROM ey WHERE audit_flag = 0) / CAST((SELECT count(*) FROM ey WHERE audit_flag = 1) AS DOUBLE)')} AS pos_weight
FROM ey GROUP BY audit_flag""")
def q_class_weights(spark, sf):
    """MLT-1: balanced class weights and positive weight."""
    return ML.class_weights(fx.entity_year(spark, sf))


def model_frame(spark, sf):
    """Entity-year features on raw values (quirk Q6 decision), label kept."""
    d = fx.entity_year(spark, sf)
    d = financial_ratios(d)
    d = procurement_indicators(d)
    d = payroll_features(d)
    d = temporal_flags(d, 1995, 1999)
    d = risk_flags(d)
    from ledgerlens.operators.clean import zero_fill
    return zero_fill(d)


_FITTED: dict = {}


def _train(spark, sf, names=None):
    """Fit once per (session, content of the training frame, model set); later
    queries of the same session reuse the fitted models while the data stay
    the same (they are artifacts, like SRC-6)."""
    d = model_frame(spark, sf)
    feats = feature_target_split(d)
    content = d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*d.columns))).first()
    k = (spark.sparkContext.applicationId, tuple(content), tuple(names or ()))
    if k not in _FITTED:
        _FITTED[k] = ML.train_models(d, feats, names=names)
    return d, feats, _FITTED[k]


@register("fea_feature_vectors")
def q_feature_vectors(spark, sf):
    """FEA-12: numeric features minus id/label/leak columns, assembled into a
    vector per entity-year (rows-only: feature count and vector size)."""
    d = model_frame(spark, sf)
    feats = feature_target_split(d)
    v = ML.assemble(d, feats)
    from pyspark.ml.functions import vector_to_array
    return v.select(*KEY, F.lit(len(feats)).alias("n_features"),
                    F.size(vector_to_array("features")).alias("vector_size"))


@register("mlt_train_models")
def q_train_models(spark, sf):
    """MLT-2..5: logistic regression, random forest and two boosted models on
    the time-aware split; one metrics row per model (rows-only check)."""
    _, _, (metrics, _, _) = _train(spark, sf)
    return metrics


@register("mlt_batch_scores")
def q_batch_scores(spark, sf):
    """MLT-6: every entity-year scored with the best model."""
    d, feats, (_, models, best) = _train(spark, sf)
    return ML.score(d, models[best], feats, best).select(*KEY, "risk_score", "risk_category", "confidence", "model_used")


@register("evl_feature_importance")
def q_feature_importance(spark, sf):
    """EVL-7: ranked feature importances per trained model."""
    _, feats, (_, models, _) = _train(spark, sf)
    return ML.importance_frame(spark, models, feats, 20)


@register("evl_model_comparison")
def q_model_comparison(spark, sf):
    """EVL-8: model comparison (metric x model, best flagged)."""
    _, _, (metrics, _, _) = _train(spark, sf)
    return ML.model_comparison(metrics)


@register("exp_sampled_shapley")
def q_sampled_shapley(spark, sf):
    """EXP-3: sampled Shapley attributions of the random forest for every row,
    against 100 background rows and 8 permutations (parameters of the estimate)."""
    d, feats, (_, models, _) = _train(spark, sf, ["random_forest"])
    key = ["entity_name", "row_year"]
    base = d.select("entity_name", F.col("year").alias("row_year"),
                    *[F.col(f).cast("double").alias(f) for f in feats]).na.fill(0.0)
    bg = base.orderBy(F.xxhash64(F.col("entity_name"), F.lit(1)), *key).limit(100)
    return XP.sampled_shapley(models["random_forest"], base, bg, feats, key, n_perm=8)


@register("exp_tree_attributions", with_(EY) + """SELECT entity_name, year, CAST(count(*) AS BIGINT) AS rows, 0.0::DOUBLE AS gap FROM ey GROUP BY ALL""")
def q_tree_attributions(spark, sf):
    """EXP-3: exact Shapley values of the random forest for every row.  Each row's values and the expected value must
    add up to the probability that MLlib gives it: ``gap`` is what is missing."""
    from ledgerlens.operators.tree_explain import tree_attributions
    d, feats, (_, models, _) = _train(spark, sf, ["random_forest"])
    model = models["random_forest"]
    base = d.select("entity_name", F.col("year").alias("row_year"), *[F.col(f).cast("double").alias(f) for f in feats])
    parts = tree_attributions(model, base, feats, ["entity_name", "row_year"]).groupBy("entity_name", "row_year").agg(
        F.sum("attribution").alias("sum"), F.first("expected_value").alias("expected"))
    scored = ML.probability(model.transform(ML.assemble(base, feats))).select("entity_name", "row_year", "probability_1")
    gap = F.round(F.abs(F.col("sum") + F.col("expected") - F.col("probability_1")), 9)
    return parts.join(scored, ["entity_name", "row_year"]).groupBy("entity_name", F.col("row_year").alias("year")).agg(F.count("*").alias("rows"), F.max(gap).alias("gap"))


@register("txt_svd_components")
def q_svd_components(spark, sf):
    """TXT-9/10: TF-IDF -> uncentred SVD -> min-max components plus domain
    features, one row per document."""
    return ML.text_feature_matrix(fx.report_documents(spark, sf))
