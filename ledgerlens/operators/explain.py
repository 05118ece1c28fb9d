"""Attributions and explanations (EXP-1..7).

Attributions are long DataFrames (row key, feature, value, attribution):
per-row work is column arithmetic, global summaries are aggregations, and
the sampled-Shapley estimator scores its coalitions with the model's own
distributed ``transform``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_attributions(df: DataFrame, coefs: dict, intercept: float, key: Sequence[str]) -> DataFrame:
    """EXP-1: exact linear attributions coef * (x - mean) with expected value
    sum(coef * mean) + intercept, and the plain coef * x variant.  Means of
    all features come from one aggregation."""
    feats = list(coefs)
    means = df.agg(*[F.avg(f).alias(f) for f in feats]).first()
    expected = intercept + sum(coefs[f] * (means[f] or 0.0) for f in feats)
    lon = df.select(*key, *feats).unpivot(list(key), feats, "feature", "value")
    coef = F.element_at(F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(float(coefs[f])))]), F.col("feature"))
    mean = F.element_at(F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(float(means[f] or 0.0)))]),
                        F.col("feature"))
    return lon.select(*key, "feature", "value", (coef * (F.col("value") - mean)).alias("attribution"),
                      (coef * F.col("value")).alias("attribution_raw"), F.lit(expected).alias("expected_value"))


def importance_weighted(df: DataFrame, importances: dict, prob: str, key: Sequence[str]) -> DataFrame:
    """EXP-2: importance * x / (max |x| of the row + 1e-10) * (p - 0.5) * 2."""
    feats = list(importances)
    mx = F.array_max(F.array(*[F.abs(F.col(f)) for f in feats])) + F.lit(1e-10)
    d = df.select(*key, prob, *feats, mx.alias("_mx"))
    lon = d.unpivot([*key, prob, "_mx"], feats, "feature", "value")
    imp = F.element_at(F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(float(importances[f])))]),
                       F.col("feature"))
    return lon.select(*key, "feature", "value",
                      (imp * F.col("value") / F.col("_mx") * (F.col(prob) - 0.5) * 2).alias("contribution"))


def global_importance(attr: DataFrame, top_n: int | None = 20, col: str = "attribution") -> DataFrame:
    """EXP-4: mean |attribution| per feature, ranked."""
    g = attr.groupBy("feature").agg(F.avg(F.abs(col)).alias("mean_abs_attribution"))
    g = g.orderBy(F.desc("mean_abs_attribution"), F.asc("feature"))
    return g.limit(top_n) if top_n else g


def drilldown(attr: DataFrame, key: Sequence[str], top_n: int = 20, col: str = "attribution") -> DataFrame:
    """EXP-5: per row the top features by |attribution| (with value and
    sign) and prediction = expected + sum of all attributions."""
    w = Window.partitionBy(*key)
    ranked = Window.partitionBy(*key).orderBy(F.desc(F.abs(col)), F.asc("feature"))
    d = attr.withColumn("prediction", F.col("expected_value") + F.sum(col).over(w))
    d = d.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= top_n)
    return d.select(*key, "rank", "feature", "value", col,
                    F.when(F.col(col) >= 0, "increases").otherwise("decreases").alias("direction"),
                    "expected_value", "prediction")


def summary_long(attr: DataFrame, key: Sequence[str], col: str = "attribution") -> DataFrame:
    """EXP-6: long (row, feature, attribution, value, global rank of the feature)."""
    gi = global_importance(attr, None, col)
    rk = gi.withColumn("feature_rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_attribution"),
                                                                          F.asc("feature"))).cast("long"))
    # one row per feature: a bounded broadcast
    return attr.join(F.broadcast(rk.select("feature", "feature_rank")), "feature").select(
        *key, "feature", col, "value", "feature_rank")


def rule_factors(df: DataFrame, entity: str = "entity_name", rev: str = "revenue", exp: str = "expenditure") -> DataFrame:
    """EXP-7: rule-based risk factors per entity when no model exists:
    min(expense ratio, 2) * .5 and min(debt ratio, 1) of the latest row,
    mean flag, and min(revenue CV, 1) when the entity has > 1 row; long form."""
    latest = F.max_by(F.struct(F.col(rev).alias("r"), F.col(exp).alias("e"), F.col("total_assets").alias("a"),
                               F.col("total_liabilities").alias("l")), "year")
    g = df.groupBy(entity).agg(latest.alias("_l"), F.avg(F.col("audit_flag").cast("double")).alias("audit_history"),
                               F.stddev_samp(rev).alias("_sd"), F.avg(rev).alias("_m"), F.count(F.lit(1)).alias("_n"))
    f = g.select(entity,
                 (F.least(F.try_divide(F.col("_l.e"), F.col("_l.r") + 1e-6), F.lit(2.0)) * 0.5).alias("High Expense Ratio"),
                 F.least(F.try_divide(F.col("_l.l"), F.col("_l.a") + 1e-6), F.lit(1.0)).alias("High Debt Ratio"),
                 F.col("audit_history").alias("Historical Audit Issues"),
                 F.when(F.col("_n") > 1, F.least(F.try_divide(F.col("_sd"), F.col("_m") + 1e-6), F.lit(1.0)))
                 .alias("Revenue Volatility"))
    return f.unpivot([entity], ["High Expense Ratio", "High Debt Ratio", "Historical Audit Issues",
                                "Revenue Volatility"], "factor", "score").filter(F.col("score").isNotNull())


def sampled_shapley(model, instances: DataFrame, background: DataFrame, features: Sequence[str],
                    key: Sequence[str], n_perm: int = 32, seed: int = 7, prob_index: int = 1) -> DataFrame:
    """EXP-3: permutation-sampling Shapley values (Strumbelj & Kononenko).

    Each (instance, sample) draws a feature permutation and a background row
    (deterministic hashes of the keys, so recomputation is stable); coalitions
    grow by one feature of the permutation at a time; the model scores them
    in one ``transform``; attributions are the averaged differences between
    neighbours.  Per sample the marginals telescope to
    f(x) - f(z), so attributions sum exactly to prediction - expected_value
    (expected = mean f(z) over the instance's samples).  A random forest's
    coalitions are scored on the trees' paths (``tree_paths``), which gives the
    same differences without a ``transform`` of every coalition.
    """
    feats = list(features)
    nf = len(feats)
    bg = background.select(*[F.col(f).cast("double").alias(f) for f in feats])
    # the background is a bounded sample (<= ~100 rows), so numbering it in one window is fine
    bg = bg.withColumn("_bid", F.row_number().over(Window.orderBy(*[F.col(f) for f in feats])) - 1)
    nb = bg.count()
    zarr = bg.select("_bid", F.array(*[F.col(f) for f in feats]).alias("z"))
    inst = instances.select(*key, F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
    names = F.array(*[F.lit(n) for n in feats])
    if isinstance(model, RandomForestClassificationModel) and model.numClasses == 2:
        from ledgerlens.operators.tree_paths import path_attributions
        out = path_attributions(model, inst.dropna(subset=list(key)), [r["z"] for r in zarr.orderBy("_bid").collect()], key, n_perm, seed, prob_index)
        return out.select(*key, F.inline(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("a").alias("attribution"))), "expected_value").select(
            *key, "feature", "value", "attribution", "expected_value")
    s = inst.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("m"))
    h = F.xxhash64(*[F.col(k) for k in key], F.col("m"), F.lit(seed))
    s = s.withColumn("_bid", F.pmod(h, F.lit(nb)))
    keyed = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)), lambda i: F.struct(F.xxhash64(h, i).alias("r"), i.alias("i")))
    s = s.withColumn("perm", F.transform(F.array_sort(keyed), lambda t: t["i"]))
    s = s.join(F.broadcast(zarr), "_bid")          # background <= 100 rows: bounded broadcast
    # few instances make many scores: spread before the coalitions are spelled out
    s = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "m")
    # coalition t holds the first t features of the permutation: nf + 1 scores a sample
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("t"))
    v = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)),
                    lambda f: F.when(F.array_position(F.col("perm"), f) <= F.col("t"), F.col("x")[f])
                    .otherwise(F.col("z")[f]))
    scored = model.transform(s.select(*key, "perm", "t", array_to_vector(v).alias("features")))
    f = vector_to_array("probability")[prob_index]
    # coalition t adds its score to the t-th feature and takes it from the next; t = 0 is the expected value (j = -1)
    parts = F.array(F.struct(F.coalesce(F.get("perm", F.col("t") - 1), F.lit(-1)).alias("j"), f.alias("v")),
                    F.struct(F.get("perm", F.col("t")).alias("j"), (-f).alias("v")))
    tot = (scored.select(*key, F.explode(parts).alias("p")).filter(F.col("p.j").isNotNull())
           .groupBy(*key, F.col("p.j").alias("j")).agg((F.sum("p.v") / n_perm).alias("a")))
    per = tot.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("j", "a"))).alias("a"))
    out = (per.join(inst, list(key))
           .select(*key, "x", "a", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("j")))
    return out.select(*key, F.element_at(names, F.col("j") + 1).alias("feature"), F.col("x")[F.col("j")].alias("value"),
                      F.col("a")[F.col("j")].alias("attribution"), F.col("a")[F.lit(-1)].alias("expected_value"))
