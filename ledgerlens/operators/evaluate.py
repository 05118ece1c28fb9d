"""Classifier evaluation over (label, score) DataFrames (EVL-*).

Curves and rank statistics are computed from per-score counts (one
map-side-combined aggregation) and PFX, never from a global sort in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import prefix_sums, row_index


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """EVL-1: counts on the full 2x2 grid (missing cells are 0)."""
    g = df.agg(*[F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1)).alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                                                 F.col(f"c{a}{b}").alias("count"))
                                        for a in (0, 1) for b in (0, 1)])).alias("s")).select("s.*")


def classification_report(df: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """EVL-2: per-class precision, recall, F1, support (zero division -> 0)."""
    g = df.agg(*[F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1)).alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(F.struct(F.lit(k).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1_score"), (tp + fn).alias("support")))
    return g.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def score_counts(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score: the input of every curve."""
    return (df.filter(F.col(score).isNotNull()).groupBy(score)
            .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                 F.sum((1 - F.col(y)).cast("long")).alias("neg")))


def _cum_desc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score: tp/fp = positives/negatives with score >= it."""
    sc = score_counts(df, y, score)
    pf = prefix_sums(sc, [score], ["pos", "neg"])
    tot = pf.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()   # from the checkpointed counts
    P, N = F.lit(float(tot["P"] or 0)), F.lit(float(tot["N"] or 0))
    return pf.select(score, "pos", "neg",
                     (P - F.col("pos_below")).alias("tp"), (N - F.col("neg_below")).alias("fp"),
                     F.col("neg_below"), P.alias("P"), N.alias("N"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """EVL-3: AUC as the rank statistic with half credit for ties:
    sum(pos * (neg_below + neg / 2)) / (P * N)."""
    c = _cum_desc(df, y, score)
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)),
                              F.first("P") * F.first("N")).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """EVL-3: (threshold, fpr, tpr) at every distinct score, plus the origin
    (threshold = +inf).  Intermediate collinear points are kept."""
    c = _cum_desc(df, y, score)
    pts = c.select(F.col(score).cast("double").alias("threshold"),
                   F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def pr_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """EVL-4: (threshold, precision, recall) per distinct score."""
    c = _cum_desc(df, y, score)
    return c.select(F.col(score).cast("double").alias("threshold"),
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    F.try_divide("tp", "P").alias("recall"))


def pr_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """EVL-4: trapezoid area under the PR curve ending at (recall 0, precision 1),
    and the baseline (positive rate).  Each point's predecessor is local: it
    is the same cumulative counts minus this score's own counts."""
    c = _cum_desc(df, y, score)
    tp0 = F.col("tp") - F.col("pos")
    fp0 = F.col("fp") - F.col("neg")
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    prec0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    area = F.try_divide(F.col("tp") - tp0, F.col("P")) * (prec + prec0) / 2.0
    return c.agg(F.sum(area).alias("pr_auc"),
                 F.try_divide(F.first("P"), F.first("P") + F.first("N")).alias("baseline"))


def precision_at_pct(df: DataFrame, ks: Sequence[float] = (0.05, 0.1, 0.2), y: str = "y",
                     score: str = "score") -> DataFrame:
    """EVL-5: threshold = linear percentile at 1-k; precision among rows with
    score >= threshold (ties included), 0 if none."""
    from ledgerlens.operators.ordered import exact_quantiles
    qs = exact_quantiles(df, score, [1 - k for k in ks])
    aggs = []
    for i, k in enumerate(ks):
        sel = F.col(score) >= F.lit(qs[i])
        aggs.append(F.coalesce(F.try_divide(F.sum(F.when(sel, F.col(y))).cast("double"),
                                            F.count(F.when(sel, 1)).cast("double")), F.lit(0.0))
                    .alias(f"precision_at_{int(round(k * 100))}pct"))
    return df.agg(*aggs)


def precision_at_k(df: DataFrame, ks: Sequence[int] = (10, 20, 50), y: str = "y", score: str = "score",
                   key: Sequence[str] = ("entity_name", "year")) -> DataFrame:
    """EVL-6: precision over the k highest scores (ties broken by key), k
    clamped to n.  The largest k needed is fetched once as a top-k."""
    n = df.count()
    kmax = min(max(ks), n)
    top = df.orderBy(F.desc(score), *[F.asc(k) for k in key]).limit(kmax)
    w_rows = []
    from pyspark.sql import Window
    t = top.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc(score), *[F.asc(k) for k in key])))
    for k in ks:
        kk = min(k, n)
        w_rows.append(F.struct(F.lit(k).alias("k"),
                               (F.coalesce(F.sum(F.when(F.col("_pos") <= kk, F.col(y))), F.lit(0)) / F.lit(kk if kk else 1))
                               .cast("double").alias("precision_at_k")))
    return t.agg(F.array(*w_rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def precision_at_k_curve(df: DataFrame, max_k: int = 100, step: int = 5, y: str = "y", score: str = "score",
                         key: Sequence[str] = ("entity_name", "year")) -> DataFrame:
    """EVL-6 curve at k = 1, 1+step, ... < min(max_k+1, n+1): cumulative hits
    over the global order from PFX row positions (no single-task window)."""
    t = df.withColumn("_neg", -F.col(score).cast("double"))
    r = row_index(t, ["_neg", *key], "_pos")
    r = prefix_sums(r.withColumn("_y", F.col(y).cast("double")), ["_pos"], ["_y"])
    k = F.col("_pos") + 1
    cur = r.filter((F.col("_pos") % step == 0) & (k <= max_k))
    return cur.select(k.cast("long").alias("k"), ((F.col("_y_below") + F.col("_y")) / k).alias("precision_at_k"))


def score_histogram(df: DataFrame, bins: int = 50, score: str = "score", lo: float = 0.0, hi: float = 1.0,
                    y: str | None = "y") -> DataFrame:
    """EVL-9: 50 equal bins on [lo, hi]; the right edge goes to the last bin."""
    b = F.least(F.width_bucket(F.col(score), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    g = df.filter(F.col(score).isNotNull()).groupBy(b.alias("bin"))
    aggs = [F.count(F.lit(1)).alias("count")]
    if y:
        aggs.append(F.sum(F.col(y).cast("long")).alias("positives"))
    return g.agg(*aggs)
