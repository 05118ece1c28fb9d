"""EXP-3: exact path-dependent Shapley values of tree ensembles from a table of their leaves.

A leaf is described by the features on its path, the interval that each of
them must lie in, and the share of training rows that the path's splits on it
keep (its cover).  If the features of a coalition decide and the others follow
the cover, a leaf of value v counts v * prod(in interval) * prod(cover), so the
Shapley value of a feature is a sum over coalition sizes: the coefficients of
prod(cover_i + inside_i * t) over the other features of the path, each with
the weight k! (m - 1 - k)! / m!.  The product is built once per leaf and one
factor divided out per feature: work grows with leaves x depth squared, not
with the subsets, and nothing is sampled.  Tables of leaves are as large as
the model; rows are explained where they lie, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import materialize, scratch_path

LEAF = "tree int, leaf int, value double, features array<int>, lower array<double>, upper array<double>, cover array<double>"
#: Leaves, and numbers in an array, that are worked on at once.
LEAVES, NUMBERS = 2048, 1 << 20


def _walk(nodes: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one tree (at most 2 ** depth)."""
    node = {r["id"]: r for r in nodes.to_dict("records")}
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        n = node[at]
        if n["left"] < 0:
            found = sorted(path)
            stats = np.asarray(n["stats"], float)
            value = stats[1] / stats.sum() if n["classes"] else n["prediction"]
            out.append((n["tree"], at, float(value), found, *([path[f][k] for f in found] for k in range(3))))
            continue
        if n["categories"] >= 0:
            raise ValueError("splits on categories are not explained")
        low, high, cover = path.get(n["feature"], (-np.inf, np.inf, 1.0))
        bound = float(n["threshold"])
        for child, span in ((n["left"], (low, min(high, bound))), (n["right"], (max(low, bound), high))):
            todo.append((child, path | {n["feature"]: (*span, cover * node[child]["rows"] / n["rows"])}))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LEAF.split(", ")])


def node_table(spark: SparkSession, model) -> tuple[DataFrame, str]:
    """The nodes of a fitted ensemble, read from the model as Spark saves it, and the folder of the saved model."""
    path = scratch_path(spark, f"trees-{model.uid}")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"), n["rawCount"].alias("rows"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["split"]["numCategories"].alias("categories")), path


def leaf_table(spark: SparkSession, model) -> DataFrame:
    """The leaves of a fitted binary random forest (values: probability of class 1) or boosted classifier (margin),
    values times the weights of their trees: read from the model as Spark saves it, a tree in a task."""
    boosted = "GBT" in type(model).__name__
    nodes, path = node_table(spark, model)
    if boosted:
        weights = F.col("w")
        trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "meta", "w").select("tree", "w")
    else:
        weights = F.lit(1.0 / model.getNumTrees)
    nodes = nodes.withColumn("classes", F.lit(not boosted))
    leaves = nodes.groupBy("tree").applyInPandas(_walk, LEAF)
    if boosted:
        leaves = leaves.join(F.broadcast(trees), "tree")           # a row per tree
    return materialize(leaves.select("tree", "leaf", (F.col("value") * weights).alias("value"), "features", "lower", "upper", "cover"), "leaves")


class Leaves:
    """Leaves grouped by the number of features on their paths."""

    def __init__(self, rows: list, n_features: int):
        self.n_features, self.groups = n_features, []
        self.expected = float(sum(r["value"] * np.prod(r["cover"]) for r in rows))
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["features"]), []).append(r)
        for m, group in sorted(by_size.items()):
            for a in range(0, len(group) if m else 0, LEAVES):       # a tree of one leaf explains nothing
                part = group[a: a + LEAVES]
                self.groups.append((m, np.array([r["value"] for r in part]), *(np.array([r[c] for r in part]) for c in ("features", "lower", "upper", "cover"))))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): the Shapley value of each feature; with ``expected`` they add up to the prediction."""
        out = np.zeros((len(x), self.n_features), order="F")        # a feature's values side by side
        columns = np.ascontiguousarray(x.T)
        for m, value, feature, lower, upper, cover in self.groups:
            weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            if len(x) > 1 << m:                                     # fewer patterns than rows
                self._by_pattern(out, columns, m, weight, value, feature, lower, upper, cover)
                continue
            step = max(1, NUMBERS // (len(value) * (m + 1)))
            for a in range(0, len(x), step):
                seen = x[a: a + step][:, feature]                   # rows, leaves, features of the path
                inside = ((seen <= upper) | np.isinf(upper)) & ~(seen <= lower)
                for j, share in enumerate(self._shares(inside, m, weight, value, cover)):
                    out[a: a + step] += share @ (feature[:, j, None] == np.arange(self.n_features))
        return out

    def _by_pattern(self, out, columns, m, weight, value, feature, lower, upper, cover) -> None:
        """Rows that lie inside the same intervals of a leaf get the same values: 2 ** m patterns are worked out once
        for a leaf, and each row looks its own up."""
        pattern = (np.arange(1 << m)[:, None, None] >> np.arange(m) & 1).astype(bool)
        step = max(1, NUMBERS // ((1 << m) * (m + 1)))
        for a in range(0, len(value), step):
            part = slice(a, a + step)
            inside = np.broadcast_to(pattern, (1 << m, len(value[part]), m))
            table = np.stack(list(self._shares(inside, m, weight, value[part], cover[part])))
            for leaf in range(len(value[part])):
                code = np.zeros(columns.shape[1], np.int32)
                for j in range(m):
                    seen, low, high = columns[feature[a + leaf, j]], lower[a + leaf, j], upper[a + leaf, j]
                    within = ~(seen <= low) if np.isinf(high) else (seen <= high) & ~(seen <= low)
                    code |= within.astype(np.int32) << j
                for j in range(m):
                    out[:, feature[a + leaf, j]] += table[j, :, leaf][code]

    @staticmethod
    def _shares(inside, m, weight, value, cover) -> Iterator[np.ndarray]:
        """For each feature of the path its value (rows, leaves), from ``inside`` (rows, leaves, features)."""
        product = np.zeros((*inside.shape[:2], m + 1))
        product[..., 0] = 1.0
        for j in range(m):
            z = cover[:, j, None]
            grown = product * z
            grown[..., 1:] += product[..., :-1] * inside[..., j, None]
            product = grown
        for j in range(m):
            z, total = cover[:, j], np.zeros(inside.shape[:2])
            rest = np.zeros(inside.shape[:2])                       # the factor divided out, from the highest power
            for k in range(m - 1, -1, -1):
                rest = product[..., k + 1] - z * rest
                total += weight[k] * np.where(inside[..., j], rest, product[..., k] / z)
            yield value * (inside[..., j] - z) * total


def tree_attributions(model, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """EXP-3: key, feature, value, attribution and expected_value, a row for each row and feature of ``df``.

    Attributions of a row and the expected value (the cover-weighted mean of the leaves) add up to the model's
    probability of class 1, or to the margin of a boosted model.  A value that is null goes the way MLlib sends NaN."""
    features, key, spark = list(features), list(key), df.sparkSession
    leaves = Leaves(leaf_table(spark, model).orderBy("tree", "leaf").collect(), len(features))   # as large as the model
    shared = spark.sparkContext.broadcast(leaves)
    rows = df.select(*key, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("_x"))
    schema = T.StructType([*[rows.schema[k] for k in key], T.StructField("_x", T.ArrayType(T.DoubleType())), T.StructField("_a", T.ArrayType(T.DoubleType()))])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = shared.value.attributions(np.array(pdf["_x"].tolist(), float).reshape(len(pdf), -1))
                yield pdf.assign(_a=list(found))
    # few rows make much work: spread before explaining, but patterns are worked out once in a batch
    spread = rows.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *key)
    done = spread.mapInPandas(explain, schema)
    names = F.array(*[F.lit(f) for f in features])
    return done.select(*key, F.inline(F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_a").alias("attribution")))).select(
        *key, "feature", F.nanvl("value", F.lit(None).cast("double")).alias("value"), "attribution", F.lit(leaves.expected).alias("expected_value"))
