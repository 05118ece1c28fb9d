"""EXP-3: sampled Shapley values of a random forest along the paths of its trees.

A sample is a row x, a background row z and an order of the features; coalition
t takes the first t features of the order from x and the others from z.  Where x
and z part ways at a split, the coalitions from the feature's place on go with x
and those before it with z, so a leaf is reached by the coalitions of one
interval [a, b).  A leaf of value v adds v to the feature at place a and takes
it from the feature at place b; at place 0 it belongs to z's own score.  These
are the differences that scoring all coalitions one by one would give.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.tree_explain import node_table

#: Pairs of a sample and a tree that are walked down at once.
PAIRS = 1 << 16


class Forest:
    """Nodes of all trees in one table; an inner node's children, split, and a leaf's share of the mean probability."""

    def __init__(self, nodes: list, n_trees: int, prob_index: int = 1):
        nodes = sorted(nodes, key=lambda r: (r["tree"], r["id"]))
        place = {(r["tree"], r["id"]): i for i, r in enumerate(nodes)}
        if any(r["left"] >= 0 and r["categories"] >= 0 for r in nodes):
            raise ValueError("splits on categories are not explained")
        self.roots = np.array([place[t, 0] for t in sorted({r["tree"] for r in nodes})], np.int32)
        inner = [r["left"] >= 0 for r in nodes]
        self.child = np.array([[place[r["tree"], r["right"]], place[r["tree"], r["left"]]] if i else [-1, -1] for r, i in zip(nodes, inner)], np.int32).reshape(-1, 2)
        self.feature = np.array([r["feature"] if i else -1 for r, i in zip(nodes, inner)], np.int32)
        self.threshold = np.array([r["threshold"] if i else 0.0 for r, i in zip(nodes, inner)])
        self.value = np.array([0.0 if i else r["stats"][prob_index] / sum(r["stats"]) / n_trees for r, i in zip(nodes, inner)])

    def marginals(self, x: np.ndarray, z: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(samples, 1 + features): z's score, then what the feature at each place of the order (from 1) adds.
        ``place`` (samples, features): the place of each feature."""
        n, nf = x.shape
        out = np.zeros(n * (nf + 2))                             # the last column takes what no feature ends
        x, z, place = x.ravel(), z.ravel(), place.astype(np.int32).ravel()
        sample = np.repeat(np.arange(n, dtype=np.int32), len(self.roots))
        node = np.tile(self.roots, n)
        first, end = np.zeros(len(node), np.int32), np.full(len(node), nf + 1, np.int32)
        while len(node):
            leaf = self.feature[node] < 0
            if leaf.any():
                value, row = self.value[node[leaf]], sample[leaf] * (nf + 2)
                out += np.bincount(row + first[leaf], value, len(out)) - np.bincount(row + end[leaf], value, len(out))
                sample, node, first, end = (v[~leaf] for v in (sample, node, first, end))
            at, bound = sample * nf + self.feature[node], self.threshold[node]
            with_x, with_z, turn = x[at] <= bound, z[at] <= bound, place[at]
            child = self.child[node]
            rows = np.arange(len(node))
            part = with_x != with_z
            late = np.flatnonzero(part & (turn < end))           # coalitions that have the feature go with x
            early = np.flatnonzero(~part | (turn > first))       # the others with z; both, where they agree
            split = part[early]
            node, first, end, sample = (
                np.concatenate([child[rows[early], with_z[early].view(np.int8)], child[rows[late], with_x[late].view(np.int8)]]),
                np.concatenate([first[early], np.maximum(first[late], turn[late])]),
                np.concatenate([np.where(split, np.minimum(end[early], turn[early]), end[early]), end[late]]),
                np.concatenate([sample[early], sample[late]]))
        return out.reshape(n, nf + 2)[:, :-1]


def path_attributions(model, inst: DataFrame, background: list, key: Sequence[str], n_perm: int, seed: int, prob_index: int = 1) -> DataFrame:
    """key, x, a (a value for each feature) and expected_value of each row of ``inst`` (key, x); the rows stay where they lie."""
    spark, nf, nb = inst.sparkSession, model.numFeatures, len(background)
    nodes = node_table(spark, model)[0].select("tree", "id", "stats", "left", "right", "feature", "threshold", "categories")
    forest = spark.sparkContext.broadcast(Forest(nodes.collect(), model.getNumTrees, prob_index))        # as large as the model
    zs = np.array(background, float).reshape(nb, nf)
    draws = [F.xxhash64(*[F.col(k) for k in key], F.lit(m), F.lit(seed)) for m in range(n_perm)]
    h = inst.select(*key, "x", F.array(*draws).alias("_h"))
    # few rows make much work: spread them
    h = h.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *key)
    s = h.select(*key, "x", F.transform("_h", lambda v: F.pmod(v, F.lit(nb))).alias("_b"),
                 F.array(*[F.xxhash64(F.col("_h")[m], F.lit(i)) for m in range(n_perm) for i in range(nf)]).alias("_r"))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // (n_perm * len(forest.value.roots)))
        for whole in batches:
            for a in range(0, len(whole), step):
                batch = whole.slice(a, step)
                n = len(batch)
                numbers = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "_b", "_r")}
                x = np.repeat(numbers["x"].astype(float).reshape(n, nf), n_perm, axis=0)
                order = np.argsort(numbers["_r"].reshape(n * n_perm, nf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(1, nf + 1)[None, :], axis=1)
                found = forest.value.marginals(x, zs[numbers["_b"]], place)
                each = np.take_along_axis(found, place, axis=1).reshape(n, n_perm, nf).mean(axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, n * nf + 1, nf, dtype=np.int32), pa.array(each.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*key, "x"]), lists, pa.array(found[:, 0].reshape(n, n_perm).mean(axis=1))], [*key, "x", "a", "expected_value"])

    schema = T.StructType([*[inst.schema[c] for c in [*key, "x"]], T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("expected_value", T.DoubleType())])
    return s.mapInArrow(explain, schema)
