"""Nearest neighbours by an adaptive dimension scan of probed lists.

Rows go to the list of their nearest center (k-means on a bounded sample).  A
query probes the lists of the nearest centers; how many, is measured against
brute force on a bounded sample of queries, so that the recall of the probed
lists reaches ``TARGET``.  Lists are cut into blocks of bounded size and the
queries of a list into chunks, so a hot list is many tasks.  In a block,
vectors are turned by a random rotation and scanned in blocks of columns: from
d of D squared differences the distance is estimated as D/d of their sum, and a
candidate is given up once it exceeds the bound (1 + EPSILON / sqrt(d)) * r,
r being the k-th distance found.  Scores are exact cosines of the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import vectors as V
from ledgerlens.llm.common import shuffle_partitions, stored

#: Bounds: rows that the centers are fitted on, lists, queries that the number of probes is measured on.
SAMPLE, LISTS, MEASURED = 8192, 512, 256
TARGET = 0.97
EPSILON = 2.1
COLUMNS = 16
#: Queries of a block that are scanned against its rows together, at most.
CHUNK = 1024
RESULT = "query_id long, vec_id long, score double"


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows (distinct ids, not the query's own) of each query, as (query id, id, score)."""
    dim = x.shape[1]
    u, v = (V.units(x) @ turn).astype(np.float32), (V.units(q) @ turn).astype(np.float32)
    columns = np.array_split(np.arange(dim), max(1, dim // COLUMNS))
    out: list[tuple] = []
    for a in range(0, len(q), 128):
        vq, some = v[a: a + 128], np.arange(a, min(a + 128, len(q)))
        c = columns[0]
        part = np.maximum((u[:, c] ** 2).sum(1) + (vq[:, c] ** 2).sum(1)[:, None] - 2 * vq[:, c] @ u[:, c].T, 0)
        part[qids[some][:, None] == ids] = np.inf
        first = min(len(x), 4 * k)
        seeds = np.argpartition(part, first - 1, axis=1)[:, :first]
        whole = ((vq[:, None, :] - u[seeds]) ** 2).sum(2)
        whole[np.isinf(np.take_along_axis(part, seeds, 1))] = np.inf
        # copies of one id must not tighten the bound: the k-th distance over distinct ids
        order = np.argsort(whole, axis=1, kind="stable")
        sid, sd = np.take_along_axis(ids[seeds], order, 1), np.take_along_axis(whole, order, 1)
        r = np.full(len(some), np.inf, np.float32)
        for i in range(len(some)):
            _, at = np.unique(sid[i], return_index=True)
            if len(at) >= k:
                r[i] = sd[i][np.sort(at)[k - 1]]
        r = r * np.float32(1 + 1e-5) + np.float32(1e-6)
        done = len(c)
        qi, xi = np.nonzero(part * (dim / done) <= (r * (1 + EPSILON / np.sqrt(done)) ** 2)[:, None])
        keep = np.isfinite(part[qi, xi])
        qi, xi = qi[keep], xi[keep]
        d = part[qi, xi]
        for c in columns[1:]:
            for y in range(0, len(qi), 1 << 15):
                d[y: y + (1 << 15)] += ((u[xi[y: y + (1 << 15)]][:, c] - vq[qi[y: y + (1 << 15)]][:, c]) ** 2).sum(1)
            done += len(c)
            slack = (1 + EPSILON / np.sqrt(done)) ** 2 if done < dim else 1
            live = d * (dim / done) <= r[qi] * slack
            qi, xi, d = qi[live], xi[live], d[live]
        score = np.concatenate([V.cosines(x[xi[y: y + 8192]], q[a + qi[y: y + 8192]]) for y in range(0, len(qi), 8192)]) if len(qi) else np.empty(0)
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        _, one = np.unique(np.stack([qi, ids[xi]]), axis=1, return_index=True)  # of an id's copies, the nearest
        one = np.sort(one)
        qi, xi, score = qi[one], xi[one], score[one]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < k
        out.append((qids[a + qi[top]], ids[xi[top]], score[top]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3))


def _assigned(batches: Iterator[pa.RecordBatch], centers: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = V.matrix(batch.column("x"), kind, centers.shape[1])
        near = V.distances(V.units(x), centers).argmin(1) if len(x) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "x", "list"])


def _brute(batches: Iterator[pa.RecordBatch], q: np.ndarray, qids: np.ndarray, place: np.ndarray, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of each measured query among a task's rows, with the place of their list in its order."""
    best: list[list[tuple]] = [[] for _ in qids]
    for batch in batches:
        x, ids, lists = V.matrix(batch.column("x"), kind, q.shape[1]), batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
        for a in range(0, len(x), 4096):
            s = q @ V.units(x[a: a + 4096]).T
            s[qids[:, None] == ids[a: a + 4096]] = -2
            for i in range(len(qids)):
                top = np.argpartition(-s[i], min(k, s.shape[1]) - 1)[:k]
                best[i] = sorted([*best[i], *((-s[i, j], int(ids[a + j]), int(place[i, lists[a + j]])) for j in top if s[i, j] > -2)])[:k]
    yield pa.RecordBatch.from_pydict({"q": [i for i, b in enumerate(best) for _ in b], "s": [-t[0] for b in best for t in b], "id": [t[1] for b in best for t in b], "place": [t[2] for b in best for t in b]},
                                     schema=pa.schema([("q", pa.int64()), ("s", pa.float64()), ("id", pa.int64()), ("place", pa.int64())]))


def _probes(batches: Iterator[pa.RecordBatch], centers: np.ndarray, sizes: np.ndarray, probes: int, least: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A row for each list a query probes: the nearest ``probes``, and more until they hold ``least`` rows."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            rows = batch.slice(a, 256)
            order = np.argsort(V.distances(V.units(V.matrix(rows.column("x"), kind, centers.shape[1])), centers), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) >= least).argmax(1) + 1
            enough[sizes.sum() < least] = len(sizes)
            n = np.maximum(enough, min(probes, len(centers)))
            at = np.repeat(np.arange(len(rows)), n)
            lists = np.concatenate([o[:m] for o, m in zip(order, n)])
            yield pa.RecordBatch.from_arrays([rows.column("vec_id").take(pa.array(at)), rows.column("x").take(pa.array(at)), pa.array(lists.astype(np.int32))], ["vec_id", "x", "list"])


def measured_probes(lists: DataFrame, queries: DataFrame, centers: np.ndarray, kind: str, k: int, target: float = TARGET) -> int:
    """Probes with which a bounded sample of queries finds ``target`` of its true neighbours."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toArrow()
    if not some.num_rows:
        return 1
    q, qids = V.units(V.matrix(some.column("x"), kind, centers.shape[1])), some.column("vec_id").to_numpy()
    place = np.argsort(np.argsort(V.distances(q, centers), axis=1, kind="stable"), axis=1)
    near = lists.mapInArrow(partial(_brute, q=q, qids=qids, place=place, kind=kind, k=k), "q long, s double, id long, place long")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    places = np.sort([r["place"] for r in near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("place").collect()])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else 1


def nearest(df: DataFrame, is_query: Column | None = None, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest rows found, for each query.

    Queries: rows that ``is_query`` marks (ids divisible by 50).  Vectors that are null, zero, of another
    length than most, or hold null or non-finite components, and rows without id, take no part.  Rows of
    one id are one candidate, the nearest of them, and one query, whose score with a candidate is that of
    the best of its vectors; ties go to the smaller id; an empty table gives no row.
    """
    spark = df.sparkSession
    kind, dim = V.dtype(df), V.dimension(df)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(V.usable(df, dim, kind), "vectors")
    total = rows.count()
    centers = V.kmeans(V.sample(rows, total, SAMPLE, kind, dim), int(min(LISTS, max(1, np.sqrt(total) / 2)))) if total else np.zeros((1, dim))
    lists = rows.mapInArrow(partial(_assigned, centers=centers, kind=kind), "vec_id long, x binary, list int")
    sizes = np.zeros(len(centers), np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    queries = rows.filter(is_query if is_query is not None else F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id", "x"])
    probes = measured_probes(lists, queries, centers, kind, k)
    asked = stored(queries.mapInArrow(partial(_probes, centers=centers, sizes=sizes, probes=probes, least=4 * k, kind=kind), "vec_id long, x binary, list int"), "probes")
    chunks = np.ones(len(centers), np.int64)
    for r in asked.groupBy("list").count().collect():
        chunks[r["list"]] = -(-r["count"] // CHUNK)
    block = int(min(8192, max(256, total // (2 * shuffle_partitions(spark)))))
    blocks = np.maximum(1, -(-sizes // block))
    of = lambda a: F.element_at(F.array(*[F.lit(int(n)) for n in a]), F.col("list") + 1)
    left = lists.withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), (of(chunks) - 1).cast("int"))))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "x"), of(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (of(blocks) - 1).cast("int"))))
    keys, turn = ["list", "block", "chunk"], V.rotation(dim)

    def found(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            got = scan(V.matrix(x.column("x"), kind, dim), x.column("vec_id").to_numpy(), V.matrix(q.column("x"), kind, dim), q.column("vec_id").to_numpy(), k, turn)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), got)), schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, RESULT)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
