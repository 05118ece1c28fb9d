"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are turned by a random rotation and cut into halves, each with its
own codebook (k-means on a bounded sample); the product of the codebooks is a
grid of cells.  A vector lives in its nearest cell and visits every cell whose
center is at most ``slack`` farther than its own.  There is no multi-sequence
traversal: a plain test of the distance to all cells finds the same set that a
traversal up to that limit would visit.  ``slack`` is what the target recall
needs, measured on vectors moved to the very threshold and on the true links
of a bounded sample.  Cells with one first half form a row of the grid; rows
are cut into blocks of bounded size and their visitors into chunks, so a hot
cell is many tasks.  Cosines are verified in double precision.

Equal vectors are one class.  A pair is met where either end visits the
other's cell and counted once for each end.  Blocks hand on counts, and links
that connect what they found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import vectors as V
from ledgerlens.llm.common import shuffle_partitions, stored
from ledgerlens.llm.components import components

#: Bounds of what the codebooks and the slack are fitted on, and of a codebook.
SAMPLE, MEASURED, CODES = 8192, 256, 64
TARGET = 0.9995
CHUNK = 8192
#: Cosines this near the threshold in single precision are computed anew in double.
NEAR = 1e-5
LINKS = "node long, n long, to long"


class Grid:
    """Codebooks of both halves, and how far vectors visit."""

    def __init__(self, unit: np.ndarray, codes: int):
        self.dim = unit.shape[1]
        self.turn, self.half = V.rotation(self.dim, 23), self.dim // 2
        y = unit @ self.turn
        self.books = [V.kmeans(y[:, : self.half], codes), V.kmeans(y[:, self.half:], codes)]
        self.slack = 0.0

    def squares(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its codebook; a cell's is the sum of its two."""
        y = unit @ self.turn
        return V.distances(y[:, : self.half], self.books[0]), V.distances(y[:, self.half:], self.books[1])

    def limit(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Squared distance up to which cells are visited; their own cell always is."""
        return (np.sqrt(d1.min(1) + d2.min(1)) + self.slack + 1e-9) ** 2

    def needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slack with which each pair of rows is met, from the end that needs less."""
        out = []
        for a, b in ((x, y), (y, x)):
            (a1, a2), (b1, b2) = self.squares(a), self.squares(b)
            r = np.arange(len(a))
            out.append(np.sqrt(a1[r, b1.argmin(1)] + a2[r, b2.argmin(1)]) - np.sqrt(a1.min(1) + a2.min(1)))
        return np.minimum(*out)

    def fit_slack(self, unit: np.ndarray, least: float, links: np.ndarray) -> None:
        """``links``: slack that true links of the sample need.  Neighbours at the threshold in random directions are made."""
        rng = np.random.default_rng(31)
        x = unit[rng.integers(0, len(unit), 20_000)]
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        if x.shape[1] > 1:
            away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
        need = [self.needed(x, least * x + np.sqrt(1 - least * least) * away), links]
        self.slack = float(max(np.quantile(n, TARGET) if len(n) else 0.0 for n in need))


def _true_links(batches: Iterator[pa.RecordBatch], grid: Grid, q: np.ndarray, least: float, kind: str) -> Iterator[pa.RecordBatch]:
    """For each measured vector and task, the largest slack that one of its links needs."""
    most = np.full(len(q), -1.0)
    for batch in batches:
        u = V.units(V.matrix(batch.column("x"), kind, grid.dim))
        for a in range(0, len(u), 4096):
            i, j = np.nonzero(q @ u[a: a + 4096].T >= least)
            for c in range(0, len(i), 1 << 14):
                s = slice(c, c + (1 << 14))
                np.maximum.at(most, i[s], grid.needed(q[i[s]], u[a + j[s]]))
    yield pa.RecordBatch.from_pydict({"need": most[most >= 0]}, schema=pa.schema([("need", pa.float64())]))


def _rows(batches: Iterator[pa.RecordBatch], grid: Grid, kind: str, visits: bool) -> Iterator[pa.RecordBatch]:
    """A vector at its own row of the grid, or at each row with a cell that it visits."""
    for batch in batches:
        for a in range(0, len(batch), 2048):
            rows = batch.slice(a, 2048)
            d1, d2 = grid.squares(V.units(V.matrix(rows.column("x"), kind, grid.dim)))
            if visits:
                at, row = np.nonzero(d1 + d2.min(1)[:, None] <= grid.limit(d1, d2)[:, None])
            else:
                at, row = np.arange(len(rows)), d1.argmin(1)
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(at)) for c in ("node", "x", "copies")), pa.array(row.astype(np.int32))], ["node", "x", "copies", "row"])


def _joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """For each node of a block, the smallest node that the links of the block lead to."""
    x, y = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    links = linked[np.ix_(x, y)]
    lx, ly, far = left[x].copy(), right[y].copy(), np.iinfo(np.int64).max
    while True:
        ny = np.minimum(ly, np.where(links, lx[:, None], far).min(0, initial=far))
        nx = np.minimum(lx, np.where(links, ny, far).min(1, initial=far))
        if (nx == lx).all() and (ny == ly).all():
            return list({*zip(left[x].tolist(), lx.tolist()), *zip(right[y].tolist(), ly.tolist())})
        lx, ly = nx, ny


def meet(home: dict, guests: dict, grid: Grid, row: int, least: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links between the vectors of one block and its visitors: counts by node, and connecting links."""
    hu, gu = V.units(home["x"]), V.units(guests["x"])
    (h1, h2), (g1, g2) = grid.squares(hu), grid.squares(gu)
    cell, hlim, glim = h2.argmin(1), grid.limit(h1, h2), grid.limit(g1, g2)
    own1, own2 = g1.argmin(1), g2.argmin(1)
    counts: dict[int, int] = {}
    pairs: list[tuple[int, int]] = []
    for j in np.unique(cell):
        h = np.flatnonzero(cell == j)
        g = np.flatnonzero(g1[:, row] + g2[:, j] <= glim)
        for a in range(0, len(g), 1024):
            some = g[a: a + 1024]
            s = gu[some].astype(np.float32) @ hu[h].astype(np.float32).T
            linked = s >= least
            p, q = np.nonzero(np.abs(s - least) <= NEAR)
            if len(p):
                linked[p, q] = V.cosines(guests["x"][some[p]], home["x"][h[q]]) >= least
            linked &= guests["node"][some][:, None] != home["node"][h]
            if not linked.any():
                continue
            # a visitor counts its links here; a vector at home counts those of visitors that it does not visit itself
            for i, n in zip(some, linked @ home["copies"][h]):
                if n:
                    counts[int(guests["node"][i])] = counts.get(int(guests["node"][i]), 0) + int(n)
            back = h1[h][:, own1[some]].T + h2[h][:, own2[some]].T <= hlim[h]
            alone = linked & ~back
            for i, n in zip(h, guests["copies"][some] @ alone):
                if n:
                    counts[int(home["node"][i])] = counts.get(int(home["node"][i]), 0) + int(n)
            pairs += _joined(linked, guests["node"][some], home["node"][h])
    return counts, pairs


def near_duplicates(df: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable) and kept, a row for each row.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components link
    with nothing.  Repeated rows are vectors of their own that link; rows of one id share their component.
    Rows without id have no links and no component, and are kept.
    """
    spark = df.sparkSession
    kind, dim = V.dtype(df), V.dimension(df)
    all_ids = df.select(F.col("vec_id").cast("long").alias("vec_id"))
    if dim < 2:  # halves need two components; of one, only the sign counts
        return _small(df, all_ids, dim, kind)
    rows = stored(V.usable(df, dim, kind), "vectors")
    # a class has a key of its own, as one id may have several vectors
    classes = stored(rows.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("x")), "classes")
    total = classes.count()
    unit = V.sample(classes.select(F.col("least").alias("vec_id"), "x"), total, SAMPLE, kind, dim)
    found = spark.createDataFrame([], LINKS)
    if total:
        grid = Grid(unit, int(min(CODES, max(1, np.sqrt(total / 32)))))
        some = unit[:: max(1, len(unit) // MEASURED)][:MEASURED]
        links = [r["need"] for r in classes.mapInArrow(partial(_true_links, grid=grid, q=some, least=least, kind=kind), "need double").collect()]
        grid.fit_slack(unit, least, np.array(links))
        found = stored(_found(classes, grid, kind, least), "links")
    counted = found.filter("to is null").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.filter("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))
    key = F.xxhash64("x")
    several = stored(rows.groupBy("vec_id").agg(F.min(key).alias("b"), F.max(key).alias("most")).filter("b < most").select("vec_id", "b"), "several")
    if several.limit(1).count():
        edges = edges.unionByName(rows.join(several, "vec_id").select(key.alias("a"), "b").filter("a <> b").distinct())
    comps = stored(components(edges), "comps")
    smallest = comps.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    at = comps.join(smallest, "component").select("node", "smallest")
    mine = classes.join(counted, "node", "left").join(at, "node", "left").select("x", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    # rows come back to their class by the vector, and rows that took no part stay alone
    linked = rows.join(mine, "x").select("vec_id", "n_links", "component_id")
    alone = all_ids.join(rows.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _found(reps: DataFrame, grid: Grid, kind: str, least: float) -> DataFrame:
    shape = "node long, x binary, copies long, row int"
    home = reps.select("node", "x", "copies").mapInArrow(partial(_rows, grid=grid, kind=kind, visits=False), shape)
    guests = reps.select("node", "x", "copies").mapInArrow(partial(_rows, grid=grid, kind=kind, visits=True), shape)
    many = len(grid.books[0])
    sizes, visits = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for df, out in ((home, sizes), (guests, visits)):
        for r in df.groupBy("row").count().collect():
            out[r["row"]] = r["count"]
    block = int(min(4096, max(256, sizes.sum() // (2 * shuffle_partitions(reps.sparkSession)))))
    of = lambda a: F.element_at(F.array(*[F.lit(int(max(1, n))) for n in a]), F.col("row") + 1)
    blocks, chunks = of(-(-sizes // block)), of(-(-visits // CHUNK))
    left = home.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    right = guests.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    keys = ["row", "block", "chunk"]

    def meeting(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        counts, pairs = {}, []
        if a.num_rows and b.num_rows:
            sides = ({"node": t.column("node").to_numpy(), "copies": t.column("copies").to_numpy(), "x": V.matrix(t.column("x"), kind, grid.dim)} for t in (a, b))
            counts, pairs = meet(*sides, grid, key[0].as_py(), least)
        pairs = list(set(pairs))
        return pa.table({"node": [*counts, *(p[0] for p in pairs)], "n": [*counts.values(), *[None] * len(pairs)], "to": [*[None] * len(counts), *(p[1] for p in pairs)]},
                        schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("to", pa.int64())]))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meeting, LINKS)


def _small(df: DataFrame, all_ids: DataFrame, dim: int, kind: str) -> DataFrame:
    """Vectors of no or one component: those of one sign are one group."""
    if not dim:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sign = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when((F.size("embedding") == 1) & F.col("vec_id").isNotNull() & ~F.isnan(F.element_at("embedding", 1)) & (F.abs(F.element_at("embedding", 1)) != float("inf")), F.signum(F.element_at("embedding", 1))).alias("sign"))
    groups = sign.filter("sign <> 0").groupBy("sign").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return sign.join(F.broadcast(groups), "sign", "left").select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
