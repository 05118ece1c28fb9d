"""Product codes of vectors: member-resident Lloyd rounds over vector parts.

Components become integers floor(256 * x) and a vector is cut into equal
parts, one for each position.  Every part is a row that lives with its owner,
the partition of its (position, entry, salt); the salt splits entries that many
parts share.  A round has two steps.  The owners add up their resident
members, and the sums of an entry over its salts give its new components
(exactly, floored).  Then the owners assign their members anew: parts that keep
their entry stay in the owner's files as they are, and only those that change
it go through the next shuffle to their new owners.  The driver holds the
codebooks alone.

Vectors that are null or hold null or non-finite components take no part, and
neither do those of another length than most (the smaller of equals).  Null ids
come last and equal ids in the order of their components where codebooks
start; repeated rows are vectors of their own; extra columns are ignored; an
empty table gives no row.  Without a label column all labels count as null.
With fewer vectors than entries the codebooks are that much smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import dropped, stored
from ledgerlens.llm.quantized import lists, matrix, whole_vectors
from ledgerlens.session import scratch_path

#: Members of one owner at most on average, even if one entry had all parts of its position; and the least number of salts.
OWNER_ROWS, LEAST_SALTS = 65_536, 8
#: Labels up to which their sums are handed to all tasks.
FEW_LABELS = 100_000
#: Rows that are compared at once.
ROWS = 8192
PARTS = "row long, position int, entry int, part array<int>"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (ties to the lower index) and its exact squared distance."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - book[:, k]
        d += step * step
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near]


def _first(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parts of whole vectors, each with its first entry."""
    positions, _, width = books.shape
    for whole in batches:
        for a in range(0, len(whole), ROWS):
            batch = whole.slice(a, ROWS)
            x = matrix(batch.column("q"), positions * width)
            for p in range(positions):
                part = np.ascontiguousarray(x[:, p * width: (p + 1) * width])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(x), p, np.int32)), pa.array(nearest(part, books[p])[0], pa.int32()), lists(part, pa.int32())], ["row", "position", "entry", "part"])


def _judged(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Resident parts with their nearest entries and distances now."""
    for whole in batches:
        for a in range(0, len(whole), ROWS):
            batch = whole.slice(a, ROWS)
            x, position = matrix(batch.column("part"), books.shape[2]), np.asarray(batch.column("position"))
            near, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                near[rows], best[rows] = nearest(x[rows], books[p])
            yield batch, near, best


def _reassigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, near, _ in _judged(batches, books):
        moved = near != np.asarray(batch.column("entry"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("position"), pa.array(near, pa.int32()), batch.column("part"), pa.array(moved)], ["row", "position", "entry", "part", "moved"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, near, best in _judged(batches, books):
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("position"), pa.array(near, pa.int32()), pa.array(best)], ["row", "position", "entry", "distance"])


def _updated(books: np.ndarray, residents: DataFrame) -> np.ndarray:
    """New codebooks from the owners' sums: one row for each entry in use reaches the driver."""
    width, books = books.shape[2], books.copy()
    sums = residents.groupBy("position", "entry").agg(F.count("*").alias("n"), *[F.sum(F.col("part")[i].cast("long")).alias(f"t{i}") for i in range(width)])
    for r in sums.collect():
        books[r["position"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def _to_owners(parts: DataFrame, salts: int) -> DataFrame:
    return parts.repartition("position", "entry", F.pmod(F.xxhash64("row"), F.lit(salts)))


def _migrated(residents: DataFrame, books: np.ndarray, salts: int) -> tuple[DataFrame, DataFrame]:
    """Residents of the next round in two tables: those who stay, written where they are, and those who moved."""
    spark = residents.sparkSession
    path = scratch_path(spark, f"judged-{uuid4().hex}")
    residents.mapInArrow(partial(_reassigned, books=books), f"{PARTS}, moved boolean").write.mode("overwrite").partitionBy("moved").parquet(path)
    judged = spark.read.schema(f"{PARTS}, moved boolean").parquet(path)
    moved = stored(_to_owners(judged.filter("moved").drop("moved"), salts), "movers")
    return judged.filter("not moved").drop("moved"), moved


def codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", column: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits of each part's entry), error, label_error and codebooks_sha256 of every usable vector.

    Codebooks start as the parts of the ``entries`` smallest ids, 256 at most.  A table whose vectors cannot
    be cut into ``parts`` equal parts is an error."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    label = F.col(label_col) if label_col in df.columns else F.lit(None).cast("int")
    kept = whole_vectors(df, F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), column=column)
    rows = stored(kept, "integers")
    sizes = rows.groupBy(F.size("q").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    size = sizes[0]["size"]
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    rows, width = rows.filter(F.size("q") == size), size // parts
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # one row for each entry
    books = np.array([r["q"] for r in start], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    salts = max(LEAST_SALTS, -(-rows.count() // OWNER_ROWS))
    residents = stored(_to_owners(rows.select("row", "q").mapInArrow(partial(_first, books=books), PARTS), salts), "residents")
    tables = [residents]
    for left in range(rounds - 1, -1, -1):
        books = _updated(books, residents)
        if left:
            stay, moved = _migrated(residents, books, salts)
            residents = stay.unionByName(moved)
            dropped(*tables)
            tables = [stay, moved]
    found = residents.mapInArrow(partial(_coded, books=books), "row long, position int, entry int, distance long")
    none = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes[1:]]
    owned = found.select("*", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(rows.schema["label"].dataType).alias("label"))
    whole = owned.unionByName(rows.select("row", *none, "vec_id", "label")).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("distance").alias("error"),
        *[F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)])
    code = F.concat(*[F.lower(F.lpad(F.hex(f"e{p}"), 2, "0")) for p in range(parts)])
    coded = stored(whole.select("vec_id", "label", code.alias("code"), "error"), "codes")
    dropped(rows, *tables)
    sums = stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    few = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.alias("c").join(few.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
