"""Fixity audit of WARC replicas by Merkle trees over byte ranges.

A replica is a listing of records by file and offset.  A leaf is the SHA-256 of
a record's bytes.  Offsets are cut into ranges of ``RANGE`` bytes, these into ranges
``FAN`` times as long, and so on to the file; a node's hash covers its
children in order, and the archive's root covers its files.  Two replicas are
compared from the top: only children of nodes that differ are looked at, down
to the records, which tells where bytes were altered, lost or added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

#: Bytes of the lowest ranges, how many of them one above holds, and levels of ranges below the file.
RANGE, FAN, LEVELS = 1 << 16, 16, 4


def record(uri: Column, payload: Column) -> Column:
    """A WARC resource record, as bytes: header lines, an empty line, the payload, two line ends."""
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def hashed(replica: DataFrame) -> DataFrame:
    """(file, offset, length, hash) of a listing (file, offset, record); a null record is an empty one."""
    return replica.select("file", "offset", F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"), F.sha2(F.coalesce("record", F.lit(bytearray())), 256).alias("hash"))


def leaves(records: DataFrame) -> DataFrame:
    """One (file, offset, length, hash) for each place.  Records that share a place are one leaf, over
    their hashes in order and how often each occurs; those without file or offset are left out."""
    # copies of one record are counted before the shuffle, so a hot place stays small
    counted = records.filter("file is not null and offset is not null").groupBy("file", "offset", "length", "hash").agg(F.count("*").alias("copies"))
    places = counted.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("hash", "length", "copies"))).alias("all"))
    several = F.sha2(F.concat_ws(",", F.transform("all", lambda r: F.concat_ws(":", r["hash"], r["copies"].cast("string")))), 256)
    alone = (F.size("all") == 1) & (F.col("all")[0]["copies"] == 1)
    return places.select("file", "offset", F.col("all")[0]["length"].alias("length"), F.when(alone, F.col("all")[0]["hash"]).otherwise(several).alias("hash"))


def _above(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("hash").alias("h"))))
    return nodes.groupBy(*keys).agg(children.alias("c")).select(*keys, F.sha2(F.concat_ws(",", F.transform("c", lambda c: F.concat_ws(":", c["o"].cast("string"), c["h"]))), 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of a replica's tree over its ``leaves``: [records, ranges ..., files, root].  A range's key is its
    number: offset divided by its length."""
    levels = [records.withColumn("r0", F.floor(F.col("offset") / RANGE).cast("long"))]
    low = _above(levels[0], ["file", "r0"], "offset")
    for k in range(1, LEVELS):
        low = low.withColumn(f"r{k}", F.floor(F.col(f"r{k - 1}") / FAN).cast("long"))
        levels.append(low)
        low = _above(low, ["file", f"r{k}"], f"r{k - 1}")
    levels.append(low)
    files = _above(low, ["file"], f"r{LEVELS - 1}")
    levels.append(files)
    # the root covers a row for each file, in 256 groups by name first, so no task gathers them all
    groups = _above(files.withColumn("g", F.conv(F.substring(F.sha2("file", 256), 1, 2), 16, 10).cast("int")), ["g"], "file")
    levels.append(_above(groups.withColumn("root", F.lit(0)), ["root"], "g"))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str], parents: DataFrame | None, on: list[str]) -> DataFrame:
    """Keys (and both hashes) of nodes under differing parents that are not the same in both replicas."""
    if parents is not None:
        a, b = (x.join(parents.select(*on), on, "left_semi") for x in (a, b))
    extra = [c for c in a.columns if c not in (*keys, "hash")]
    left = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in extra), F.col("hash").alias("hash_a"))
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in extra), F.col("hash").alias("hash_b"))
    out = left.join(right, keys, "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(f"{c}_a", f"{c}_b")).drop(f"{c}_a", f"{c}_b"), [c for c in extra if c != "length"], out)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replica ``b`` differs from ``a`` (both as ``hashed`` gives them).

    file, offset, length (of a's record, or else b's), state (altered, missing or added in b), both
    hashes, and the roots of both replicas.  Equal replicas, empty ones included, give no row.
    """
    one, two = (tree(stored(leaves(x), "leaves")) for x in (a, b))
    one, two = ([*(stored(x, "nodes") if 0 < i else x for i, x in enumerate(t))] for t in (one, two))
    roots = [x[-1].select("hash") for x in (one, two)]
    parents = _differing(one[-2], two[-2], ["file"], None, [])
    on = ["file"]
    for k in range(LEVELS - 1, -1, -1):
        keys = ["file", f"r{k}"]
        parents = _differing(one[k + 1], two[k + 1], keys, parents, on)
        on = keys
    found = _differing(one[0], two[0], ["file", "offset"], parents, on)
    state = F.when(F.col("hash_a").isNull(), "added").when(F.col("hash_b").isNull(), "missing").otherwise("altered")
    return found.select("file", "offset", F.coalesce("length_a", "length_b").alias("length"), state.alias("state"), "hash_a", "hash_b", roots[0].scalar().alias("root_a"), roots[1].scalar().alias("root_b"))
