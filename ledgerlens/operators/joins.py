"""Relational joins (JON-1..5, 10..13).

Dictionary-sized sides are broadcast only behind a bound: a row count fixed by
the operator (a top-k), a count (``broadcast_if_few``), or AQE's size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DETAIL_SCHEMA = "k INT"
#: Rows up to which a counted side is handed to every task.
FEW_ROWS = 100_000


def broadcast_if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, so
    that the other side need not be shuffled; else as it is, for AQE."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_or_merge(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """``broadcast_if_few`` for a side whose files are much smaller than its
    rows (packed, exploded or grouped): if there are many, a merge hint keeps
    Spark from a broadcast by the size of these files, before AQE measures."""
    few = broadcast_if_few(df, rows)
    return few.hint("merge") if few is df else few


def recent_predictions(pred: DataFrame, users: DataFrame, entity: str | None = None, limit: int = 100) -> DataFrame:
    """JON-1: predictions left-joined to their creator, optional entity
    filter, newest first (id breaks ties), ``limit`` rows.  The top-k is
    taken before the join (the join cannot drop or add prediction rows), so
    the join sees at most ``limit`` rows -- a bounded broadcast."""
    p = pred if entity is None else pred.filter(F.col("entity_name") == entity)
    top = p.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    u = users.select(F.col("id").alias("_uid"), F.col("username").alias("created_by_username"))
    joined = u.join(F.broadcast(top), top.created_by == u._uid, "right")  # the outer side of a join cannot be broadcast
    return joined.select(*[top[c] for c in top.columns], "created_by_username")


def recent_activity(log: DataFrame, users: DataFrame, user_id=None, limit: int = 100,
                    details_schema: str = DETAIL_SCHEMA) -> DataFrame:
    """JON-2: activity left-joined to users, optional user filter, newest
    first, ``limit`` rows, JSON details parsed."""
    a = log if user_id is None else log.filter(F.col("user_id") == user_id)
    top = a.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    u = users.select(F.col("id").alias("_uid"), "username", "role")
    joined = u.join(F.broadcast(top), top.user_id == u._uid, "right")
    j = joined.select(*[top[c] for c in top.columns], u["username"], u["role"])
    return j.withColumn("details_parsed", F.from_json("details", details_schema))


def apply_mapping(df: DataFrame, mapping: DataFrame, col: str, key: str = "from", value: str = "to") -> DataFrame:
    """JON-3: dictionary lookup; unmatched values keep the original.  A
    dictionary that a count shows to be small is broadcast, so the table
    itself does not move."""
    m = broadcast_if_few(mapping.select(F.col(key).alias("_k"), F.col(value).alias("_v")))
    j = df.join(m, df[col] == m._k, "left")
    return j.withColumn(col, F.coalesce("_v", F.col(col))).drop("_k", "_v")


def semi_filter(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """JON-4: rows whose key is in ``keys`` (EXISTS)."""
    return df.join(keys, on, "left_semi")


def anti_filter(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """JON-4: rows whose key is not in ``keys`` (NOT EXISTS)."""
    return df.join(keys, on, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str = "config_key",
           value: str = "config_value", desc: str = "description") -> DataFrame:
    """JON-11: keyed upsert into a new snapshot: the update's value wins;
    the old description survives when the update's is NULL."""
    b = base.select(key, F.col(value).alias("_bv"), F.col(desc).alias("_bd"))
    u = updates.select(key, F.col(value).alias("_uv"), F.col(desc).alias("_ud"), F.lit(True).alias("_u"))
    j = b.join(u, key, "full_outer")
    return j.select(key, F.when(F.col("_u"), F.col("_uv")).otherwise(F.col("_bv")).alias(value),
                    F.coalesce("_ud", "_bd").alias(desc))


def insert_missing(base: DataFrame, new: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """JON-12: insert rows whose key is absent (anti join + union)."""
    return base.unionByName(new.join(base.select(key), key, "left_anti"))


def write_snapshot(df: DataFrame, path: str, key: str, buckets: int = 64) -> str:
    """A keyed table in folders by a hash of its key, for ``merge_snapshot``."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def merge_snapshot(spark, path: str, changes: DataFrame, merge, key: str, buckets: int = 64) -> str:
    """``merge(base, changes)`` for the keys of ``changes``, in place: only the
    folders that hold a changed key are read and written again (dynamic
    partition overwrite); all others stay as they are, file for file.
    ``buckets`` is the number that ``write_snapshot`` was given."""
    from ledgerlens.session import materialize
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    changes = materialize(changes.withColumn("bucket", bucket), "changes")
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]     # at most ``buckets`` numbers
    base = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = materialize(merge(base, changes.drop("bucket")).withColumn("bucket", bucket), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return path


def append_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """JON-13: column-wise concat of frames aligned on a row key."""
    return left.join(right, list(key), "inner")


def peer_comparison(df: DataFrame, type_col: str = "inferred_type", exp_col: str = "total_expenditure",
                    rev_col: str = "total_revenue", entity: str = "entity_name", min_peers: int = 5,
                    fallback: int = 20, cap: int = 15) -> DataFrame:
    """JON-10: peers of every entity at once, with each peer's metrics.

    Same-type peers (other entities of the entity's inferred type, in name
    order) when there are at least ``min_peers``; otherwise the ``fallback``
    largest entities by total expenditure (minus itself).  At most ``cap``,
    after the entity's own row (basis 'self', rank 0).

    Bounded expansion: an entity can only ever use the first ``cap + 1``
    names of its type (itself removed), so only those per type are kept
    (``row_number <= cap + 1`` runs as a window group limit) and each entity
    meets at most ``cap + 1`` partners.  The fallback list is a top-k
    (<= ``fallback`` rows) handed over as one scalar-subquery array and
    exploded -- no cross join.
    """
    ent = (df.groupBy(entity, type_col).agg(
        F.sum(exp_col).alias("total_expenditure_sum"), F.sum("audit_flag").alias("audit_flags"),
        F.avg(F.col("audit_flag").cast("double")).alias("audit_rate"), F.count(F.lit(1)).alias("years_active"),
        F.max_by(F.struct(F.col(rev_col).alias("revenue"), F.col(exp_col).alias("expenditure"),
                          F.col("total_assets").alias("assets")), "year").alias("_l")))
    ent = ent.select(entity, type_col, "total_expenditure_sum", "audit_flags", "audit_rate", "years_active",
                     F.col("_l.revenue").alias("revenue"), F.col("_l.expenditure").alias("expenditure"),
                     F.col("_l.assets").alias("assets"))
    n_type = ent.groupBy(type_col).agg(F.count(F.lit(1)).alias("_n_type"))
    me = ent.select(entity, type_col).join(n_type, type_col)
    w = Window.partitionBy(type_col).orderBy(F.asc("peer"))
    head = (ent.select(type_col, F.col(entity).alias("peer")).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= cap + 1))
    same = (me.filter(F.col("_n_type") - 1 >= min_peers).join(head, type_col)
            .filter(F.col("peer") != F.col(entity))
            .select(entity, "peer", F.col("_r").alias("_ord"), F.lit("same_type").alias("basis")))
    top = ent.orderBy(F.desc("total_expenditure_sum"), F.asc(entity)).limit(fallback)
    arr = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("total_expenditure_sum")).alias("_k"), F.col(entity).alias("peer")))).alias("a")).scalar()
    fb = (me.filter(F.col("_n_type") - 1 < min_peers)
          .select(entity, F.posexplode(arr).alias("_ord", "_p"))
          .select(entity, F.col("_p.peer").alias("peer"), "_ord", F.lit("largest").alias("basis"))
          .filter(F.col("peer") != F.col(entity)))
    pairs = same.unionByName(fb)
    w2 = Window.partitionBy(entity).orderBy("_ord")
    pairs = (pairs.withColumn("peer_rank", F.row_number().over(w2).cast("long"))
             .filter(F.col("peer_rank") <= cap).drop("_ord"))
    own = ent.select(entity, F.col(entity).alias("peer"), F.lit("self").alias("basis"), F.lit(0).cast("long").alias("peer_rank"))
    pairs = pairs.unionByName(own)
    metrics = ent.select(F.col(entity).alias("peer"), F.col(type_col).alias("peer_type"), "revenue", "expenditure",
                         "assets", "audit_flags", "audit_rate", "years_active")
    return pairs.join(metrics, "peer")
