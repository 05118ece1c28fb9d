"""Registered fuzzy-matching queries (JON-7, JON-8, JON-9, CLN-3).

DuckDB has no token-sort ratio.  Inside blocks, where pairs are few, the SQL
spells the longest common subsequence out; over all names tests compare with
brute force on fixtures (tests/test_fuzzy.py).
"""

from pyspark.sql import functions as F

from ledgerlens.operators import fuzzy as FZ
from ledgerlens.plans.oracle_fixtures import EY, with_
from ledgerlens.plans.registry import register
from ledgerlens.sources import fixtures as fx
from ledgerlens.sources.tables import table


def _names(spark, sf):
    return fx.entity_year(spark, sf).select(F.col("entity_name").alias("name")).distinct()


@register("jon_similar_names")
def q_similar_names(spark, sf):
    """JON-7: all entity-name pairs with token-sort ratio >= 85 (exact prefix-filter join)."""
    return FZ.similar_pairs(_names(spark, sf), 85)


_NORM = ("array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(lower(name), '[^\\x00-\\x7F]', '', 'g'), "
         "'[^a-zA-Z0-9_]', ' ', 'g'), ' '), lambda x: x <> '')), ' ')")
_BLOCKED = f"""n AS (SELECT name, region, entity_type, {_NORM} AS norm FROM (SELECT DISTINCT entity_name AS name, region, entity_type FROM ey)),
p AS (SELECT a.name AS name_a, b.name AS name_b, region, entity_type, a.norm AS na, b.norm AS nb FROM n a JOIN n b USING (region, entity_type)
  WHERE a.name < b.name AND length(a.norm) > 0 AND length(b.norm) > 0),
lcs AS (SELECT *, 0 AS i, list_transform(range(length(nb)), lambda x: 0) AS dp FROM p
  UNION ALL SELECT name_a, name_b, region, entity_type, na, nb, i + 1, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j]))
  FROM (SELECT *, list_transform(range(1, length(nb) + 1), lambda k: CASE WHEN nb[k] = na[i + 1] THEN (CASE WHEN k > 1 THEN dp[k - 1] ELSE 0 END) + 1 ELSE dp[k] END) AS t
    FROM lcs WHERE i < length(na)) z)"""


@register("jon_similar_names_blocked", with_(EY).replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_BLOCKED}
SELECT name_a, name_b, region, entity_type, CAST(round_even(100 * (2.0 * dp[-1] / (length(na) + length(nb))), 0) AS INT) AS score
FROM lcs WHERE i = length(na) AND round_even(100 * (2.0 * dp[-1] / (length(na) + length(nb))), 0) >= 90""")
def q_similar_names_blocked(spark, sf):
    """JON-7: entity-name pairs of one region and type with token-sort ratio >= 90."""
    n = fx.entity_year(spark, sf).select(F.col("entity_name").alias("name"), "region", "entity_type")
    return FZ.similar_pairs(n, 90, block=["region", "entity_type"])


@register("jon_cluster_names")
def q_cluster_names(spark, sf):
    """JON-8: greedy star clusters of similar entity names."""
    return FZ.cluster_similar_names(_names(spark, sf), 85)


@register("cln_standardize_names")
def q_standardize_names(spark, sf):
    """CLN-3: entity names replaced by their cluster's canonical name."""
    ey = fx.entity_year(spark, sf).select("entity_name", "year", "revenue")
    return FZ.standardize_names(ey, "entity_name", 85)


@register("jon_best_match")
def q_best_match(spark, sf):
    """JON-9: best match (>= 80) of each entity name among the raw customer names."""
    left = fx.entity_year(spark, sf).select(F.col("entity_name").alias("name")).distinct()
    right = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return FZ.best_match(left, right, 80)
