"""DuckDB SQL of the clustering, coding and mixing queries, unrolled by round."""

from __future__ import annotations

#: Floor of the quotient of two integers, the second positive; floor(256 * x) of the usable vectors.
_MEAN = "(CASE WHEN sum({x}) % count(*) < 0 THEN sum({x}) // count(*) - 1 ELSE sum({x}) // count(*) END)::BIGINT"
_FLOORS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)"
_SQUARED = "list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def clusters(k: int = 40, rounds: int = 5, size: int = 64, seed: str = "2") -> str:
    nearest = f"SELECT rid, vec_id, q, min(struct_pack(d := {_SQUARED.format(x='q', y='v')}, c := c)) AS best FROM kept, {{c}} GROUP BY ALL"
    steps = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_FLOORS} AS q FROM embeddings WHERE len(embedding) = {size} AND {_FINITE})",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, q) - 1)::INTEGER AS c, q AS v FROM kept QUALIFY c < {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (SELECT best.c AS c, j, {_MEAN.format(x='q[j]')} AS m FROM a{i}, range(1, {size + 1}) t(j) GROUP BY ALL) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c AS c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} n ON o.c = n.c)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = best.c"""


def codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    nearest = f"SELECT p.rid, p.pos, p.x, min(struct_pack(d := {_SQUARED.format(x='p.x', y='b.v')}, e := b.e)) AS best FROM parts p JOIN {{b}} b USING (pos) GROUP BY ALL"
    steps = [f"fit AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_FLOORS} AS q FROM embeddings WHERE {_FINITE})",
             "kept AS MATERIALIZED (SELECT * FROM fit WHERE len(q) = (SELECT len(q) FROM fit GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
             f"parts AS MATERIALIZED (SELECT rid, pos, list_slice(q, pos * len(q) // {parts} + 1, (pos + 1) * len(q) // {parts}) AS x FROM kept, range({parts}) t(pos))",
             f"start AS (SELECT rid, (row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1)::INTEGER AS e FROM kept QUALIFY e < {entries})",
             "b0 AS MATERIALIZED (SELECT pos, e, x AS v FROM parts JOIN start USING (rid))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(b=f'b{i}')})")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT pos, e, list(m ORDER BY j) AS v FROM (SELECT pos, best.e AS e, j, {_MEAN.format(x='x[j]')} AS m FROM a{i}, (SELECT unnest(range(1, max(len(x)) + 1)) AS j FROM parts) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT o.pos, o.e, coalesce(n.v, o.v) AS v FROM b{i} o LEFT JOIN m{i} n ON o.pos = n.pos AND o.e = n.e)")
    return f"""WITH {', '.join(steps)},
coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (rid)"""


MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER + 1]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size / weight AS ratio FROM s),
l AS (SELECT x.ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - 2::DOUBLE * coalesce(sum(y.source_size) FILTER (y.ratio < x.ratio), 0)::DOUBLE) / sum(y.weight) FILTER (y.ratio >= x.ratio) AS level
  FROM (SELECT DISTINCT ratio FROM r) x, r y GROUP BY x.ratio),
v AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least((SELECT level FROM v) * weight, 2::DOUBLE * source_size) AS target,
  ('0x' || substr(md5('mix:' || (source IS NULL)::INTEGER || ':' || coalesce(source, '')), 1, 4))::BIGINT / 65536::DOUBLE AS u FROM s),
p AS (SELECT d.*, (row_number() OVER (PARTITION BY source ORDER BY size, ('0x' || substr(md5('doc:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id NULLS FIRST) - 1)::DOUBLE AS k FROM d),
c AS (SELECT doc_id, size, source_size, target, k, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS copies FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor((k + 1) * copies + u) - floor(k * copies + u), ceil(copies)) * size)::BIGINT AS taken FROM c
"""
