"""Registered queries of the operators: thin readers of whole tables that derive the result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import oracles
from ledgerlens.llm.common import prepare, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op3_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from ledgerlens.llm import bpe_transducer as B
    path, docs = public_tokenizers.path("byte_bpe_50k.json"), table(spark, sf_dir, "documents")
    both = B.round_trip(docs, path, B.build_lexicon(docs, path))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    from ledgerlens.llm import token_files as T
    folder, _ = T.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return T.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens that all documents fill."""
    from ledgerlens.llm import packing as K
    pieces = K.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of three-word shingles, similarity 0.85."""
    from ledgerlens.llm import hamming_dedup as H
    return H.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op5_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    from ledgerlens.llm import toxicity_knn as X
    from ledgerlens.llm.common import crc_mod
    scored = X.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "similarity")


@query
def op7_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from ledgerlens.llm import lang_gru as G
    docs = table(spark, sf_dir, "documents")
    return G.predict(docs, G.train(docs)).select("doc_id", G.held_out().alias("held_out"), "lang_pred", "score")


@query
def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    from ledgerlens.llm import ann_adscan as A
    return A.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    from ledgerlens.llm import multi_index_dedup as M
    return M.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from ledgerlens.llm import html_blocks as H
    return H.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op9_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of all pages as WARC files of about 512 records.  In the second, pages
    whose mark is 00 have their first character overwritten and those whose mark is ff are missing."""
    from ledgerlens.llm import warc_merkle as W
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    files = max(1, -(-pages.count() // 512))
    place = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "html"))
    hurt = F.concat(F.lit("#"), F.expr("substr(html, 2)"))
    whole, altered = W.record(F.col("url"), F.col("html")), W.record(F.col("url"), F.when(F.col("place").startswith("00"), hurt).otherwise(F.col("html")))
    rows = pages.withColumn("place", place).select("place", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("hash"), F.octet_length(altered).cast("long").alias("length_b"), F.sha2(altered, 256).alias("hash_b"))
    # equal pages are counted and numbered, so that each is a record with a place of its own
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    rows = rows.withColumn("spot", F.md5(F.concat_ws("|", "place", F.col("copy").cast("string")).cast("binary")))
    rows = rows.withColumn("file", F.format_string("pages-%06d.warc", F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") % files))
    before = Window.partitionBy("file").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")), "replicas")
    second = placed.filter(~F.col("place").startswith("ff")).select("file", "offset", F.col("length_b").alias("length"), F.col("hash_b").alias("hash"))
    return W.audit(placed.select("file", "offset", "length", "hash"), second)


@query
def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after five rounds with 40 centroids."""
    from ledgerlens.llm import simplex_clusters as S
    return S.clusters(table(spark, sf_dir, "embeddings"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector: 16 parts, codebooks of 64 entries, two rounds."""
    from ledgerlens.llm import vector_codes as V
    return V.codes(table(spark, sf_dir, "embeddings"))


@query
def op13_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of all sources."""
    from ledgerlens.llm import mixing as M
    return M.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op11_simplex_clusters"], ORACLE["op12_vector_codes"], ORACLE["op13_systematic_mix"] = oracles.clusters(), oracles.codes(), oracles.MIXING

_NODES = """
{r}_n0 AS (SELECT file, offset_ // 65536 AS r0, sha256(string_agg(offset_ || ':' || hash, ',' ORDER BY offset_)) AS hash FROM {r} GROUP BY ALL),
{r}_n1 AS (SELECT file, r0 // 16 AS r1, sha256(string_agg(r0 || ':' || hash, ',' ORDER BY r0)) AS hash FROM {r}_n0 GROUP BY ALL),
{r}_n2 AS (SELECT file, r1 // 16 AS r2, sha256(string_agg(r1 || ':' || hash, ',' ORDER BY r1)) AS hash FROM {r}_n1 GROUP BY ALL),
{r}_n3 AS (SELECT file, r2 // 16 AS r3, sha256(string_agg(r2 || ':' || hash, ',' ORDER BY r2)) AS hash FROM {r}_n2 GROUP BY ALL),
{r}_f AS (SELECT file, sha256(string_agg(r3 || ':' || hash, ',' ORDER BY r3)) AS hash FROM {r}_n3 GROUP BY ALL),
{r}_g AS (SELECT ('0x' || substr(sha256(file), 1, 2))::BIGINT AS g, sha256(string_agg(file || ':' || hash, ',' ORDER BY file)) AS hash FROM {r}_f GROUP BY ALL),
{r}_root AS (SELECT sha256(string_agg(g || ':' || hash, ',' ORDER BY g)) AS hash FROM {r}_g)"""

ORACLE["op9_warc_merkle"] = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(concat_ws('|', coalesce(page_id::VARCHAR, ''), coalesce(url, ''), coalesce(html, ''))) AS place FROM pages),
h AS (SELECT *, CASE WHEN place LIKE '00%' THEN '#' || substr(html, 2) ELSE html END AS html_b FROM p),
w AS (SELECT place, md5(place || '|' || row_number() OVER (PARTITION BY place)) AS spot,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html_b) || chr(13) || chr(10) || chr(13) || chr(10) || html_b || chr(13) || chr(10) || chr(13) || chr(10) AS rec_b FROM h),
f AS (SELECT place, spot, strlen(rec) AS length, sha256(rec) AS hash, strlen(rec_b) AS length_b, sha256(rec_b) AS hash_b,
  format('pages-{{:06d}}.warc', ('0x' || substr(spot, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 511) // 512) FROM pages)) AS file FROM w),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM f),
a AS (SELECT file, offset_, length, hash FROM o),
b AS (SELECT file, offset_, length_b AS length, hash_b AS hash FROM o WHERE place NOT LIKE 'ff%'),
{_NODES.format(r="a").strip()},
{_NODES.format(r="b").strip()}
SELECT coalesce(a.file, b.file) AS file, coalesce(a.offset_, b.offset_) AS "offset", coalesce(a.length, b.length)::BIGINT AS length,
  CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'missing' ELSE 'altered' END AS state, a.hash AS hash_a, b.hash AS hash_b,
  (SELECT hash FROM a_root) AS root_a, (SELECT hash FROM b_root) AS root_b
FROM a FULL JOIN b ON a.file = b.file AND a.offset_ = b.offset_ WHERE a.hash IS DISTINCT FROM b.hash
"""
