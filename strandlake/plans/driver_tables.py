"""Transcripts drawn from the order tables, so that the operators run on any scale of them.

An order is a transcript and its line numbers are exons; 50 orders share a stretch of a contig. Every third
order belongs to the reference annotation. The other orders are observed, and so is every second
reference transcript under another name. The order's status is the sample and its priority the tool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.structure import with_identity, with_shape

ASSEMBLY = "sha256:driver"


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    start = (F.floor(k / 50) * 10_000 + F.col("l_linenumber") * 1000 + F.min("l_partkey") % 500).cast("long")
    exons = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(start.alias("s"), (start + 1 + F.min("l_suppkey") % 300).cast("long").alias("e"))
    rows = exons.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))).alias("exons"))
    rows = rows.select(
        k.alias("k"),
        F.concat(F.lit("t"), k).alias("transcript_id"),
        F.when(k % 11 != 0, F.concat(F.lit("g"), F.floor(k / 60))).alias("gene_id"),
        F.concat(F.lit("chr"), k % 5).alias("contig"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
        "exons",
    )
    return with_identity(with_shape(rows), ASSEMBLY).withColumns({"form_id": F.col("form.public_id"), "chain_id": F.col("splice_chain.public_id")})


def reference(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: transcripts(), if they are stored."""
    return (transcripts(spark, d) if rows is None else rows).filter("k % 3 = 0")


def observed(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    t = transcripts(spark, d) if rows is None else rows
    seen = t.filter("k % 3 <> 0").withColumn("query_id", F.col("transcript_id"))
    again = t.filter("k % 6 = 0").withColumn("query_id", F.concat(F.lit("q"), "k"))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("sample"), F.col("o_orderpriority").alias("tool"))
    return seen.unionByName(again).withColumn("transcript_id", F.col("query_id")).join(orders, "k", "left")


#: The same in SQL: tables tx, ref, obs.
SQL = """
WITH ex AS (
  SELECT l_orderkey AS k, (l_orderkey // 50) * 10000 + l_linenumber * 1000 + min(l_partkey) % 500 AS s,
         (l_orderkey // 50) * 10000 + l_linenumber * 1000 + min(l_partkey) % 500 + 1 + min(l_suppkey) % 300 AS e
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), gaps AS (
  SELECT k, s, e, lead(s) OVER (PARTITION BY k ORDER BY s) AS next_s FROM ex
), shape AS (
  SELECT k, 't' || k AS transcript_id, CASE WHEN k % 11 <> 0 THEN 'g' || (k // 60) END AS gene_id, 'chr' || (k % 5) AS contig,
         CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, min(s) AS tx_start, max(e) AS tx_end, count(*) AS exon_count,
         sum(e - s + 1) AS exon_bases,
         string_agg(CASE WHEN next_s IS NOT NULL THEN '[' || (e + 1) || ',' || (next_s - 1) || ']' END, ',' ORDER BY CASE WHEN k % 2 = 0 THEN s ELSE -s END) AS gaps,
         string_agg(s || '-' || e, ',' ORDER BY s) AS exon_list
  FROM gaps GROUP BY k
), coded AS (
  SELECT *, CASE WHEN strand = '+' THEN tx_start ELSE tx_end END AS tss, CASE WHEN strand = '+' THEN tx_end ELSE tx_start END AS tes,
    ',"assembly":"sha256:driver","contig":"' || contig || '"' AS common FROM shape
), json AS (
  SELECT *, CASE WHEN exon_count = 1 THEN '{"algorithm":"SE1"' || common || ',"end":' || tx_end || ',"start":' || tx_start || ',"strand":"' || strand || '"}'
    ELSE '{"algorithm":"TF1"' || common || ',"introns":[' || gaps || '],"strand":"' || strand || '","tes":' || tes || ',"tss":' || tss || '}' END AS form_json,
    CASE WHEN exon_count > 1 THEN '{"algorithm":"SC1"' || common || ',"introns":[' || gaps || '],"strand":"' || strand || '"}' END AS chain_json FROM coded
), tx AS (
  SELECT *, 'txid:' || (CASE WHEN exon_count = 1 THEN 'SE1.' ELSE 'TF1.' END) || substr(sha256(form_json), 1, 24) AS form_id,
    'txid:SC1.' || substr(sha256(chain_json), 1, 24) AS chain_id FROM json
), ref AS (
  SELECT * FROM tx WHERE k % 3 = 0
), obs AS (
  SELECT q.*, o_orderstatus AS sample, o_orderpriority AS tool FROM (
    SELECT *, transcript_id AS query_id FROM tx WHERE k % 3 <> 0 UNION ALL
    SELECT * REPLACE ('q' || k AS transcript_id), 'q' || k AS query_id FROM tx WHERE k % 6 = 0
  ) q LEFT JOIN orders ON o_orderkey = k
), spans AS (
  SELECT gene_id, contig, strand, min(tx_start) AS s, max(tx_end) AS e FROM ref WHERE gene_id IS NOT NULL GROUP BY ALL
), hit AS (
  SELECT query_id, ref.gene_id, ref.transcript_id, row_number() OVER (PARTITION BY query_id ORDER BY ref.transcript_id <> obs.transcript_id, ref.transcript_id, coalesce(ref.gene_id, '')) AS rn
  FROM obs JOIN ref USING (form_id)
), exact AS (
  SELECT query_id, min(gene_id) FILTER (rn = 1) AS gene_id, min(transcript_id) FILTER (rn = 1) AS transcript_id, coalesce(string_agg(DISTINCT gene_id, ',' ORDER BY gene_id), '') AS candidates FROM hit GROUP BY query_id
), near AS (
  SELECT query_id, count(DISTINCT spans.gene_id) AS n, string_agg(DISTINCT spans.gene_id, ',' ORDER BY spans.gene_id) AS candidates
  FROM obs JOIN spans ON spans.contig = obs.contig AND spans.strand = obs.strand AND tx_start <= e AND s <= tx_end
  WHERE query_id NOT IN (SELECT query_id FROM exact) GROUP BY query_id
), classified AS (
  SELECT obs.*, CASE WHEN exact.query_id IS NOT NULL THEN 'known' WHEN n = 1 THEN 'novel_in_known_gene' WHEN n > 1 THEN 'ambiguous_gene' ELSE 'new_locus' END AS label,
    CASE WHEN exact.query_id IS NOT NULL THEN exact.gene_id WHEN n = 1 THEN near.candidates END AS output_gene_id,
    CASE WHEN exact.query_id IS NOT NULL THEN exact.transcript_id ELSE form_id END AS output_transcript_id,
    coalesce(exact.candidates, near.candidates, '') AS gene_candidates
  FROM obs LEFT JOIN exact USING (query_id) LEFT JOIN near USING (query_id)
)
"""
