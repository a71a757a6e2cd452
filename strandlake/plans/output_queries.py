"""Registered queries of outputs, fingerprints and further metrics, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlake.functions import export, structure
from strandlake.operators import categories, metrics, plots, registry
from strandlake.operators.commands import ORDER, RANGE
from strandlake.session import stored, work_dir
from strandlake.sources import annotation, tables

from . import driver_tables as t
from .catalog_queries import _classified, query


def _assigned(spark, d):
    """Classified transcripts in the shape of stored assignments."""
    exons = F.transform("exons", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(".").alias("source"), F.lit(".").alias("score"), F.lit(".").alias("phase"), F.lit(None).cast(export.PAIRS).alias("attributes")))
    empty = {c: F.lit(None).cast("string") for c in ("fuzzy_cluster", "bridge_status")}
    out = _classified(spark, d).withColumns({"exons": exons, "attributes": F.lit(None).cast(export.PAIRS), "annotation_name": F.lit("v1"), **empty})
    return out.withColumn("output_gene_id", F.coalesce("output_gene_id", F.lit("none")))


@query("SELECT concat_ws(chr(9), sample, tool, query_id, coalesce(gene_id, ''), output_transcript_id, coalesce(output_gene_id, 'none'), coalesce(chain_id, ''), form_id, label, 'v1', gene_candidates, '', '') AS line FROM classified")
def mapping_lines(spark, d):
    """The mapping table's lines."""
    return _assigned(spark, d).select(export.delimited([F.col(c) for c in export.MAPPING.values()]).alias("line"))


_TAIL = (
    "' txid_annotation \"v1\"; txid_classification \"' || label || '\"; txid_form \"' || form_id || '\";' || CASE WHEN gene_candidates <> '' THEN ' txid_gene_candidates \"' || gene_candidates || '\";' ELSE '' END"
    " || CASE WHEN gene_id IS NOT NULL THEN ' txid_original_gene_id \"' || gene_id || '\";' ELSE '' END || ' txid_original_transcript_id \"' || query_id || '\";' || CASE WHEN chain_id IS NOT NULL THEN ' txid_sc \"' || chain_id || '\";' ELSE '' END"
)
_HEAD = "'gene_id \"' || coalesce(output_gene_id, 'none') || '\"; transcript_id \"' || output_transcript_id || '\";'"


@query(
    f"SELECT query_id AS transcript_id, 0 AS position, concat_ws(chr(9), contig, 'txid', 'transcript', tx_start, tx_end, '.', strand, '.', {_HEAD} || {_TAIL}) AS line FROM classified UNION ALL "
    f"SELECT query_id, CAST(n AS INT), concat_ws(chr(9), contig, 'txid', 'exon', s, e, '.', strand, '.', {_HEAD} || ' exon_number \"' || CASE WHEN strand = '+' THEN n ELSE exon_count + 1 - n END || '\";' || {_TAIL}) "
    "FROM classified JOIN (SELECT k, s, e, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM ex) USING (k)"
)
def rewritten_gtf(spark, d):
    """The rewritten annotation's records."""
    return export.gtf_lines(_assigned(spark, d)).select("transcript_id", "position", "line")


@query("SELECT transcript_id, concat_ws(chr(9), transcript_id, contig, strand, tx_start - 1, tx_end, tx_start - 1, tx_end, exon_count, (SELECT string_agg(s - 1, ',' ORDER BY s) FROM ex WHERE ex.k = tx.k) || ',', (SELECT string_agg(e, ',' ORDER BY s) FROM ex WHERE ex.k = tx.k) || ',') AS line FROM tx")
def genepred(spark, d):
    """B16."""
    return t.transcripts(spark, d).select("transcript_id", export.genepred_line().alias("line"))


_G = "coalesce(gene_id, 'unresolved-' || transcript_id)"
_GT = f"'gene_id \"' || {_G} || '\"; transcript_id \"' || transcript_id || '\";'"


@query(
    f"SELECT concat_ws(chr(9), contig, 'model', 'gene', min(tx_start), max(tx_end), '.', strand, '.', 'gene_id \"' || {_G} || '\";') AS line FROM tx GROUP BY contig, strand, {_G} UNION ALL "
    f"SELECT concat_ws(chr(9), contig, 'model', 'transcript', tx_start, tx_end, '.', strand, '.', {_GT}) FROM tx UNION ALL "
    f"SELECT concat_ws(chr(9), contig, 'model', 'exon', s, e, '.', strand, '.', {_GT} || ' exon_number \"' || CASE WHEN strand = '+' THEN n ELSE exon_count + 1 - n END || '\";') FROM tx JOIN (SELECT k, s, e, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM ex) USING (k)"
)
def neutral_gtf(spark, d):
    """Gene, transcript and exon records."""
    return export.neutral_gtf_lines(t.transcripts(spark, d)).select("line")


@query("SELECT transcript_id, '{\"contig\":\"' || contig || '\",\"exons\":[' || (SELECT string_agg('[' || s || ',' || e || ']', ',' ORDER BY s) FROM ex WHERE ex.k = tx.k) || '],\"gene_id\":' || coalesce('\"' || gene_id || '\"', 'null') || ',\"strand\":\"' || strand || '\",\"transcript_id\":\"' || transcript_id || '\"}' AS line FROM tx")
def annotation_rows(spark, d):
    """What an annotation's fingerprint is taken of."""
    return annotation.annotation_rows(t.transcripts(spark, d)).select("transcript_id", "line")


@query("SELECT query_id, row_number() OVER (ORDER BY contig, tx_start, tx_end, strand, form_id, query_id) AS ordinal FROM obs")
def import_order(spark, d):
    """Consecutive numbers in the order of imports, without one task that sees all rows."""
    return registry.numbered(t.observed(spark, d), [F.col("contig"), F.floor(F.col("start") / RANGE)], ORDER, "ordinal").select("query_id", "ordinal")


@query("SELECT transcript_id, form_id, contig, strand, exon_list AS exons, 'v1' || CASE WHEN k % 9 = 0 THEN ',v2' ELSE '' END AS annotations FROM ref")
def reference_tracks(spark, d):
    """A structure once with the releases that hold it."""
    r = t.reference(spark, d).withColumn("annotation_name", F.explode(F.when(F.col("k") % 9 == 0, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return plots.reference_tracks(r).select("transcript_id", "form_id", "contig", "strand", spans.alias("exons"), F.array_join("annotations", ",").alias("annotations"))


@query("SELECT chain_id, sha256(string_agg(DISTINCT form_id, chr(10) ORDER BY form_id)) AS signature FROM tx WHERE chain_id IS NOT NULL GROUP BY chain_id")
def member_signatures(spark, d):
    """A group's digest from its sorted members."""
    rows = t.transcripts(spark, d).filter("chain_id IS NOT NULL").groupBy("chain_id").agg(F.array_sort(F.collect_set("form_id")).alias("m"))
    return rows.select("chain_id", F.sha2(F.array_join("m", "\n"), 256).alias("signature"))


@query(", part AS (SELECT *, CASE WHEN k % 10 <> 1 THEN tool || contig END AS q FROM obs) SELECT a.*, b.*, c.*, o.*, cells / clusters / c.rows AS occupancy, 1 - cells / clusters / c.rows AS sparsity FROM (SELECT count(*) AS clusters, count(*) FILTER (f > 1) AS mixed, count(*) FILTER (f > 1 AND n = 1) AS end_merges FROM (SELECT q, count(DISTINCT form_id) AS f, count(DISTINCT coalesce(chain_id, form_id)) AS n FROM part WHERE q IS NOT NULL GROUP BY q)) a, (SELECT count(*) AS forms, count(*) FILTER (n > 1) AS split_forms FROM (SELECT count(DISTINCT q) AS n FROM part WHERE q IS NOT NULL GROUP BY form_id)) b, (SELECT count(DISTINCT sample || '|' || q) AS cells, count(DISTINCT sample) AS rows FROM part WHERE q IS NOT NULL) c, (SELECT sum(n - k)::BIGINT AS omitted, count(*) FILTER (k = 0) AS omitted_forms FROM (SELECT count(*) AS n, count(q) AS k FROM part GROUP BY form_id)) o")
def partition_metrics(spark, d):
    """With members that have no cluster."""
    rows = t.observed(spark, d).withColumn("cluster", F.when(F.col("k") % 10 != 1, F.concat("tool", "contig")))
    return metrics.partition_metrics(rows, "cluster", "form_id", "chain_id", "sample")


@query("WITH a AS (SELECT DISTINCT sha256(string_agg(event_id, chr(10) ORDER BY event_id::VARCHAR)) AS s FROM events GROUP BY user_id), b AS (SELECT DISTINCT sha256(string_agg(event_id, chr(10) ORDER BY event_id::VARCHAR)) AS s FROM events GROUP BY CASE WHEN user_id % 5 = 0 THEN user_id // 2 ELSE 1000000 + user_id END) SELECT (SELECT count(*) FROM a WHERE s NOT IN (FROM b)) AS only_left, (SELECT count(*) FROM b WHERE s NOT IN (FROM a)) AS only_right, (SELECT count(*) FROM a WHERE s IN (FROM b)) AS both", plain=True)
def signature_changes(spark, d):
    """Groups of members that two partitions share, whatever their labels."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").cast("string").alias("member"))
    label = F.when(F.col("user_id") % 5 == 0, F.floor(F.col("user_id") / 2)).otherwise(F.col("user_id") + 1_000_000)
    return metrics.signature_changes(e.withColumnRenamed("user_id", "label"), e.withColumn("label", label), "label", "member")


@query("SELECT 0.025::DOUBLE AS share, quantile_cont(l_extendedprice, 0.025) AS value FROM lineitem UNION ALL SELECT 0.5, quantile_cont(l_extendedprice, 0.5) FROM lineitem UNION ALL SELECT 0.975, quantile_cont(l_extendedprice, 0.975) FROM lineitem", plain=True)
def percentiles(spark, d):
    """E30."""
    return metrics.percentiles(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", [0.025, 0.5, 0.975])


@query("SELECT form_id, 'stored' AS side FROM (SELECT form_id FROM obs WHERE k % 8 <> 0 EXCEPT ALL SELECT form_id FROM obs WHERE k % 7 <> 0) UNION ALL SELECT form_id, 'computed' FROM (SELECT form_id FROM obs WHERE k % 7 <> 0 EXCEPT ALL SELECT form_id FROM obs WHERE k % 8 <> 0)")
def audit_differences(spark, d):
    """Rows that only one of two tables holds."""
    o = t.observed(spark, d)
    return metrics.audited(o.filter("k % 8 <> 0"), o.filter("k % 7 <> 0"), ["form_id"])


@query("SELECT transcript_id, CASE WHEN exon_count = 1 THEN tx_start + 1 ELSE tx_start END AS tx_start, CASE WHEN exon_count = 1 THEN tx_end ELSE greatest(tx_end, tx_end) END AS tx_end, (SELECT min(e) FROM ex WHERE ex.k = tx.k) + CASE WHEN exon_count = 1 THEN 0 ELSE 1 END AS first_end FROM tx")
def perturbed_models(spark, d):
    """C18."""
    out = structure.with_shape(metrics.perturbed(t.transcripts(spark, d)).select("transcript_id", "contig", "strand", "exons"))
    return out.select("transcript_id", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), F.expr("exons[0].end").alias("first_end"))


@query()
def bootstrap_intervals(spark, d):
    """Intervals from aggregated strata; the draws are seeded, so reruns agree."""
    strata = metrics.discovery(t.reference(spark, d), t.observed(spark, d), "form_id").first()
    found = metrics.bootstrap_discovery(strata.hits, strata.truth, strata.hits, strata.predicted)
    return spark.createDataFrame(sorted(found.items()), "metric string, value double")


_KNOWN = "SELECT gene_id, contig, strand, {0}, arg_min(transcript_id, k) AS t, arg_min(exon_count, k) AS n FROM ref WHERE gene_id IS NOT NULL{1} GROUP BY gene_id, contig, strand, {0}"


@query(
    f", x AS ({_KNOWN.format('exon_list', '')}), i AS ({_KNOWN.format('gaps', ' AND exon_count > 1')}) "
    "SELECT o.transcript_id AS isoform, CASE WHEN x.t IS NOT NULL OR i.t IS NOT NULL THEN 'full-splice_match' WHEN o.gene_id IN (SELECT gene_id FROM ref WHERE gene_id IS NOT NULL) THEN 'novel_not_in_catalog' WHEN o.k % 10 = 0 THEN 'fusion' ELSE 'intergenic' END AS structural_category, "
    "coalesce(o.gene_id, 'unresolved-' || o.transcript_id) AS associated_gene, coalesce(x.t, i.t, 'novel') AS associated_transcript, coalesce((CASE WHEN x.t IS NOT NULL THEN x.n ELSE i.n END)::VARCHAR, 'NA') AS ref_exons, o.exon_count::VARCHAR AS exons, "
    "CASE WHEN o.exon_count = 1 THEN 'mono-exon' ELSE 'multi-exon' END AS subcategory, 'canonical' AS all_canonical, '1' AS \"FL\", o.exon_bases::BIGINT::VARCHAR AS length "
    "FROM obs o LEFT JOIN x ON o.gene_id = x.gene_id AND o.contig = x.contig AND o.strand = x.strand AND o.exon_list = x.exon_list LEFT JOIN i ON o.gene_id = i.gene_id AND o.contig = i.contig AND o.strand = i.strand AND o.gaps = i.gaps"
)
def classification_table(spark, d):
    """Structural categories as a table, written and read back."""
    path = f"{work_dir(spark)}/classification-{uuid.uuid4().hex}/classification.tsv"
    categories.write_classification(categories.structural_categories(t.observed(spark, d), t.reference(spark, d), "k", F.col("k") % 10 == 0), path)
    return tables.table(spark, path, categories.COLUMNS, ["isoform"])


def _reads(spark, d):
    """Line items as reads: the supplier is the transcript a read comes from, and clusters are drawn from it and the line's number; some reads are missed."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("truth"), F.min("l_partkey").alias("p"))
    cluster = F.when(F.col("p") % 13 != 0, F.concat_ws("-", F.floor(F.col("truth") / 2), F.col("p") % 3))
    return x.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("read"), "truth", cluster.alias("cluster"))


_READS = (
    "WITH r AS (SELECT min(l_suppkey) AS truth, CASE WHEN min(l_partkey) % 13 <> 0 THEN (min(l_suppkey) // 2) || '-' || (min(l_partkey) % 3) END AS c FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "cells AS (SELECT c, truth, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY ALL), "
    "a AS (SELECT sum(n) AS n, sum(n * (n - 1) // 2) AS same, count(*) AS others FROM cells GROUP BY c), b AS (SELECT sum(n) AS n, sum(n * (n - 1) // 2) AS same, count(*) AS others FROM cells GROUP BY truth), "
    "m AS (SELECT count(*) AS clusters, count(*) FILTER (others > 1) AS mixed_clusters, sum(n * (n - 1) // 2)::BIGINT AS cluster_pairs, sum(n * (n - 1) // 2 - same)::BIGINT AS false_merges FROM a), "
    "s AS (SELECT count(*) AS truth_groups, count(*) FILTER (others > 1) AS split_groups, sum(n * (n - 1) // 2)::BIGINT AS truth_pairs, sum(n * (n - 1) // 2 - same)::BIGINT AS false_splits FROM b) "
)


@query(_READS + "SELECT *, requested - missing AS observations, false_merges / cluster_pairs AS false_merge_rate, false_splits / truth_pairs AS false_split_rate FROM m, s, (SELECT count(*) AS requested, count(*) FILTER (c IS NULL) AS missing FROM r)", plain=True)
def read_partition(spark, d):
    """Clusters of reads against the transcripts that they come from."""
    return metrics.read_partition(_reads(spark, d), "read", "cluster", "truth")


@query()
def read_intervals(spark, d):
    """Intervals of both rates, with clusters and truth groups drawn on the executors; tested against resampling one by one."""
    return metrics.read_intervals(stored(_reads(spark, d), "reads"), "cluster", "truth")
