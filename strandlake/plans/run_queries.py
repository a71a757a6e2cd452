"""Registered queries of runs against each other, and of files whose order of lines counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import registry, runs
from strandlake.session import stored
from strandlake.sinks import files

from . import driver_tables as t
from .catalog_queries import _classified, query
from .file_queries import _read, folder
from .genome_queries import _numbered
from .output_queries import _HEAD, _TAIL, _assigned, _reads
from .registry_queries import _registry


@query("SELECT 'shuffled' AS run, 'form_id' AS column, 0::BIGINT AS changes UNION ALL SELECT 'shuffled', 'chain_id', count(*) FROM obs WHERE k % 8 = 1 AND exon_count > 1 UNION ALL SELECT 'shuffled', 'label', 0 UNION ALL SELECT 'release 2', 'form_id', 0 UNION ALL SELECT 'release 2', 'chain_id', 0 UNION ALL SELECT 'release 2', 'label', count(*) FROM classified WHERE k % 9 = 1 AND label <> 'new_locus'")
def run_changes(spark, d):
    """Observations of three runs by their whole key; forms, chains and labels that differ from the first run's."""
    c = _classified(spark, d).withColumn("chain_id", F.when(F.col("exon_count") > 1, F.col("chain_id")))
    c = stored(c.select("k", "sample", "tool", "transcript_id", "form_id", "chain_id", "label"), "run")
    shuffled = c.withColumn("chain_id", F.when(F.col("k") % 8 != 1, F.col("chain_id"))).orderBy(F.xxhash64("transcript_id"))
    release = c.withColumn("label", F.when(F.col("k") % 9 == 1, "new_locus").otherwise(F.col("label")))
    return runs.compared({"sorted": c, "shuffled": shuffled, "release 2": release}, ["sample", "tool", "transcript_id"], ["form_id", "chain_id", "label"])


@query(
    "WITH a AS (SELECT event_id AS m, 'u' || user_id AS c FROM events WHERE event_id % 7 <> 0), b AS (SELECT event_id AS m, 'u' || CASE WHEN user_id % 5 = 0 THEN user_id // 2 ELSE user_id END AS c FROM events WHERE event_id % 11 <> 0), j AS (SELECT a.c AS a, b.c AS b FROM a JOIN b USING (m)), "
    "p AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM j GROUP BY a)) + (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM j GROUP BY b)) - 2 * (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM j GROUP BY a, b)) AS changed_pairs) "
    "SELECT (SELECT count(*) FROM a) AS members_left, (SELECT count(*) FROM b) AS members_right, (SELECT count(*) FROM j) AS members_shared, (SELECT count(*) FROM a ANTI JOIN b USING (m)) AS only_left, (SELECT count(*) FROM b ANTI JOIN a USING (m)) AS only_right, (SELECT count(*) FROM j WHERE a <> b) AS changed_clusters, changed_pairs::BIGINT AS changed_pairs FROM p",
    plain=True,
)
def membership_changes(spark, d):
    """Two partitions of which each has members that the other lacks."""
    e = _read(spark, d, "events").select("event_id", "user_id")
    name = lambda c: F.concat(F.lit("u"), c)
    other = F.when(F.col("user_id") % 5 == 0, F.floor(F.col("user_id") / 2)).otherwise(F.col("user_id"))
    return runs.membership_changes(e.filter("event_id % 7 <> 0").withColumn("c", name("user_id")), e.filter("event_id % 11 <> 0").withColumn("c", name(other)), "c", "event_id")


@query("WITH r AS (SELECT min(l_suppkey) AS truth, CASE WHEN min(l_partkey) % 13 <> 0 THEN (min(l_suppkey) // 2) || '-' || (min(l_partkey) % 3) END AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT count(*) FILTER (truth % 4 <> 0) AS members, count(DISTINCT c) FILTER (truth % 4 <> 0) AS clusters, count(*) FILTER (truth % 4 = 0) AS ignored FROM r WHERE c IS NOT NULL", plain=True)
def truth_subset(spark, d):
    """Clusters of reads that truth knows, and how many reads it does not know."""
    r = _reads(spark, d)
    kept, ignored = runs.restricted(r.filter("cluster IS NOT NULL").drop("truth"), r.filter("truth % 4 <> 0"), "read")
    return kept.agg(F.count(F.lit(1)).alias("members"), F.count_distinct("cluster").alias("clusters")).join(ignored)  # single rows


@query("SELECT query_id AS transcript_id, 's' AS sample, 't' AS tool, (SELECT count(*) FROM obs) AS imported, true AS has_checksums FROM obs")
def registry_provenance(spark, d):
    """Observations with their import and their annotation."""
    checksums = F.col("input_checksum").rlike("^sha256:[0-9a-f]{64}$") & F.col("annotation_fingerprint").rlike("^sha256:[0-9a-f]{64}$")
    return _registry(spark, d)[0].provenance().select("transcript_id", "sample", "tool", F.col("transcripts").alias("imported"), checksums.alias("has_checksums"))


@query("SELECT 1::BIGINT AS at, concat_ws(chr(9), 'alias', 'primary') AS value UNION ALL SELECT 1 + row_number() OVER (ORDER BY alias), alias || chr(9) || p FROM (SELECT c_name AS alias, 'c' || c_custkey AS p FROM customer UNION ALL SELECT 'C.' || c_custkey, 'c' || c_custkey FROM customer)", plain=True)
def alias_file(spark, d):
    """A file of aliases, sorted, from a table with repeated rows and names that stand for themselves."""
    c = _read(spark, d, "customer").withColumn("primary", F.concat(F.lit("c"), "c_custkey"))
    other = F.concat(F.lit("C."), "c_custkey")
    path = f"{folder(spark)}/aliases.tsv"
    files.write_aliases(c.select("primary", F.explode(F.array("c_name", other, other, "primary")).alias("alias")), path)
    return _numbered(spark, path)


@query("SELECT 1::BIGINT AS at, 'original_transcript_id' AS transcript UNION ALL SELECT 1 + row_number() OVER (ORDER BY query_id), query_id FROM obs")
def mapping_order(spark, d):
    """The lines of a mapping by the transcripts' own names."""
    path = f"{folder(spark)}/mapping.tsv"
    files.write_mapping(_assigned(spark, d), path)
    return _numbered(spark, path).select("at", F.split("value", "\t")[2].alias("transcript"))


@query("SELECT 1::BIGINT AS at, 'gene_id' AS gene, 'form_id' AS form UNION ALL SELECT 1 + row_number() OVER (ORDER BY gene, form_id), gene, form_id FROM (SELECT DISTINCT coalesce(output_gene_id, '') AS gene, form_id FROM classified)")
def catalog_order(spark, d):
    """The lines of a catalog by gene and form."""
    path = f"{folder(spark)}/catalog.tsv"
    c = _classified(spark, d).withColumns({"output_gene_id": F.coalesce("output_gene_id", F.lit("")), "splice_chain_id": F.col("chain_id")})
    files.write_catalog(registry.catalog(c), path)
    parts = F.split("value", "\t")
    return _numbered(spark, path).select("at", parts[2].alias("gene"), parts[0].alias("form"))


@query(
    f", rec AS (SELECT *, 0 AS position, concat_ws(chr(9), contig, 'txid', 'transcript', tx_start, tx_end, '.', strand, '.', {_HEAD} || {_TAIL}) AS line FROM classified UNION ALL "
    f"SELECT c.*, x.n, concat_ws(chr(9), contig, 'txid', 'exon', x.s, x.e, '.', strand, '.', {_HEAD} || ' exon_number \"' || CASE WHEN strand = '+' THEN x.n ELSE exon_count + 1 - x.n END || '\";' || {_TAIL}) "
    "FROM classified c JOIN (SELECT k, s, e, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM ex) x USING (k)) "
    "SELECT 1::BIGINT AS at, '# txid rewritten annotation; coordinates are 1-based closed' AS value UNION ALL SELECT 1 + row_number() OVER (ORDER BY contig, tx_start, tx_end, strand, form_id, query_id, position), line FROM rec"
)
def gtf_order(spark, d):
    """The lines of a rewritten annotation in the order of places, forms and names."""
    path = f"{folder(spark)}/out.gtf.gz"
    files.write_gtf(_assigned(spark, d), path)
    return _numbered(spark, path)
