"""Registered queries of the transcript engine and their SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import structure, text
from strandlake.operators import classify, metrics, registry, stateful
from strandlake.session import stored

from . import driver_tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None = None, plain: bool = False):
    """Register a function as a query; its SQL follows the common tables unless it is plain."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if plain else t.SQL + sql
        return f

    return add


def _classified(spark, d):
    out = classify.classified(t.observed(spark, d), t.reference(spark, d))
    return out.withColumn("gene_candidates", F.array_join("gene_candidates", ","))



@query("SELECT transcript_id, contig, strand, tx_start, tx_end, CAST(exon_count AS INT) AS exon_count, tss, tes, coalesce(replace(replace(replace(gaps, '],[', ';'), '[', ''), ']', ''), '') AS introns FROM tx")
def transcript_shape(spark, d):
    """Exons gathered, ordered, and what follows from them."""
    inner = F.array_join(F.transform("introns", lambda x: F.array_join(x.cast("array<string>"), ",")), ";")
    return t.transcripts(spark, d).filter(structure.problems().isNull()).select("transcript_id", "contig", "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), "exon_count", "tss", "tes", inner.alias("introns"))


@query("SELECT transcript_id, form_id, chain_id, form_json, sha256(form_json) AS form_digest FROM tx")
def structural_identity(spark, d):
    """C5."""
    return t.transcripts(spark, d).select("transcript_id", "form_id", "chain_id", F.col("form.canonical_json").alias("form_json"), F.col("form.full_digest").alias("form_digest"))


@query("SELECT gene_id, contig, strand, s AS span_start, e AS span_end FROM spans")
def gene_spans(spark, d):
    """E2."""
    return classify.gene_spans(t.reference(spark, d)).withColumnsRenamed({"start": "span_start", "end": "span_end"})


@query("SELECT query_id, label, output_gene_id, output_transcript_id, gene_candidates FROM classified")
def classify_transcripts(spark, d):
    """D1, D2, E3, E4, G11."""
    return _classified(spark, d).select("query_id", "label", "output_gene_id", "output_transcript_id", "gene_candidates")


@query("SELECT label, count(*) AS n FROM classified GROUP BY label")
def label_counts(spark, d):
    """E7."""
    return _classified(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS observations, count(DISTINCT form_id) AS forms, count(DISTINCT chain_id) AS chains, count(DISTINCT sample) AS samples, count(DISTINCT tool) AS tools, count(*) FILTER (chain_id IS NULL) AS single_exon FROM obs")
def registry_summary(spark, d):
    """E8."""
    return registry.summary(t.observed(spark, d))


@query("SELECT form_id, chain_id AS splice_chain_id, coalesce(output_gene_id, '') AS gene_id, string_agg(DISTINCT label, ',' ORDER BY label) AS classifications, count(*) AS observation_count, count(DISTINCT sample) AS sample_count, count(DISTINCT tool) AS tool_count FROM classified GROUP BY form_id, chain_id, coalesce(output_gene_id, '')")
def catalog(spark, d):
    """The chain is a grouping key, so a null chain is a group like any other."""
    return registry.catalog(_classified(spark, d).withColumns({"output_gene_id": F.coalesce("output_gene_id", F.lit("")), "splice_chain_id": F.col("chain_id")}))


@query("SELECT form_id, min(contig) AS contig, min(strand) AS strand, count(*) AS n, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(exon_list) AS exons FROM classified GROUP BY form_id")
def observed_tracks(spark, d):
    """E10."""
    exons = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return _classified(spark, d).groupBy("form_id").agg(F.min("contig").alias("contig"), F.min("strand").alias("strand"), F.count(F.lit(1)).alias("n"), joined("sample").alias("samples"), joined("label").alias("labels"), F.min(exons).alias("exons"))


@query("SELECT form_id, CAST(2 - (min(k) % 2) AS BIGINT) AS digests, 2 * count(*) AS n FROM tx GROUP BY form_id")
def repeated_forms(spark, d):
    """Forms that recur; more than one digest would be a collision. Each is given twice, with another digest for even numbers."""
    rows = t.transcripts(spark, d)
    other = F.when(F.col("k") % 2 == 0, F.sha2(F.concat("form.full_digest", F.lit("x")), 256)).otherwise(F.col("form.full_digest"))
    return registry.collisions(rows.unionByName(rows.withColumn("form", F.col("form").withField("full_digest", other))), repeated=True)


@query("SELECT form_id, 2::BIGINT AS digests, 2::BIGINT AS n FROM tx WHERE k % 2 = 0")
def collisions(spark, d):
    """Only the forms with two digests."""
    rows = t.transcripts(spark, d)
    other = F.when(F.col("k") % 2 == 0, F.sha2(F.concat("form.full_digest", F.lit("x")), 256)).otherwise(F.col("form.full_digest"))
    return registry.collisions(rows.unionByName(rows.withColumn("form", F.col("form").withField("full_digest", other)))).filter("digests > 1")


@query("SELECT count(*) FILTER (k % 7 = 0 OR k % 5 = 0) AS invalid, count(*) AS checked FROM tx")
def digest_validation(spark, d):
    """C14: stored digests and names are wrong for some numbers, and all are checked."""
    digest = F.when(F.col("k") % 7 == 0, F.sha2("form.full_digest", 256)).otherwise(F.col("form.full_digest"))
    name = F.when(F.col("k") % 5 == 0, F.concat("form.public_id", F.lit("0"))).otherwise(F.col("form.public_id"))
    return registry.validated(t.transcripts(spark, d).withColumn("form", F.col("form").withField("full_digest", digest).withField("public_id", name)))


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lineitem_orders, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_customer", plain=True)
def foreign_keys(spark, d):
    """C15."""
    r = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    return registry.orphans({"lineitem_orders": (r("lineitem"), "l_orderkey", r("orders"), "o_orderkey"), "orders_customer": (r("orders"), "o_custkey", r("customer"), "c_custkey")})


def _forms(spark, d):
    return t.transcripts(spark, d).select("form_id", F.col("form.family").alias("family"), F.lit(t.ASSEMBLY).alias("assembly"), "contig", "strand", stateful.coordinates().alias("coordinates"))


@query(
    ", f AS (SELECT DISTINCT form_id, contig, strand, exon_count, CASE WHEN exon_count = 1 THEN [tx_start, tx_end] ELSE [tss, tes] || list_transform(regexp_extract_all(gaps, '[0-9]+'), lambda v: v::BIGINT) END AS x FROM tx), "
    "g AS (SELECT *, x[1] // 401 AS bucket FROM f), h AS (SELECT * EXCLUDE (bucket), unnest([bucket - 1, bucket, bucket + 1]) AS bucket FROM g) "
    "SELECT a.form_id AS a, b.form_id AS b FROM h a JOIN g b USING (contig, strand, exon_count, bucket) WHERE a.form_id < b.form_id AND list_bool_and(list_transform(range(1, len(a.x) + 1), lambda i: abs(a.x[i] - b.x[i]) <= CASE WHEN i <= 2 THEN 400 ELSE 100 END))"
)
def compatible_forms_all(spark, d):
    """D4, over all forms of any number of exons."""
    return stateful.compatible_pairs(_forms(spark, d).dropDuplicates(["form_id"]), 100, 400)


@query()
def fuzzy_clusters(spark, d):
    """J2, J3; tested against an exhaustive model."""
    return stateful.clustered(_forms(spark, d), 100, 400)


@query()
def loci(spark, d):
    """J1, F1, F7; tested against a sequential model."""
    rows = _classified(spark, d).filter("output_gene_id IS NULL")
    rows = registry.numbered(rows, [F.col("contig"), F.floor(F.col("start") / stateful.RANGE)], ["contig", "start", "end", "strand", "form_id", "query_id"], "ordinal")
    out = stateful.allocated(stored(rows.select("ordinal", "query_id", "contig", "strand", F.col("label").alias("status"), F.col("gene_candidates").alias("candidates"), "start", "end"), "loci-input"))
    return out.select("query_id", text.accession("GL1.", F.col("locus")).alias("locus_id"))


@query("SELECT *, truth_pairs - joint_pairs AS false_splits, predicted_pairs - joint_pairs AS false_merges, CASE WHEN truth_pairs > 0 THEN (truth_pairs - joint_pairs) / truth_pairs ELSE 0 END AS false_split_rate, CASE WHEN predicted_pairs > 0 THEN (predicted_pairs - joint_pairs) / predicted_pairs ELSE 0 END AS false_merge_rate FROM (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM obs GROUP BY chain_id))::BIGINT AS truth_pairs, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM obs GROUP BY form_id))::BIGINT AS predicted_pairs, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM obs GROUP BY chain_id, form_id))::BIGINT AS joint_pairs)")
def pair_errors(spark, d):
    """E14, E15, E16."""
    return metrics.pair_errors(t.observed(spark, d), "chain_id", "form_id")


@query("SELECT ((SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM e GROUP BY event_type)) + (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM e GROUP BY b)) - 2 * (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM e GROUP BY event_type, b)))::BIGINT AS changed_pairs, (SELECT count(*) FROM e WHERE event_type IS DISTINCT FROM b) AS changed_labels FROM (SELECT 1)".replace("FROM e ", "FROM (SELECT event_type, CASE WHEN user_id % 7 = 0 THEN 'moved' ELSE event_type END AS b FROM events) "), plain=True)
def changed_relations(spark, d):
    """E18, E19, E20."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.when(F.col("user_id") % 7 == 0, "moved").otherwise(F.col("event_type")).alias("b"))
    return metrics.changed_relations(e, "event_type", "b")


@query("SELECT e AS expected, j AS joined, c AS correct, CASE WHEN j > 0 THEN 1 - c / j END AS false_merge_rate, CASE WHEN e > 0 THEN 1 - c / e END AS false_split_rate FROM (SELECT (SELECT count(*) FROM obs a JOIN obs b USING (chain_id) WHERE a.tool = '1-URGENT' AND b.tool = '2-HIGH') AS e, (SELECT count(*) FROM obs a JOIN obs b USING (form_id) WHERE a.tool = '1-URGENT' AND b.tool = '2-HIGH') AS j, (SELECT count(*) FROM obs a JOIN obs b USING (form_id, chain_id) WHERE a.tool = '1-URGENT' AND b.tool = '2-HIGH') AS c)")
def tool_pairs(spark, d):
    """All observations of one tool against all of another."""
    o = t.observed(spark, d)
    return metrics.cross_pairs(o.filter("tool = '1-URGENT'"), o.filter("tool = '2-HIGH'"), "chain_id", "form_id")


@query("SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN truth > 0 THEN hits / truth ELSE 0 END AS recall, CASE WHEN predicted > 0 THEN (SELECT count(*) FROM obs) / predicted ELSE 0 END AS redundancy, CASE WHEN hits > 0 THEN 2 * (hits / predicted) * (hits / truth) / (hits / predicted + hits / truth) ELSE 0 END AS f1 FROM (SELECT (SELECT count(DISTINCT form_id) FROM ref) AS truth, (SELECT count(DISTINCT form_id) FROM obs) AS predicted, (SELECT count(DISTINCT form_id) FROM obs WHERE form_id IN (SELECT form_id FROM ref)) AS hits)")
def discovery(spark, d):
    """E21, D14."""
    return metrics.discovery(t.reference(spark, d), t.observed(spark, d), "form_id")


@query("SELECT n_rows, n_columns, n_cells, shared_columns, 1 - n_cells / (n_rows * n_columns) AS sparsity FROM (SELECT count(DISTINCT sample) AS n_rows, count(DISTINCT form_id) AS n_columns, count(DISTINCT sample || '|' || form_id) AS n_cells FROM obs), (SELECT count(*) AS shared_columns FROM (SELECT form_id FROM obs GROUP BY form_id HAVING count(DISTINCT sample) > 1))")
def matrix_metrics(spark, d):
    """E26, B13."""
    return metrics.matrix_metrics(t.observed(spark, d), "sample", "form_id")


@query("SELECT sample, form_id, count(*) AS n FROM obs GROUP BY sample, form_id")
def count_matrix(spark, d):
    """B12, as a sparse table."""
    return t.observed(spark, d).groupBy("sample", "form_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT old.label AS old_label, new.label AS new_label, count(*) AS n FROM classified old JOIN (SELECT query_id, CASE WHEN k % 9 = 1 THEN 'new_locus' ELSE label END AS label FROM classified) new USING (query_id) GROUP BY ALL")
def label_transitions(spark, d):
    """E32, D16, D23."""
    old = stored(_classified(spark, d).select("k", "query_id", "label"), "labels")
    return metrics.transitions(old, old.withColumn("label", F.when(F.col("k") % 9 == 1, "new_locus").otherwise(F.col("label"))), "query_id", "label")


@query("SELECT median(abs(o.tss - r.tss)) AS median_tss_error, max(abs(o.tss - r.tss)) AS max_tss_error FROM obs o JOIN (SELECT contig, strand, k // 50 AS block, min_by(tss, k) AS tss FROM ref GROUP BY ALL) r ON o.contig = r.contig AND o.strand = r.strand AND o.k // 50 = r.block")
def end_errors(spark, d):
    """Exact median of TSS distances to the block's first reference; chain_end_errors is the benchmark's measure."""
    block = F.floor(F.col("k") / 50).alias("block")
    r = t.reference(spark, d).groupBy("contig", "strand", block).agg(F.min_by("tss", "k").alias("r_tss"))
    both = t.observed(spark, d).withColumn("block", block).join(r, ["contig", "strand", "block"])
    gap = F.abs(F.col("tss") - F.col("r_tss"))
    return both.agg(F.median(gap).alias("median_tss_error"), F.max(gap).alias("max_tss_error"))


@query("SELECT count(*) AS n, median(gap) AS median_end_error, max(gap) AS max_end_error FROM (SELECT unnest([abs(o.tss - r.tss), abs(o.tes - r.tes)]) AS gap FROM obs o JOIN (SELECT chain_id, arg_max(tss, k) AS tss, arg_max(tes, k) AS tes FROM ref WHERE chain_id IS NOT NULL GROUP BY chain_id) r USING (chain_id))")
def chain_end_errors(spark, d):
    """TSS and TES errors to the last truth of the same splice chain."""
    return metrics.end_errors(t.reference(spark, d), t.observed(spark, d), "k")


@query("SELECT CAST(exon_count AS INT) AS exon_count, count(*) AS n FROM obs GROUP BY exon_count")
def exon_histogram(spark, d):
    """E23."""
    return t.observed(spark, d).groupBy("exon_count").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chain_id, 2 * count(DISTINCT form_id) AS forms, count(DISTINCT tool) AS tools FROM obs WHERE chain_id IS NOT NULL GROUP BY chain_id")
def end_variant_chains(spark, d):
    """Each spliced observation once more with its last exon longer, which is another form of the same chain."""
    o = t.observed(spark, d).select("transcript_id", "contig", "strand", "exons", "tool")
    longer = o.withColumn("exons", F.expr("transform(exons, (x, i) -> named_struct('start', x.start, 'end', IF(i = size(exons) - 1, x.end + 7, x.end)))"))
    both = structure.with_identity(structure.with_shape(o.unionByName(longer)), t.ASSEMBLY).select("tool", F.col("form.public_id").alias("form_id"), F.col("splice_chain.public_id").alias("chain_id"))
    return both.filter("chain_id IS NOT NULL").groupBy("chain_id").agg(F.countDistinct("form_id").alias("forms"), F.countDistinct("tool").alias("tools")).filter("forms > 1")


@query("WITH s AS (SELECT user_id, date_trunc('day', ts) AS m, list(DISTINCT event_type) AS now, max(day(ts) // 3) AS chain FROM events GROUP BY ALL), o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM (SELECT DISTINCT m FROM s)), n AS (SELECT s.*, i FROM s JOIN o USING (m)), f AS (SELECT coalesce(a.i, b.i + 1) AS i, a.now, b.now AS old, a.chain, b.chain AS old_chain FROM n a FULL JOIN n b ON a.user_id = b.user_id AND a.i = b.i + 1) SELECT strftime(o.m, '%Y-%m-%d') AS day, count(now) AS n_keys, count(*) FILTER (old IS NULL) AS n_new, count(*) FILTER (now IS NULL) AS n_gone, count(*) FILTER (now IS NOT NULL AND old IS NOT NULL AND NOT list_has_all(now, old)) AS n_lost_labels, count(*) FILTER (now IS NOT NULL AND old IS NOT NULL AND chain <> old_chain) AS n_changed_chains FROM f JOIN o USING (i) GROUP BY o.m", plain=True)
def snapshot_changes(spark, d):
    """E25, F8, J9."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "chain": F.expr("day(ts) div 3")})
    return metrics.snapshots(e, "user_id", "day", "event_type", "chain")


@query("WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS k FROM lineitem), c AS (SELECT *, row_number() OVER w AS r, lead(l_extendedprice) OVER w AS runner_up FROM b WHERE k = 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber, l_partkey)) SELECT CASE WHEN NOT l_quantity >= 5 THEN 'low_identity' WHEN NOT l_discount <= 0.08 THEN 'low_query_coverage' WHEN NOT l_tax <= 0.07 THEN 'low_target_coverage' WHEN NOT l_extendedprice - coalesce(runner_up, 0) >= 1000 THEN 'ambiguous' ELSE 'accepted' END AS reason, count(*) AS n FROM c WHERE r = 1 GROUP BY reason", plain=True)
def alignment_reasons(spark, d):
    """Best and runner-up, then the first threshold that fails."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    best = metrics.best_alignments(rows, "l_orderkey", "l_suppkey", "l_extendedprice", ["l_linenumber", "l_partkey"])
    margin = F.col("l_extendedprice") - F.coalesce("runner_up", F.lit(0.0)) >= 1000
    reason = metrics.cascade([("low_identity", F.col("l_quantity") >= 5), ("low_query_coverage", F.col("l_discount") <= 0.08), ("low_target_coverage", F.col("l_tax") <= 0.07), ("ambiguous", margin)])
    return best.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT query_id, contig FROM obs WHERE contig IN ('chr1', 'chr3') AND tool NOT LIKE '1-%' AND form_id NOT IN (SELECT form_id FROM ref)")
def scoped_observations(spark, d):
    """Contigs and tools chosen, reference forms left out by an anti join."""
    o = t.observed(spark, d).filter(F.col("contig").isin("chr1", "chr3") & ~F.col("tool").startswith("1-"))
    return o.join(t.reference(spark, d).select("form_id"), "form_id", "left_anti").select("query_id", "contig")


@query("SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority || ' ' || o_orderstatus, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug, printf('GL1.%06d', o_orderkey) AS accession, CAST(('0x' || substr(sha256(o_orderpriority), 1, 8))::BIGINT % 360 AS BIGINT) AS hue, reverse(translate('ACGTN' || o_orderstatus, 'ACGTNacgtn', 'TGCANtgcan')) AS reverse_complement FROM orders", plain=True)
def scalar_functions(spark, d):
    """I: slug, accession, hue, reverse complement."""
    p = F.col("o_orderpriority")
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", text.slug(F.concat_ws(" ", p, "o_orderstatus")).alias("slug"), text.accession("GL1.", F.col("o_orderkey")).alias("accession"), text.hue(p).alias("hue"), text.reverse_complement(F.concat(F.lit("ACGTN"), "o_orderstatus")).alias("reverse_complement")
    )


@query("SELECT transcript_id, contig, strand, tx_start - 1 AS tx_start0, tx_end, CAST(exon_bases AS BIGINT) AS exon_bases, (SELECT string_agg(CASE WHEN prev IS NOT NULL THEN (s - prev - 1) || 'N' ELSE '' END || (e - s + 1) || 'M', '' ORDER BY s) FROM (SELECT s, e, lag(e) OVER (ORDER BY s) AS prev FROM ex WHERE ex.k = tx.k)) AS cigar FROM tx")
def spliced_records(spark, d):
    """0-based starts, spliced length and CIGAR."""
    bases = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)
    return t.transcripts(spark, d).select("transcript_id", "contig", "strand", (F.col("start") - 1).alias("tx_start0"), F.col("end").alias("tx_end"), bases.alias("exon_bases"), text.cigar().alias("cigar"))


@query("SELECT transcript_id, s AS exon_start, e AS exon_end, CAST(CASE WHEN strand = '+' THEN row_number() OVER (PARTITION BY ex.k ORDER BY s) ELSE row_number() OVER (PARTITION BY ex.k ORDER BY s DESC) END AS INT) AS exon_number FROM ex JOIN tx USING (k)")
def numbered_exons(spark, d):
    """F2, B1: exons numbered in the order of transcription."""
    x = t.transcripts(spark, d).select("transcript_id", "strand", "exon_count", F.posexplode("exons").alias("i", "x"))
    return x.select("transcript_id", F.col("x.start").alias("exon_start"), F.col("x.end").alias("exon_end"), F.when(F.col("strand") == "+", F.col("i") + 1).otherwise(F.col("exon_count") - F.col("i")).alias("exon_number"))


@query("SELECT query_id, contig, sample, tool, label FROM classified WHERE form_id IN (SELECT form_id FROM ref) OR chain_id IN (SELECT form_id FROM ref) OR output_gene_id IN (SELECT form_id FROM ref)")
def inspect_reference_ids(spark, d):
    """The inspect command for the ids of all reference forms."""
    ids = t.reference(spark, d).select(F.col("form_id").alias("id"))
    return registry.inspected(_classified(spark, d), ids, ["form_id", "chain_id", "output_gene_id"], "query_id").select("query_id", "contig", "sample", "tool", "label")


@query("SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT count(*)::DOUBLE AS observations, count(DISTINCT form_id)::DOUBLE AS forms FROM obs) ON observations, forms INTO NAME metric VALUE value)")
def metric_rows(spark, d):
    """B14."""
    s = registry.summary(t.observed(spark, d)).select(F.col("observations").cast("double"), F.col("forms").cast("double"))
    return s.unpivot([], ["observations", "forms"], "metric", "value")
