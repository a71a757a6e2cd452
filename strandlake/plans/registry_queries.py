"""Registered queries of a registry that is built from the driver's tables: a reference, its annotation and one imported file."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import registry
from strandlake.operators.commands import Commands
from strandlake.session import released, stored
from strandlake.sinks import files

from . import driver_tables as t
from .catalog_queries import query
from .file_queries import folder, gtf_file

#: Bases of a line of the genome's file.
LINE = 4096
_built: dict[tuple[str, str], tuple[Commands, dict, str]] = {}


def _registry(spark, d) -> tuple[Commands, dict, str]:
    """The commands, what the import told, and the imported file; built once a session and folder of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        c = Commands(spark, f"{folder(spark)}/registry")
        made = stored(t.transcripts(spark, d).select("k", "transcript_id", "gene_id", "contig", "strand", "start", "end", "exons"), "registry-transcripts")  # each file's sort reads them twice
        ends = made.groupBy("contig").agg(F.max("end").alias("length"))
        # coordinates grow with the orders, so a contig is longer than a row can be
        rows = ends.select("*", F.explode(F.sequence(F.lit(-1).cast("long"), F.floor((F.col("length") - 1) / LINE))).alias("j"))
        bases = F.repeat(F.lit("A"), F.least(F.lit(LINE), F.col("length") - F.col("j") * LINE).cast("int"))
        fasta = f"{folder(spark)}/genome.fa.gz"
        files.write_lines(rows, ["contig", "j"], fasta, line=F.when(F.col("j") < 0, F.concat(F.lit(">"), "contig")).otherwise(bases))
        seen = gtf_file(t.observed(spark, d, made), "observed.gtf")
        c.initialize(fasta, "driver", gtf_file(t.reference(spark, d, made), "reference.gtf"), "v1")
        released(spark, made)
        _built[key] = c, c.import_file(seen, "s", "t", "v1", splice=100, end=400), seen
    return _built[key]


@query("SELECT query_id AS transcript_id, label, CASE WHEN label IN ('known', 'novel_in_known_gene') THEN output_gene_id END AS gene, CASE WHEN label = 'known' THEN output_transcript_id END AS reference, gene_candidates FROM classified")
def registry_observations(spark, d):
    """L init and add, A13, D7, D8, J7: stored observations; genes that are loci are left out, as SQL has no accessions."""
    o = _registry(spark, d)[0].observations()
    gene = F.when(~F.col("output_gene_id").startswith("txid:GL1."), F.col("output_gene_id"))
    return o.select("transcript_id", "label", gene.alias("gene"), F.when(F.col("label") == "known", F.col("output_transcript_id")).alias("reference"), "gene_candidates")


@query("SELECT 'imports' AS metric, 1::BIGINT AS n UNION ALL SELECT 'observations', count(*) FROM obs UNION ALL SELECT 'forms', count(DISTINCT form_id) FROM obs UNION ALL SELECT 'chains', count(DISTINCT chain_id) FROM obs UNION ALL SELECT 'single_exon', count(*) FROM obs WHERE chain_id IS NULL UNION ALL SELECT label, count(*) FROM classified GROUP BY label")
def registry_counts(spark, d):
    """E7, E8, L inspect: the summary of a stored registry."""
    s = _registry(spark, d)[0].summary()
    rows = [(k, s[k]) for k in ("imports", "observations", "forms", "chains", "single_exon")] + sorted(s["classifications"].items())
    return spark.createDataFrame(rows, "metric string, n long")


@query("SELECT false AS created, count(*) AS transcripts, count(*) AS observations FROM obs")
def registry_replay(spark, d):
    """The same file again gives the stored import and changes nothing."""
    c, _, seen = _registry(spark, d)
    again = c.import_file(seen, "s", "t", "v1")
    return spark.createDataFrame([(again["created"], again["transcripts"], c.registry.table("observation").count())], "created boolean, transcripts long, observations long")


@query("SELECT count(*) AS observations, count(*) AS clustered, 0::BIGINT AS strays FROM obs")
def registry_clusters(spark, d):
    """Every observation has a cluster of the current run, and no member is without an observation."""
    c = _registry(spark, d)[0]
    o = c.observations()
    strays = c.registry.table("fuzzy_member").join(o.select("form_id"), "form_id", "left_anti").count()
    return o.agg(F.count(F.lit(1)).alias("observations"), F.count("fuzzy_cluster").alias("clustered")).withColumn("strays", F.lit(strays).cast("long"))


@query("SELECT count(*) AS forms, count(chain_id) AS chains FROM (SELECT DISTINCT form_id, chain_id FROM (SELECT form_id, chain_id FROM ref UNION ALL SELECT form_id, chain_id FROM obs))")
def registry_structures(spark, d):
    """Structures stored once, of the annotation and the observations."""
    s = _registry(spark, d)[0].registry.table("structural_object")
    chains = F.col("public_id").contains("SC1.")
    return s.agg(F.count(F.when(~chains, 1)).alias("forms"), F.count(F.when(chains, 1)).alias("chains"))


@query("SELECT 'digest' AS problem, count(DISTINCT form_id) AS n FROM (SELECT form_id, exon_count FROM ref UNION ALL SELECT form_id, exon_count FROM obs) WHERE exon_count > 1 UNION ALL SELECT 'observation without form_id', count(*) FROM obs WHERE exon_count = 1")
def registry_validation(spark, d):
    """L validate, C14, C15: what validation tells of a copy with wrong digests of all forms that it holds, and without single exons' forms."""
    c = _registry(spark, d)[0]
    broken = Commands(spark, f"{folder(spark)}/registry")
    tables = {name: c.registry.table(name) for name in ("annotation_context", "contig", "reference_transcript", "import_manifest", "locus", "observation", "structural_object")}
    of = F.split_part("public_id", F.lit("."), F.lit(1))
    s = tables["structural_object"].filter(of != "txid:SE1")
    tables["structural_object"] = s.withColumn("full_digest", F.when(of == "txid:SC1", F.col("full_digest")).otherwise(F.sha2("full_digest", 256)))
    # the reference keeps no single exon either, so that only observations miss theirs
    tables["reference_transcript"] = tables["reference_transcript"].filter(~F.col("form_id").contains("SE1."))
    broken.registry.commit(tables)
    return broken.validate()


@query("SELECT count(*) FILTER (false) AS problems FROM obs")
def registry_is_valid(spark, d):
    """L validate: the registry itself has no problems."""
    return _registry(spark, d)[0].validate().agg(F.count(F.lit(1)).alias("problems"))


@query("SELECT query_id AS transcript_id, label FROM classified WHERE form_id = (SELECT min(form_id) FROM obs) OR output_gene_id = (SELECT min(output_gene_id) FROM classified WHERE label = 'novel_in_known_gene')")
def registry_inspection(spark, d):
    """L inspect: observations that a form's or a gene's identifier names."""
    c = _registry(spark, d)[0]
    t_ids = t.observed(spark, d).agg(F.min_by("query_id", "form_id").alias("q")).first().q
    o = c.observations()
    form = o.filter(F.col("transcript_id") == t_ids).first().form_id
    gene = o.filter("label = 'novel_in_known_gene'").agg(F.min("output_gene_id").alias("g")).first().g
    return c.inspect(form)["observation"].unionByName(c.inspect(gene)["observation"]).select("transcript_id", "label").distinct()


@query("SELECT count(*) AS rows, count(DISTINCT ordinal) AS ordinals, min(ordinal) AS low, max(ordinal) AS high FROM (SELECT row_number() OVER () AS ordinal FROM obs)")
def registry_ordinals(spark, d):
    """Observations are numbered from 1 without gaps."""
    o = _registry(spark, d)[0].registry.table("observation")
    return o.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ordinal").alias("ordinals"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))


@query("SELECT kind, n FROM (SELECT 'orphans' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT 'parents', 0)", plain=True)
def missing_parents(spark, d):
    """Rows whose parent is missing, here a third of the orders."""
    r = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    orders = r("orders")
    found = registry.orphans({"orphans": (r("lineitem"), "l_orderkey", orders.filter("o_orderkey % 3 <> 0"), "o_orderkey"), "parents": (orders, "o_orderkey", r("lineitem").select(F.col("l_orderkey").alias("k")).unionByName(orders.select(F.col("o_orderkey").alias("k"))), "k")})
    return found.unpivot([], ["orphans", "parents"], "kind", "n")


@query("SELECT sample, sample <> 'F' AS written, sample <> 'F' AS created, count(*) AS transcripts, count(*) + 1 AS lines, 0::BIGINT AS lost FROM obs GROUP BY sample")
def resumed_batch(spark, d):
    """J8, L batch: a file a sample; the batch goes on after the first, whose outputs are as the ledger has them."""
    built, root = _registry(spark, d)[0], folder(spark)
    c = Commands(spark, f"{root}/registry")
    c.registry.commit({name: built.registry.table(name) for name in ("reference_context", "contig", "annotation_context", "structural_object", "reference_transcript")})
    models = stored(t.transcripts(spark, d).select("k", "transcript_id", "gene_id", "contig", "strand", "start", "end", "exons"), "batch-transcripts")
    o = stored(t.observed(spark, d, models), "batch-observed")
    samples = sorted(r.sample for r in o.select("sample").distinct().collect())  # an order's status
    rows = [(gtf_file(o.filter(F.col("sample") == s), f"{s}.gtf"), s, "t", "v1", None) for s in samples]
    released(spark, models, o)
    batch = lambda rows, **more: c.batch(spark.createDataFrame(rows, "input string, sample string, tool string, annotation_name string, format string"), f"{root}/out", **more)
    batch(rows[:1])
    done = batch(rows, completed=1)
    lost = c.lost_artifacts().count()  # of all files, so once is enough
    found = [(x["sample"], x["written"], x["created"], x["transcripts"], spark.read.text(x["mapping"]).count(), lost) for x in done]
    return spark.createDataFrame(found, "sample string, written boolean, created boolean, transcripts long, lines long, lost long")
