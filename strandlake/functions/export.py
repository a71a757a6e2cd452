"""Column expressions for output: attributes, GTF, genePred, SAM and delimited lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cigar, escaped

#: Fixed values of the rewritten files: the producer, the prefix of attributes that would clash, attributes that come first.
PRODUCER, CLASH, FIRST = "txid", "txid_upstream_", ["gene_id", "transcript_id", "exon_number"]
#: Attributes of every record and the assignment's column that each shows; null ones are left out.
BASE = {
    "gene_id": "output_gene_id",
    "transcript_id": "output_transcript_id",
    "txid_annotation": "annotation_name",
    "txid_classification": "label",
    "txid_form": "form_id",
    "txid_original_transcript_id": "transcript_id",
    "txid_original_gene_id": "gene_id",
    "txid_sc": "chain_id",
    "txid_gene_candidates": "gene_candidates",
    "txid_fuzzy_cluster": "fuzzy_cluster",
    "txid_fuzzy_bridge_status": "bridge_status",
}
#: The mapping table's columns and what each shows.
MAPPING = {
    "sample": "sample",
    "tool": "tool",
    "original_transcript_id": "transcript_id",
    "original_gene_id": "gene_id",
    "txid_transcript_id": "output_transcript_id",
    "txid_gene_id": "output_gene_id",
    "txid_sc": "chain_id",
    "txid_form": "form_id",
    "classification": "label",
    "annotation_name": "annotation_name",
    "gene_candidates": "gene_candidates",
    "fuzzy_cluster": "fuzzy_cluster",
    "fuzzy_bridge_status": "bridge_status",
}
PAIRS = "array<struct<key:string,value:string>>"


def formatted_attributes(attributes: Column) -> Column:
    """Named attributes first, the others by key; repeats keep their order."""
    rank = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in FIRST]), k), F.lit(0)), F.lit(len(FIRST) + 1))
    keyed = F.transform(attributes, lambda a, i: F.struct(rank(a["key"]).alias("r"), a["key"].alias("key"), i.alias("i"), a["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda a: F.concat(a["key"], F.lit(' "'), escaped(a["value"]), F.lit('";'))), " ")


def upstream_attributes(attributes: str, reserved: str) -> Column:
    """The input's attributes without gene and transcript id; a key that is reserved, ID or Parent gets a prefix, repeated until the name is free.

    attributes and reserved are SQL of an array of pairs and an array of names. Names are given in the order
    of the keys' first appearance, so at most one prefix more than there are taken names is needed.
    """
    kept = f"filter(coalesce({attributes}, CAST(array() AS {PAIRS})), a -> a.key NOT IN ('gene_id', 'transcript_id'))"
    least = f"IF(array_contains({reserved}, k) OR k IN ('ID', 'Parent'), 1, 0)"
    names = f"transform(sequence({least}, size({reserved}) + size(m) + 1), i -> concat(repeat('{CLASH}', i), k))"
    free = f"filter({names}, n -> NOT array_contains({reserved}, n) AND NOT exists(m, x -> x.value = n))[0]"
    table = f"aggregate(array_distinct(transform({kept}, a -> a.key)), CAST(array() AS {PAIRS}), (m, k) -> concat(m, array(struct(k AS key, {free} AS value))))"
    return F.expr(f"transform({kept}, a -> struct(map_from_entries({table})[a.key] AS key, a.value AS value))")


def base_attributes() -> Column:
    shown = [F.struct(F.lit(k).alias("key"), (F.nullif(F.col(c), F.lit("")) if c == "gene_candidates" else F.col(c)).alias("value")) for k, c in BASE.items()]
    return F.filter(F.array(*shown), lambda a: a["value"].isNotNull())


def gtf_lines(rows: DataFrame) -> DataFrame:
    """Lines of the rewritten annotation with the columns that order them: a transcript, then its exons.

    rows: transcript_id, gene_id, contig, strand, start, end, exons (with source, score, phase, attributes),
    attributes, and the columns that BASE names. Exons are numbered in the order of transcription.
    """
    df = rows.withColumn("_base", base_attributes()).withColumn("_keys", F.expr("transform(_base, a -> a.key)")).withColumn("_exon_keys", F.expr("concat(_keys, array('exon_number'))"))
    upper = F.concat("_base", upstream_attributes("attributes", "_keys"))
    tab, own, dot = F.lit("\t"), F.lit(PRODUCER), F.lit(".")
    top = F.concat_ws("\t", "contig", own, F.lit("transcript"), "start", "end", dot, "strand", dot, formatted_attributes(upper))
    df = df.withColumn("_x", F.expr(f"transform(exons, (x, i) -> struct(x AS x, IF(strand = '+', i + 1, size(exons) - i) AS number))"))
    df = df.withColumn("_x", F.transform("_x", lambda e: F.struct(e["x"].alias("x"), e["number"].alias("number"), e["x"]["attributes"].alias("attributes"))))
    df = df.withColumn("_top", top).select("contig", "start", "end", "strand", "form_id", "transcript_id", "_base", "_exon_keys", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("position"), F.col("_top").alias("line"), F.lit(None).cast(df.schema["_x"].dataType.elementType).alias("e"))), F.transform("_x", lambda e, i: F.struct((i + 1).alias("position"), F.lit(None).cast("string").alias("line"), e.alias("e"))))).alias("p"))
    df = df.withColumns({"position": F.col("p.position"), "_a": F.col("p.e.attributes")})
    number = F.array(F.struct(F.lit("exon_number").alias("key"), F.col("p.e.number").cast("string").alias("value")))
    source = F.when(F.col("p.e.x.source") == ".", own).otherwise(F.col("p.e.x.source"))
    exon = F.concat(
        F.concat_ws("\t", "contig", source, F.lit("exon"), F.col("p.e.x.start"), F.col("p.e.x.end"), F.col("p.e.x.score"), "strand", F.col("p.e.x.phase")),
        tab,
        formatted_attributes(F.concat("_base", number, upstream_attributes("_a", "_exon_keys"))),
    )
    return df.select("contig", "start", "end", "strand", "form_id", "transcript_id", "position", F.coalesce(F.col("p.line"), exon).alias("line"))


def delimited(columns: list[Column], separator: str = "\t") -> Column:
    """One line of a delimited file: nulls are empty, a field is quoted if it must be."""

    def field(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.rlike(s, F.lit(f'[{separator}"\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(separator, *[field(c) for c in columns])


def genepred_line() -> Column:
    """A transcript as genePred: starts count from 0, exon lists end with a comma."""
    listed = lambda f: F.concat(F.array_join(F.transform("exons", lambda x: f(x).cast("string")), ","), F.lit(","))
    s0 = F.col("start") - 1
    return F.concat_ws("\t", "transcript_id", "contig", "strand", s0, "end", s0, "end", F.size("exons"), listed(lambda x: x["start"] - 1), listed(lambda x: x["end"]))


def sam_line(bases: Column) -> Column:
    """A transcript as a SAM record: bases from left to right on the contig, 16 for the reverse strand."""
    flag = F.when(F.col("strand") == "-", 16).otherwise(0)
    return F.concat_ws("\t", "transcript_id", flag, "contig", "start", F.lit(60), cigar(), F.lit("*"), F.lit(0), F.lit(0), bases, F.lit("*"))


def neutral_gtf_lines(rows: DataFrame) -> DataFrame:
    """Gene, transcript and exon records of plain models; a transcript without gene is its own gene."""
    gene = F.coalesce("gene_id", F.concat(F.lit("unresolved-"), "transcript_id"))
    df = rows.withColumn("g", gene)
    ids = lambda *k: formatted_attributes(F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in k]))
    line = lambda kind, s, e, a: F.concat_ws("\t", "contig", F.lit("model"), F.lit(kind), s, e, F.lit("."), "strand", F.lit("."), a)
    g, t = ("gene_id", F.col("g")), ("transcript_id", F.col("transcript_id"))
    genes = df.groupBy("contig", "strand", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    genes = genes.select("contig", "strand", "g", F.lit("").alias("transcript_id"), F.lit(0).alias("position"), line("gene", "start", "end", ids(g)).alias("line"))
    models = df.select("contig", "strand", "g", "transcript_id", F.lit(0).alias("position"), line("transcript", "start", "end", ids(g, t)).alias("line"))
    x = df.select("contig", "strand", "g", "transcript_id", F.size("exons").alias("n"), F.posexplode("exons").alias("i", "x"))
    number = F.when(F.col("strand") == "+", F.col("i") + 1).otherwise(F.col("n") - F.col("i"))
    exons = x.select("contig", "strand", "g", "transcript_id", (F.col("i") + 1).alias("position"), line("exon", F.col("x.start"), F.col("x.end"), ids(g, t, ("exon_number", number))).alias("line"))
    return genes.unionByName(models).unionByName(exons)


def spliced(sequence: str = "sequence") -> Column:
    """A transcript's bases in the order of transcription, from its contig's sequence."""
    bases = F.expr(f"array_join(transform(exons, x -> substring({sequence}, CAST(x.start AS INT), CAST(x.end - x.start + 1 AS INT))), '')")
    return F.when(F.col("strand") == "-", F.reverse(F.translate(bases, "ACGTNacgtn", "TGCANtgcan"))).otherwise(bases)


def wrapped(c: Column, width: int = 80) -> Column:
    """Lines of a sequence, without a break at the end."""
    return F.regexp_replace(c, f"(.{{{width}}})(?=.)", "$1\n")
