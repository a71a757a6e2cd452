"""Structural categories of models against the reference transcripts of their own gene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.sinks import files

#: The columns of a classification table.
COLUMNS = ["isoform", "structural_category", "associated_gene", "associated_transcript", "ref_exons", "exons", "subcategory", "all_canonical", "FL", "length"]


def structural_categories(models: DataFrame, reference: DataFrame, order: str, fused: F.Column | None = None) -> DataFrame:
    """COLUMNS for each model. models and reference: with_shape() with transcript_id and gene_id; order: reference's column that says which match is first.

    The first transcript of the gene with all exons of the model is its match, or else, for models of several exons, the first with its
    introns. Other models of a gene that the reference has are not in the catalog; the rest are fusions where `fused` holds, else
    intergenic. A model without a gene is a gene of its own. Two indices by gene are joined, one by exons and one by introns; no gene's transcripts are gathered.
    """
    spans = F.transform("exons", lambda x: F.array(x["start"], x["end"]))
    gene = F.coalesce("gene_id", F.concat(F.lit("unresolved-"), "transcript_id"))
    place = ["gene", "contig", "strand"]
    known = reference.filter("gene_id IS NOT NULL").withColumns({"gene": F.col("gene_id"), "spans": spans})
    first = F.min_by(F.struct("transcript_id", "exon_count"), order)
    exact = known.groupBy(*place, "spans").agg(first.alias("exact"))
    splice = known.filter("exon_count > 1").groupBy(*place, "introns").agg(first.alias("splice"))
    genes = known.select("gene", F.lit(True).alias("in_reference")).distinct()
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"] + 1)
    df = models.withColumns({"gene": gene, "spans": spans, "fused": F.lit(False) if fused is None else fused, "length": length})
    df = df.join(exact, [*place, "spans"], "left").join(splice, [*place, "introns"], "left").join(genes, "gene", "left")
    match = F.coalesce("exact", "splice")
    category = F.when(match.isNotNull(), "full-splice_match").when(F.col("in_reference"), "novel_not_in_catalog").when(F.col("fused"), "fusion").otherwise("intergenic")
    return df.select(
        F.col("transcript_id").alias("isoform"), category.alias("structural_category"), F.col("gene").alias("associated_gene"), F.coalesce(match["transcript_id"], F.lit("novel")).alias("associated_transcript"),
        F.coalesce(match["exon_count"].cast("string"), F.lit("NA")).alias("ref_exons"), F.col("exon_count").alias("exons"), F.when(F.col("exon_count") == 1, "mono-exon").otherwise("multi-exon").alias("subcategory"),
        F.lit("canonical").alias("all_canonical"), F.lit(1).alias("FL"), "length",
    )


def write_classification(rows: DataFrame, path: str) -> None:
    files.write_table(rows.select(*COLUMNS), path, ["isoform"])
