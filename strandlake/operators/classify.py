"""Classification against a reference annotation: exact form first, then same-strand overlap with gene spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the position bins of the overlap join, in bases.
BIN = 131_072


def gene_spans(reference: DataFrame) -> DataFrame:
    """Least start and greatest end of a gene on a contig and strand; gaps within count."""
    return reference.filter("gene_id IS NOT NULL").groupBy("gene_id", "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def overlaps(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("contig", "strand"), bin_width: int = BIN) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals overlap: left's columns, right's as r_*.

    Both sides are dealt to the bins they touch and joined by bin; a pair is kept in the bin where
    the later of the two starts, so it appears once.
    """
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))))
    r = bins(right)
    r = r.select(*[F.col(c).alias(c if c in (*keys, "_bin") else f"r_{c}") for c in r.columns])
    both = bins(left).join(r, [*keys, "_bin"])
    return both.filter(
        (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_bin") == F.floor(F.greatest("start", "r_start") / bin_width))
    ).drop("_bin")


def classified(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """queries: query_id, transcript_id, contig, strand, start, end, form_id; adds label, output ids and gene_candidates.

    reference: gene_id, transcript_id, contig, strand, start, end, form_id. An exact match is the
    reference with the query's own name, else the least transcript, then gene (null as empty).
    """
    by_form = reference.groupBy("form_id").agg(
        F.array_sort(F.collect_list(F.struct("transcript_id", F.coalesce("gene_id", F.lit("")).alias("g"), "gene_id"))).alias("hits")
    )
    matched = queries.join(by_form, "form_id", "left")
    own = F.filter("hits", lambda h: h["transcript_id"] == F.col("transcript_id"))
    best = F.when(F.size(own) > 0, own[0]).otherwise(F.col("hits")[0])
    exact = matched.filter("hits IS NOT NULL").withColumn("best", best)
    exact = exact.select(
        *queries.columns,
        F.lit("known").alias("label"),
        F.col("best.gene_id").alias("output_gene_id"),
        F.col("best.transcript_id").alias("output_transcript_id"),
        F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h["gene_id"]), lambda g: g.isNotNull()))).alias("gene_candidates"),
    )
    rest = matched.filter("hits IS NULL").select(*queries.columns)
    found = overlaps(rest.select("query_id", "contig", "strand", "start", "end"), gene_spans(reference))
    genes = found.groupBy("query_id").agg(F.array_sort(F.collect_set("r_gene_id")).alias("genes"))
    rest = rest.join(genes, "query_id", "left")
    n = F.coalesce(F.size("genes"), F.lit(0))
    rest = rest.select(
        *queries.columns,
        F.when(n == 1, "novel_in_known_gene").when(n > 1, "ambiguous_gene").otherwise("new_locus").alias("label"),
        F.when(n == 1, F.col("genes")[0]).alias("output_gene_id"),
        F.col("form_id").alias("output_transcript_id"),
        F.coalesce("genes", F.array().cast("array<string>")).alias("gene_candidates"),
    )
    return exact.unionByName(rest)
