"""Simulated truth: transcripts of known labels with two annotation releases, and what callers would report of them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the simulation: spacing of transcripts, and exons (offsets from each base) by kind.
BASE, STEP = 1000, 3000
SHAPES = {
    "spliced": [(0, 99), (300, 399)],
    "novel": [(10, 99), (300, 410)],
    "single": [(50, 180)],
    "between": [(150, 210), (400, 460)],
    "left": [(0, 80), (260, 320)],
    "right": [(250, 330), (550, 620)],
}
#: The label of each place in a cycle of ten.
CYCLE = ["known"] * 5 + ["novel_in_known_gene"] * 2 + ["new_locus", "known", "ambiguous_gene"]


def _exons(kind: str) -> F.Column:
    return F.array(*[F.struct((F.col("base") + a).alias("start"), (F.col("base") + b).alias("end")) for a, b in SHAPES[kind]])


def _rows(spark: SparkSession, n: int) -> DataFrame:
    if n < 10:
        raise ValueError("a simulation needs ten transcripts or more")
    i = F.col("id")
    cycle = F.array(*[F.lit(c) for c in CYCLE])
    name = F.format_string("%05d", i + 1)
    return spark.range(n).select("id", (i % 10).alias("place"), name.alias("name"), (BASE + STEP * i).alias("base"), F.lit("chr1").alias("contig"), F.when(i % 2 == 0, "+").otherwise("-").alias("strand"), cycle[(i % 10).cast("int")].alias("label"))


def truth(spark: SparkSession, n: int) -> DataFrame:
    """truth_id, label, gene_id, contig, strand and exons of n transcripts."""
    single = (F.col("place") == 8) | (F.col("id") % 20 == 7)
    exons = F.when(single, _exons("single")).when(F.col("place").isin(5, 6), _exons("novel")).when(F.col("place") == 9, _exons("between")).otherwise(_exons("spliced"))
    gene = F.when(~F.col("place").isin(7, 9), F.concat(F.lit("G"), "name"))
    return _rows(spark, n).select(F.concat(F.lit("truth:"), "name").alias("truth_id"), "label", gene.alias("gene_id"), "contig", "strand", exons.alias("exons"))


def reference(spark: SparkSession, n: int, release: int = 1) -> DataFrame:
    """The annotation of that truth; the second release also holds what was novel."""
    r = _rows(spark, n).filter("place <> 7")
    made = lambda t, g, x: F.struct(F.concat(*t).alias("transcript_id"), F.concat(*g).alias("gene_id"), x.alias("exons"))
    ref, g = (F.lit("REF"), "name"), (F.lit("G"), "name")
    known = F.array(made(ref, g, F.when(F.col("place") == 8, _exons("single")).otherwise(_exons("spliced"))))
    two = F.array(*[made((*ref, F.lit(s)), (*g, F.lit(s)), _exons(k)) for s, k in (("A", "left"), ("B", "right"))])
    promoted = F.array(made((F.lit("PROMOTED"), "name"), g, _exons("novel")))
    all_ = F.when(F.col("place") == 9, two).when(F.lit(release > 1) & F.col("place").isin(5, 6), F.concat(known, promoted)).otherwise(known)
    return r.select("contig", "strand", F.explode(all_).alias("m")).select("m.*", "contig", "strand")


def observed(truths: DataFrame, samples: list[str], tools: list[str], seed: int = 1, share: float = 0.85) -> DataFrame:
    """What each tool reports in each sample: a share of the truth by a seeded hash, under the tool's own names."""
    runs = F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(t).alias("tool")) for s in samples for t in tools]))
    rows = truths.withColumn("run", runs).select("*", "run.*").drop("run")
    draw = F.pmod(F.xxhash64(F.lit(seed), "sample", "tool", "truth_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.filter(draw).withColumn("transcript_id", F.concat_ws(".", "tool", "sample", F.substring(F.sha2("truth_id", 256), 1, 10)))


def gtf_lines(models: DataFrame, seed: int = 1) -> DataFrame:
    """Exon records of models in an order that the seed shuffles; columns at and line."""
    x = models.select("contig", "strand", "transcript_id", "gene_id", F.explode("exons").alias("x"))
    attributes = F.concat(F.coalesce(F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; ')), F.lit("")), F.lit('transcript_id "'), "transcript_id", F.lit('";'))
    line = F.concat_ws("\t", "contig", F.lit("simulated"), F.lit("exon"), "x.start", "x.end", F.lit("."), "strand", F.lit("."), attributes)
    return x.select(F.xxhash64(F.lit(seed), "transcript_id", "x").alias("at"), line.alias("line"))


def shuffled(items: list, seed: int) -> list:
    """A list of inputs in a seeded order."""
    out = list(items)
    random.Random(seed).shuffle(out)
    return out
