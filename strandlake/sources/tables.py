"""Tables of other tools: manifests, mappings, tracking, alignments, assembly reports, truth and SQLite files."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import sample_name


class TableError(ValueError):
    """A table that lacks columns, holds malformed rows or contradicts itself."""


def _refuse(bad: DataFrame, why: str) -> None:
    if rows := bad.head(1):
        raise TableError(f"{why}: {rows[0].asDict()}")


def table(spark: SparkSession, path: str, needed: list[str], key: list[str] | None = None, breaks: bool = False) -> DataFrame:
    """A delimited file with a header; null is empty. Values of `key` must not repeat.

    breaks: quoted values may hold line breaks; such a file is read by one task, others are split.
    """
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=breaks, nullValue="", emptyValue="")
    if missing := set(needed) - set(df.columns):
        raise TableError(f"{path} lacks {sorted(missing)}")
    if key:
        _refuse(df.groupBy(*key).count().filter("count > 1"), "repeated key")
    return df


def batch_manifest(spark: SparkSession, path: str) -> DataFrame:
    """input, sample, tool, annotation_name and format (or null), in the order of imports."""
    names = ["input", "sample", "tool", "annotation_name"]
    df = table(spark, path, names)
    df = df if "format" in df.columns else df.withColumn("format", F.lit(None).cast("string"))
    df = df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in [*names, "format"]])
    _refuse(df.filter(" OR ".join(f"{c} IS NULL" for c in names)), "empty field")
    return df.orderBy("annotation_name", "sample", "tool", "input")


def inputs_manifest(spark: SparkSession, inputs: list[str], tool: str, annotation_name: str, samples: list[str] | None = None) -> DataFrame:
    """The same table from a list of files; samples default to the files' names."""
    if samples is not None and len(samples) != len(inputs):
        raise TableError("as many samples as inputs are needed")
    rows = [(i, s, tool, annotation_name) for i, s in zip(inputs, samples or [None] * len(inputs), strict=True)]
    df = spark.createDataFrame(rows, "input string, sample string, tool string, annotation_name string")
    df = df.withColumns({"sample": F.coalesce("sample", F.nullif(sample_name(F.col("input")), F.lit(""))), "format": F.lit(None).cast("string")})
    _refuse(df.filter("sample IS NULL"), "no sample name")
    return df.orderBy("annotation_name", "sample", "tool", "input")


def mapping(spark: SparkSession, path: str) -> DataFrame:
    from strandlake.functions.export import MAPPING

    return table(spark, path, list(MAPPING), ["sample", "tool", "original_transcript_id"])


def tracking(spark: SparkSession, path: str, queries: int) -> DataFrame:
    """Members of comparison clusters: cluster, query (from 1), gene, transcript."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).filter("value <> ''").select(p.alias("p"))
    _refuse(lines.filter(F.size("p") != 4 + queries), f"not {4 + queries} columns")
    lines = lines.select(F.substring_index(F.col("p")[0], "|", 1).alias("cluster"), F.slice("p", 5, queries).alias("q"))
    _refuse(lines.groupBy("cluster").count().filter("count > 1"), "repeated cluster")
    cells = lines.select("cluster", F.posexplode("q").alias("i", "cell")).filter("cell <> '-'")
    items = cells.select("cluster", (F.col("i") + 1).alias("query"), F.explode(F.split("cell", ",")).alias("item"))
    parts = F.split(F.regexp_replace("item", "^[^:]*:", ""), r"\|")
    items = items.withColumns({"parts": parts, "prefix": F.substring_index("item", ":", 1)})
    _refuse(items.filter((F.col("prefix") != F.concat(F.lit("q"), "query")) | ~F.col("item").contains(":") | (F.size("parts") < 2)), "malformed item")
    return items.select("cluster", "query", F.col("parts")[0].alias("gene"), F.col("parts")[1].alias("transcript"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """name and length."""
    p = F.split("value", "\t")
    df = spark.read.text(path).select(p[0].alias("name"), F.try_element_at(p, F.lit(2)).try_cast("bigint").alias("length"))
    _refuse(df.filter("name = '' OR length IS NULL OR length <= 0"), "invalid name or length")
    _refuse(df.groupBy("name").count().filter("count > 1"), "repeated name")
    return df


def assembly_aliases(spark: SparkSession, report: str, index: DataFrame) -> DataFrame:
    """alias and primary: other names of sequences whose browser name is in the index; lengths must agree."""
    p = F.split("value", "\t")
    rows = spark.read.text(report).filter("value <> '' AND NOT startswith(value, '#')").select(p.alias("p"))
    _refuse(rows.filter("size(p) < 10"), "fewer than ten columns")
    rows = rows.select(F.array(F.col("p")[0], F.col("p")[4], F.col("p")[6]).alias("names"), F.col("p")[8].try_cast("bigint").alias("declared"), F.col("p")[9].alias("name"))
    both = rows.filter("name <> 'na'").join(index, "name")
    _refuse(both.filter("declared IS NULL OR declared <> length"), "length differs from the index")
    out = both.select(F.explode("names").alias("alias"), F.col("name").alias("primary")).filter("alias NOT IN ('', 'na') AND alias <> primary").distinct()
    _refuse(out.groupBy("alias").count().filter("count > 1"), "an alias of two sequences")
    return out


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with score (tag AS, else matches), identity and coverages."""
    names = ["query", "qlen", "qstart", "qend", "strand", "target", "tlen", "tstart", "tend", "matches", "alen", "mapq"]
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter("value <> ''").select(p.alias("p"))
    _refuse(rows.filter("size(p) < 12"), "fewer than twelve columns")
    numbers = {n for n in names if n not in ("query", "strand", "target")}
    df = rows.select(*[(F.col("p")[i].try_cast("bigint") if n in numbers else F.col("p")[i]).alias(n) for i, n in enumerate(names)], F.expr("slice(p, 13, size(p))").alias("tags"))
    _refuse(df.filter("coalesce(least(qlen, tlen, alen), 0) <= 0"), "a length that is not positive")
    tag = F.try_element_at(F.filter("tags", lambda t: t.startswith("AS:")), F.lit(-1))
    return df.withColumns(
        {
            "score": F.coalesce(F.regexp_replace(tag, "^[^:]*:[^:]*:", "").try_cast("bigint"), "matches"),
            "identity": F.col("matches") / F.col("alen"),
            "query_coverage": (F.col("qend") - F.col("qstart")) / F.col("qlen"),
            "target_coverage": (F.col("tend") - F.col("tstart")) / F.col("tlen"),
        }
    )


def read_truth(spark: SparkSession, transcripts: str, reads: str) -> DataFrame:
    """Reads with the structure of the transcript that each came from."""
    t = table(spark, transcripts, ["truth_id", "contig", "strand", "introns"], ["truth_id"])
    r = table(spark, reads, ["read_id", "truth_id"])
    _refuse(r.join(t, "truth_id", "left_anti"), "unknown transcript")
    return r.join(t.withColumn("introns", F.from_json("introns", "array<array<bigint>>")), "truth_id")


def truth_models(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sorted exons by transcript from a GTF, by two attributes only."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter("NOT startswith(value, '#') AND trim(value) <> ''").select(p.alias("p")).filter("size(p) >= 9 AND p[2] = 'exon'")
    found = lambda k: F.nullif(F.regexp_extract(F.col("p")[8], f'(?:^|;)\\s*{k} "([^"]*)"', 1), F.lit(""))
    rows = rows.select(found("transcript_id").alias("transcript_id"), found("gene_id").alias("gene_id"), F.col("p")[0].alias("contig"), F.col("p")[6].alias("strand"),
                       F.struct(F.col("p")[3].cast("bigint").alias("start"), F.col("p")[4].cast("bigint").alias("end")).alias("x"))
    _refuse(rows.filter("transcript_id IS NULL"), "an exon without transcript")
    out = rows.groupBy("transcript_id").agg(F.min("gene_id").alias("gene_id"), F.min("contig").alias("contig"), F.min("strand").alias("strand"), F.count_distinct("contig", "strand").alias("places"), F.array_sort(F.collect_set("x")).alias("exons"))
    _refuse(out.filter("places > 1"), "two places of one transcript")
    return out.drop("places")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One table of a SQLite file on the driver's disk, in Arrow batches; such files are outputs of one machine."""
    import pandas as pd

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = [c.split()[0] for c in schema.split(",")]
        chunks = [spark.createDataFrame(c, schema) for c in pd.read_sql_query(f"SELECT {', '.join(columns)} FROM {name}", db, chunksize=500_000) if len(c)]
    out = spark.createDataFrame([], schema)
    for c in chunks:
        out = out.unionByName(c)
    return out


def isoform_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Experiment, transcript and its clusters by ends and by junctions, from an isoform database."""
    p = sqlite_table(spark, path, "PBID", "PBID string, exp bigint, ends_id bigint")
    e = sqlite_table(spark, path, "exp", "id bigint, exp_name string").withColumnRenamed("id", "exp")
    i = sqlite_table(spark, path, "isoform_ends", "id bigint, isoform_id bigint").withColumnRenamed("id", "ends_id")
    return p.join(e, "exp").join(i, "ends_id").select(F.col("exp_name").alias("experiment"), F.col("PBID").alias("transcript"), "ends_id", "isoform_id")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """dataset, read_name and transcript of a long-read database; a read appears once."""
    o = sqlite_table(spark, path, "observed", "dataset string, read_name string, transcript_ID bigint")
    _refuse(o.groupBy("dataset", "read_name").count().filter("count > 1"), "repeated read")
    return o


def splice_paths(spark: SparkSession, path: str) -> DataFrame:
    """Introns of each spliced transcript of a long-read database, in the order of its path."""
    e = sqlite_table(spark, path, "edge", "edge_ID bigint, v1 bigint, v2 bigint, edge_type string, strand string").filter("edge_type = 'intron'")
    at = sqlite_table(spark, path, "location", "location_ID bigint, chromosome string, position bigint")
    e = e.join(at.select(F.col("location_ID").alias("v1"), "chromosome", F.col("position").alias("a")), "v1").join(at.select(F.col("location_ID").alias("v2"), F.col("position").alias("b")), "v2")
    t = sqlite_table(spark, path, "transcripts", "transcript_ID bigint, n_exons bigint, jn_path string").filter("n_exons > 1 AND jn_path <> ''")
    steps = t.select("transcript_ID", F.posexplode(F.split("jn_path", ",")).alias("i", "edge")).withColumn("edge_ID", F.col("edge").cast("bigint"))
    both = steps.join(e, "edge_ID", "left")
    _refuse(both.filter("chromosome IS NULL"), "an unknown edge")
    return both.groupBy("transcript_ID").agg(F.array_sort(F.collect_list(F.struct("i", "chromosome", "strand", "a", "b"))).alias("introns"))


def manifest_problems(datasets: DataFrame, references: DataFrame) -> DataFrame:
    """Problems of a table of data sets: repeated or empty ids, enabled rows without checksum or known reference. problem, dataset_id."""
    on = datasets.filter(F.lower(F.col("enabled")).isin("true", "1", "yes"))
    pick = lambda df, why: df.select(F.lit(why).alias("problem"), "dataset_id")
    out = pick(datasets.filter("coalesce(dataset_id, '') = ''"), "no id")
    out = out.unionByName(pick(datasets.groupBy("dataset_id").count().filter("count > 1"), "repeated id"))
    out = out.unionByName(pick(on.join(references.select("reference_id"), "reference_id", "left_anti"), "unknown reference"))
    return out.unionByName(pick(on.filter("NOT coalesce(rlike(checksum, '^(sha256:[0-9a-f]{64}|md5:[0-9a-f]{32})$'), false)"), "no checksum"))
