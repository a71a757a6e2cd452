"""Lines of text files with their addresses, and rewrites of annotation files that keep the order of lines.

An address is the file, the block that a task read, and the place within the block. Blocks are read by
different tasks, so a file of any size is rewritten by all of them; the sink sorts by address. A folder of parts counts as one file:
its blocks are those of the parts, in the order of the parts' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.export import formatted_attributes
from strandlake.session import stored
from strandlake.sinks import files

from .annotation import AnnotationError, gtf_attributes

ADDRESS = ["file", "block", "place"]
#: Features and attributes that an identity view keeps.
KEPT_FEATURES, IDENTIFIERS = ["exon", "transcript"], ["gene_id", "transcript_id"]


def addressed(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """value, file, block and place of each line; lines end as usual, or at the separator alone."""
    lines, part = spark.read.text(path, lineSep=separator), F.col("_metadata.file_path")
    folder = isinstance(path, str) and (f := files.Files(spark, path)).fs.getFileStatus(f.path(path)).isDirectory()
    block = F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("start"))
    return lines.select("value", (F.lit(path) if folder else part).alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("place"))


def with_numbers(lines: DataFrame) -> DataFrame:
    """All lines of addressed() with `number`, from 1 in each file. A block's places follow each other, so only its first and its count are needed."""
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = blocks.select("file", F.col("block").alias("_b"), F.col("_n").alias("_m"))
    # as many rows as blocks
    base = blocks.join(earlier, "file").groupBy("file", "block", "_first").agg(F.coalesce(F.sum(F.expr("IF(_b < block, _m, 0)")), F.lit(0)).alias("_base"))
    return lines.join(base, ["file", "block"]).withColumn("number", F.col("_base") + F.col("place") - F.col("_first") + 1).drop("_first", "_base")


def parted(lines: DataFrame, width: int = 9) -> DataFrame:
    """lines with `fields`, and `kind`: comment, blank, malformed (not `width` columns) or record."""
    fields = F.split("value", "\t")
    kind = F.when(F.col("value").startswith("#"), "comment").when(F.trim("value") == "", "blank").when(F.size(fields) != width, "malformed").otherwise("record")
    return lines.withColumns({"fields": fields, "kind": kind})


def feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """n lines by kind, contig, source and feature; the three are null for all but records. No line is left out."""
    rows = parted(addressed(spark, path))
    shown = [F.when(F.col("kind") == "record", F.get("fields", F.lit(k))).alias(c) for k, c in enumerate(("contig", "source", "feature"))]
    return rows.groupBy("kind", *shown).agg(F.count(F.lit(1)).alias("n"))


def _refuse(rows: DataFrame, path: str, what) -> None:
    """Raise for the first of the rows, with its line number."""
    if bad := rows.orderBy("number").head(1):
        raise AnnotationError(f"{path}:{bad[0].number}: {what(bad[0])}")


def _audited(files_: files.Files, source: str, target: str, **found) -> dict:
    return {"source": source, "source_bytes": files_.size(source), "source_sha256": files_.sha256(source), "output": target, "output_bytes": files_.size(target), "output_sha256": files_.sha256(target), **found}


def _by(rows: DataFrame, *keys) -> dict[str, int]:
    """Counts by a short list of names."""
    return {r[0]: r["count"] for r in rows.groupBy(*keys).count().orderBy(*keys).collect()}


def _free(spark: SparkSession, source: str, target: str) -> files.Files:
    out = files.Files(spark, target)
    files.distinct_paths(out, [source], [target])
    if out.fs.exists(out.path(target)):
        raise files.OutputError(f"{target} exists")
    return out


def contig_subset(spark: SparkSession, source: str, target: str, contigs: DataFrame) -> dict:
    """Write the comments and the records of the named contigs, byte by byte in their order; contigs: name.

    Refuses lines without nine columns, a subset without records and a target that exists, and then writes nothing. Returns what was counted.
    """
    out = _free(spark, source, target)
    rows = parted(addressed(spark, source))
    # a blank line has one column, which is not nine
    if rows.filter("kind IN ('malformed', 'blank')").head(1):
        _refuse(parted(with_numbers(addressed(spark, source))).filter("kind IN ('malformed', 'blank')"), source, lambda r: f"expected 9 columns, found {len(r.fields)}")
    named = contigs.select(F.col("name").alias("_contig")).distinct()
    records = rows.filter("kind = 'record'").withColumn("_contig", F.get("fields", F.lit(0))).join(named, "_contig", "left_semi")
    kept = stored(records.unionByName(rows.filter("kind = 'comment'").withColumn("_contig", F.lit(None).cast("string"))).select("value", *ADDRESS, "kind", F.get("fields", F.lit(2)).alias("feature")), "subset-lines")
    features = _by(kept.filter("kind = 'record'"), "feature")
    if not features:
        raise AnnotationError(f"{source}: the contigs have no records")
    files.write_lines(kept.withColumnRenamed("value", "line"), ADDRESS, target)
    return _audited(out, source, target, comments=kept.filter("kind = 'comment'").count(), records=sum(features.values()), features=features)


def identity_view(spark: SparkSession, source: str, target: str) -> dict:
    """Write exon and transcript records with gene_id and transcript_id as their only attributes, all other columns and the order as they are.

    An id that is missing or has two values, a second record of a transcript, a transcript without exons, a file without exons and a line without nine columns
    are refused, and nothing is written. Keys that repeat within a record are counted, by key. Returns what was counted.
    """
    out = _free(spark, source, target)
    rows = parted(with_numbers(addressed(spark, source))).filter("kind NOT IN ('comment', 'blank')")
    _refuse(rows.filter("kind = 'malformed'"), source, lambda r: f"expected 9 columns, found {len(r.fields)}")
    feature = F.lower(F.get("fields", F.lit(2)))
    read = _by(rows.withColumn("feature", feature), "feature")
    rows = rows.withColumn("feature", feature).filter(F.col("feature").isin(KEPT_FEATURES)).withColumn("text", F.get("fields", F.lit(8)))
    rows = rows.withColumn("attributes", gtf_attributes("text"))
    values = {k: F.array_sort(F.array_distinct(F.transform(F.filter("attributes", lambda a: a["key"] == k), lambda a: a["value"]))) for k in IDENTIFIERS}  # noqa: B023
    head, keys = F.concat_ws("\t", F.slice("fields", 1, 8)), F.transform("attributes", lambda a: a["key"])
    rows = stored(rows.withColumns({**values, "head": head, "keys": keys}).select(*ADDRESS, "number", "feature", "head", "keys", *IDENTIFIERS), "identity-lines")
    for k in IDENTIFIERS:
        _refuse(rows.filter(F.size(k) != 1), source, lambda r: f"{r.feature} without {k}" if not r[k] else f"{k} has the values {r[k]}")  # noqa: B023
    one = rows.withColumns({k: F.col(k)[0] for k in IDENTIFIERS})
    own = one.filter("feature = 'transcript'")
    _refuse(own.join(own.groupBy("transcript_id").agg(F.min("number").alias("_first")), "transcript_id").filter("number > _first"), source, lambda r: f"a second record of transcript {r.transcript_id}")
    exons = one.filter("feature = 'exon'").select("transcript_id").distinct()
    with_exons = exons.count()
    if not with_exons:
        raise AnnotationError(f"{source}: no exons")
    if lone := own.join(exons, "transcript_id", "left_anti").count():
        raise AnnotationError(f"{source}: {lone} transcripts without exons")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in IDENTIFIERS])
    line = F.concat_ws("\t", "head", formatted_attributes(pairs))
    files.write_lines(one.withColumn("line", line), ADDRESS, target, "# identity view: coordinates, gene_id and transcript_id")
    # a line's keys lie in one row, so nothing is dealt out by line
    more = rows.withColumn("key", F.explode(F.array_distinct("keys"))).withColumn("more", F.size("keys") - F.size(F.array_remove("keys", F.col("key"))) - 1)
    repeated = {r.key: r.n for r in more.filter("more > 0").groupBy("key").agg(F.sum("more").alias("n")).orderBy("key").collect()}  # a row a key
    return _audited(out, source, target, read=read, kept=_by(one, "feature"), repeated=repeated, transcripts=own.count(), with_exons=with_exons)
