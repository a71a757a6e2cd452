"""GTF and GFF3 annotations, FASTA references and alias tables as DataFrames."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.structure import problems
from strandlake.functions.text import last_value, percent_decoded, unescaped
from strandlake.session import released, small_batches, stored

#: Features that carry a transcript's own record, by format.
TRANSCRIPTS = {"gtf": ["transcript", "mrna"], "gff3": ["mrna", "transcript", "lnc_rna", "ncrna", "rrna", "trna"]}
#: A GTF attribute: a key and a quoted value with escapes, or a bare one.
PAIR = r'\s*([^\s;"]+)\s+(?:"((?:[^"\\]|\\.)*)"|([^;"\s][^;"]*?))\s*(?:;|$)'

#: Bases of a row at most while a sequence is on its way to its digest. Spark's reader takes 4096 rows at once, so these are 32 MB.
PIECE = 1 << 13


class AnnotationError(ValueError):
    """Input that is no valid annotation or reference."""


def file_format(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    if name.endswith(".gtf"):
        return "gtf"
    if name.endswith((".gff3", ".gff")):
        return "gff3"
    raise AnnotationError(f"give the format of {path}")


def gtf_attributes(c: str) -> F.Column:
    keys, quoted, bare = (F.regexp_extract_all(c, F.lit(PAIR), F.lit(k)) for k in (1, 2, 3))
    values = F.zip_with(quoted, bare, lambda q, b: F.when(b != "", b).otherwise(unescaped(q)))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def gff3_attributes(c: str) -> F.Column:
    """Fields are parted before they are decoded."""
    fields = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))
    return F.transform(fields, lambda x: F.struct(percent_decoded(F.substring_index(x, "=", 1)).alias("key"), percent_decoded(F.regexp_replace(x, r"^[^=]*=", "")).alias("value")))


def records(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One row a feature line, in the order of `at`, with a column `error` that is null for good lines."""
    fmt = fmt or file_format(path)
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).filter("trim(value) <> '' AND NOT startswith(value, '#')")
    p = F.split(F.col("value"), "\t")
    cols = ["contig", "source", "feature", "start", "end", "score", "strand", "phase", "text"]
    df = lines.select("at", F.size(p).alias("n"), *[F.try_element_at(p, F.lit(k + 1)).alias(c) for k, c in enumerate(cols)])
    df = df.withColumns({c: F.col(c).try_cast("bigint") for c in ("start", "end")})
    df = df.withColumn("attributes", gtf_attributes("text") if fmt == "gtf" else gff3_attributes("text"))
    keys = ["gene_id", "transcript_id"]
    twice = F.lit(False)
    if fmt == "gtf":
        # what no attribute covers: an open quote, a key without a value, text after a closing quote
        malformed = F.rlike(F.regexp_replace("text", PAIR, ""), F.lit(r"[^\s;]"))
        for k in keys:
            found = F.transform("attributes", lambda a: a["key"])
            twice = twice | (F.size(found) - F.size(F.array_remove(found, k)) > 1)
    else:
        names = F.transform("attributes", lambda a: a["key"])
        twice = F.size(names) != F.size(F.array_distinct(names))
        malformed = (F.trim("text") != ".") & F.exists(F.split("text", ";"), lambda x: (F.trim(x) != "") & ~F.rlike(x, F.lit("^[^=]+=")))
    error = F.when(F.col("n") != 9, "not nine columns").when(F.col("start").isNull() | F.col("end").isNull(), "no integer coordinates").when((F.col("start") < 1) | (F.col("end") < F.col("start")), "invalid interval")
    error = error.when(~F.col("strand").isin("+", "-", "."), "invalid strand").when(malformed, "malformed attributes").when(twice, "repeated key")
    return df.withColumn("error", error).drop("n", "text")


def transcripts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """transcript_id, gene_id, contig, strand, exons, source and attributes of each transcript; raises on what is not valid.

    A transcript with more than one gene, contig or strand is an error, whatever the order of lines. Of a
    transcript's own records the last in the file gives source and attributes; without one there are none.
    """
    fmt = fmt or file_format(path)
    rows = records(spark, path, fmt).filter(F.lower("feature").isin("exon", *TRANSCRIPTS[fmt]) | F.col("error").isNotNull())
    if fmt == "gtf":
        rows = rows.withColumns({"transcript_id": last_value("attributes", "transcript_id"), "gene_id": last_value("attributes", "gene_id")})
    rows = stored(rows, "annotation-records")  # parsed once; the checks below read it again and again
    if bad := rows.filter("error IS NOT NULL").head(1):
        raise AnnotationError(f"{bad[0].error}: {bad[0].contig} {bad[0].feature} {bad[0].start} {bad[0].end}")
    is_exon = F.lower("feature") == "exon"
    if fmt == "gtf":
        missing = rows.filter("coalesce(transcript_id, '') = ''")
    else:
        parents = F.filter(F.split(F.coalesce(last_value("attributes", "Parent"), F.lit("")), ","), lambda x: x != "")
        rows = rows.withColumn("parents", parents)
        exons = rows.filter(is_exon).withColumn("transcript_id", F.explode("parents")).withColumn("gene_id", last_value("attributes", "gene_id"))
        meta = rows.filter(~is_exon).withColumn("transcript_id", last_value("attributes", "ID"))
        meta = meta.withColumn("gene_id", F.when(F.size("parents") == 1, F.col("parents")[0]))
        missing = meta.filter("coalesce(transcript_id, '') = ''").select("feature").unionByName(rows.filter(is_exon & (F.size("parents") == 0)).select("feature"))
        rows = exons.unionByName(meta)
    if missing.head(1):
        raise AnnotationError("a record names no transcript")
    exon = F.struct("start", "end", "source", "score", "phase", "attributes")
    of = lambda c, own=False: F.when(~is_exon if own else is_exon, c)
    # one pass: values differ if the least and the greatest do
    out = rows.groupBy("transcript_id").agg(
        F.array_sort(F.collect_list(of(exon))).alias("exons"), F.min(of(F.col("contig"))).alias("contig"), F.min(of(F.col("strand"))).alias("strand"), F.max(of(F.col("contig"))).alias("_contig"), F.max(of(F.col("strand"))).alias("_strand"),
        F.min_by("source", of(F.col("at"))).alias("exon_source"), F.max_by(F.struct("contig", "strand", "source", "attributes"), of(F.col("at"), True)).alias("own"),
        F.min("gene_id").alias("_low"), F.max("gene_id").alias("_high"), F.min(of(F.col("gene_id"), True)).alias("_own_low"), F.max(of(F.col("gene_id"), True)).alias("_own_high"), F.count_if(~is_exon).alias("_owns"),
    ).filter(F.size("exons") > 0)
    # in GFF3 the transcript's own records tell the gene if there are any
    low, high = (F.when(F.lit(fmt == "gff3") & (F.col("_owns") > 0), F.col(f"_own{c}")).otherwise(F.col(c)) for c in ("_low", "_high"))
    out = out.withColumn("gene_id", high)
    error = F.when((F.col("contig") != F.col("_contig")) | (F.col("strand") != F.col("_strand")), "more than one contig or strand").when(low != high, "more than one gene").when((F.col("own.contig") != F.col("contig")) | (F.col("own.strand") != F.col("strand")), "the transcript's record lies elsewhere").otherwise(problems())
    out = stored(out.withColumn("error", error).select("transcript_id", "gene_id", "contig", "strand", "exons", "exon_source", "own", "error"), "annotation-models")
    released(spark, rows)
    if bad := out.filter("error IS NOT NULL").head(1):
        raise AnnotationError(f"transcript {bad[0].transcript_id}: {bad[0].error}")
    attributes = F.coalesce("own.attributes", F.array().cast("array<struct<key:string,value:string>>"))
    return out.select("transcript_id", "gene_id", "contig", "strand", "exons", F.coalesce("own.source", "exon_source").alias("source"), attributes.alias("attributes"))


def detected_format(spark: SparkSession, path: str) -> str:
    """By the file's name, else by its version line or the attributes of its first record."""
    try:
        return file_format(path)
    except AnnotationError:
        first = spark.read.text(path).filter("startswith(value, '##gff-version') OR (trim(value) <> '' AND NOT startswith(value, '#'))").head(1)
        if not first:
            raise
        value = first[0].value
        return "gff3" if value.startswith("##gff-version") or "=" in value.split("\t")[-1].split('"')[0] else "gtf"


def annotation_rows(models: DataFrame) -> DataFrame:
    """What an annotation's fingerprint is taken of: canonical JSON of each transcript as `line`, with the columns that order them."""
    spans = F.transform("exons", lambda x: F.array(x["start"], x["end"]))
    line = F.to_json(F.struct("contig", spans.alias("exons"), "gene_id", "strand", "transcript_id"), {"ignoreNullFields": "false"})
    return models.select("contig", spans.alias("spans"), "strand", F.coalesce("gene_id", F.lit("")).alias("gene"), "transcript_id", line.alias("line"))


def annotation_fingerprint(models: DataFrame) -> str:
    """SHA-256 of the sorted transcripts as one JSON list, streamed through the driver a partition at a time."""
    rows = annotation_rows(models).orderBy("contig", "spans", "strand", "gene", "transcript_id").select("line")
    return "sha256:" + streamed_sha256((r.line for r in rows.toLocalIterator()), "[", ",", "]")


def streamed_sha256(parts, head: str = "", between: str = "", tail: str = "") -> str:
    h = hashlib.sha256(head.encode())
    for i, p in enumerate(parts):
        h.update((between if i else "").encode() + p.encode())
    h.update(tail.encode())
    return h.hexdigest()


def selected_contigs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """name and sequence of the sequences that `wanted` names; all must exist."""
    out = sequences(spark, path).join(wanted.select("name").distinct(), "name", "left_semi")
    if lone := wanted.select("name").join(out, "name", "left_anti").head(1):
        raise AnnotationError(f"no sequence {lone[0].name}")
    return out


def with_gene_names(models: DataFrame) -> DataFrame:
    """A gene_name that only the exons carry, and agree on, is added to the transcript's attributes."""
    own = F.exists("attributes", lambda a: a["key"] == "gene_name")
    names = F.expr("array_distinct(transform(filter(flatten(transform(exons, x -> x.attributes)), a -> a.key = 'gene_name'), a -> a.value))")
    added = F.concat("attributes", F.array(F.struct(F.lit("gene_name").alias("key"), names[0].alias("value"))))
    return models.withColumn("attributes", F.when(~own & (F.size(names) == 1), added).otherwise(F.col("attributes")))


def identity_view(records_: DataFrame) -> DataFrame:
    """Exon and transcript records with only the gene and transcript id; `repeats` counts further values of the two."""
    kept = F.filter("attributes", lambda a: a["key"].isin("gene_id", "transcript_id"))
    out = records_.filter(F.lower("feature").isin("exon", "transcript")).withColumn("attributes", kept)
    return out.withColumn("repeats", F.size("attributes") - F.size(F.array_distinct(F.transform("attributes", lambda a: a["key"]))))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of a FASTA file; one row a sequence, so one sequence must fit a task."""
    parts = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    parts = parts.filter(r"value RLIKE '\\S'")
    head = F.split(F.regexp_replace("value", r"^\s*>", ""), r"\r?\n", 2)
    rows = parts.select(F.substring_index(F.regexp_replace(head[0], r"\s+", " "), " ", 1).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")), r"\s+", "")).alias("s"))
    return rows.withColumnRenamed("s", "sequence")


def _pieces(batches):
    """Lines in their order to one row a header, and rows of at most PIECE bases in capitals; before a block's first header the name is null.

    The lines of a batch lie one after the other in memory, so a sequence's lines need no joining.
    """
    block, name = None, None
    for b in batches:
        value = b.column("value").cast(pa.large_binary())
        at = np.frombuffer(value.buffers()[1], dtype=np.int64)[value.offset : value.offset + b.num_rows + 1]
        data = value.buffers()[2]
        head = np.asarray(pc.match_substring_regex(b.column("value"), r"^\s*>"))
        blocks, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "place"))
        files = np.asarray(pc.dictionary_encode(b.column("file")).indices)
        begins = head.copy()
        begins[1:] |= (blocks[1:] != blocks[:-1]) | (files[1:] != files[:-1])
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(begins), [b.num_rows]]))
        rows = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = b.column("file")[s].as_py(), int(blocks[s])
            if own != block:
                block, name = own, None
            if head[s]:
                name = re.split(r"\s", value[s].as_py().decode().lstrip()[1:], maxsplit=1)[0]
                rows.append((*own, int(place[s]), 0, name, True, None))
                s += 1
            bases = bytes(data[int(at[s]) : int(at[e])]).translate(None, b" \t\n\x0b\x0c\r").upper() if s < e else b""
            rows += [(*own, int(place[s]), 1 + k // PIECE, name, False, bases[k : k + PIECE]) for k in range(0, len(bases), PIECE)]
        if rows:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "block", "place", "part", "own", "header", "bases"])


def _digested(batches):
    """Pieces in the order of names and places to one row a name, with a digest taken as they come."""
    kinds = {"name": pa.string(), "headers": pa.int64(), "length": pa.int64(), "sequence_digest": pa.string(), "ascii": pa.bool_()}
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))
    name = digest = None
    for b in batches:
        done, bases = [], b.column("bases")
        for k, (own, header) in enumerate(zip(b.column("name").to_pylist(), b.column("header").to_pylist())):
            if digest is None or own != name:
                if digest is not None:
                    done.append((name, headers, length, digest.hexdigest(), plain))
                name, headers, length, digest, plain = own, 0, 0, hashlib.sha256(), True
            headers += header
            if not header:
                piece = bases[k].as_py()
                digest.update(piece)
                length, plain = length + len(piece), plain and piece.isascii()
        if done:
            yield table(done)
    if digest is not None:
        yield table([(name, headers, length, digest.hexdigest(), plain)])


def _digested_lines(batches):
    """Lines of a file that one task reads from its first to its last, to one row a sequence."""
    return _digested(pa.RecordBatch.from_arrays([b.column(c) for c in ("own", "header", "bases")], names=["name", "header", "bases"]) for b in _pieces(batches))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """name, length and sequence_digest of each sequence. A line must fit a task, a sequence need not: its pieces pass through one task in their order.

    A gzipped file is read by one task, which takes the digests as it reads; of other files and of folders the pieces are sorted first.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    pieces = lines.filter("trim(value) <> ''").mapInArrow(_pieces, "file string, block long, place long, part int, own string, header boolean, bases binary")
    digests = "name string, headers long, length long, sequence_digest string, ascii boolean"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if path.endswith(".gz") and hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hpath).isFile():
        with small_batches(spark):
            return _sound(stored(lines.filter("trim(value) <> ''").mapInArrow(_digested_lines, digests), "contigs"))
    with small_batches(spark):
        pieces = stored(pieces, "contig-pieces")
        # what a block gets from those before it: one row a block
        blocks = pieces.groupBy("file", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("place"))).alias("last"))
        carried = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        named = pieces.join(blocks.select("file", "block", carried.alias("carried")), ["file", "block"]).withColumn("name", F.coalesce("own", "carried"))
        order = ["name", "file", "block", "place", "part"]
        dealt = named.select(*order, "header", "bases").repartition("name").sortWithinPartitions(*order)
        rows = stored(dealt.mapInArrow(_digested, digests), "contigs")
    released(spark, pieces)
    return _sound(rows)


def _sound(rows: DataFrame) -> DataFrame:
    """The sequences of _digested(); raises if they are not what a FASTA file must hold."""
    if not rows.head(1):
        raise AnnotationError("no sequences")
    if rows.filter("name IS NULL").head(1):
        raise AnnotationError("a sequence stands before any header")
    if rows.filter("NOT ascii").head(1):
        raise AnnotationError("a sequence is not ASCII")
    if rows.filter("name = '' OR length = 0 OR headers > 1").head(1) or rows.groupBy("name").count().filter("count > 1").head(1):
        raise AnnotationError("a sequence has no name, no bases or a name that repeats")
    return rows.select("name", "length", "sequence_digest")


def fingerprint(rows: DataFrame) -> str:
    """SHA-256 over name, length and digest in the order of names; a reference has few sequences."""
    line = F.concat_ws("\t", "name", "length", "sequence_digest")
    joined = rows.agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("x")).select(F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")).alias("t"))
    return "sha256:" + joined.select(F.sha2("t", 256).alias("h")).first()["h"]


def aliases(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """alias and primary; a header line and comments are skipped, targets must exist, an alias has one target."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(value, '#')").select(F.trim(p[0]).alias("alias"), F.trim(F.try_element_at(p, F.lit(2))).alias("primary"))
    rows = rows.filter("NOT (lower(alias) = 'alias' AND lower(primary) = 'primary')").distinct()
    lone = rows.join(names.select(F.col("name").alias("primary")), "primary", "left_anti")
    taken = rows.join(names.select(F.col("name").alias("alias")), "alias").filter("alias <> primary")
    if lone.head(1) or taken.head(1) or rows.groupBy("alias").count().filter("count > 1").head(1):
        raise AnnotationError("an alias has no target, two targets, or is a sequence's name")
    return rows


def resolved(models: DataFrame, names: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Contigs by their primary names; raises for unknown ones and for exons past a contig's end."""
    known = names.select("name", F.col("name").alias("primary"), "length")
    if alias is not None:
        known = known.unionByName(alias.join(names, F.col("primary") == F.col("name")).select(F.col("alias").alias("name"), "primary", "length"))
    out = models.join(known, F.col("contig") == F.col("name"), "left")
    if bad := out.filter("primary IS NULL OR array_max(transform(exons, x -> x.end)) > length").head(1):
        raise AnnotationError(f"transcript {bad[0].transcript_id} is not within a known contig: {bad[0].contig}")
    return out.withColumn("contig", F.col("primary")).drop("name", "primary", "length")
