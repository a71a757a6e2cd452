"""A second, strict reading of GTF files: what it refuses is told by line or transcript, and nothing is repaired.

Lines are judged on their own by expressions over columns, with no shuffle; only lines that are read are grouped by transcript. So the errors
of a file of any size are a table, of which models() raises the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.text import last_value
from strandlake.session import stored

from . import lines
from .annotation import AnnotationError

#: A key, the escapes that a quoted value may hold, and what they stand for besides themselves.
KEY, ESCAPES = r"[A-Za-z_][A-Za-z0-9_.:-]*", {"n": "\n", "r": "\r", "t": "\t"}
QUOTED, BARE = r'"((?>[^"\\]|\\["\\nrt])*+)"', r'([^\s;"\\=]++)(?=\s|;|$)'
#: One attribute with what ends it; groups: key, quoted value, bare value.
PAIR = rf"\G\s*+({KEY})\s++(?:{QUOTED}|{BARE})\s*+(?:;|$)"


def attributes(c: str) -> Column:
    """Keys and values of a text without errors; escapes stand for their characters."""
    keys, quoted, bare = (F.regexp_extract_all(c, F.lit(PAIR), F.lit(k)) for k in (1, 2, 3))
    # a backslash that stands for itself is set aside while the others are taken out
    plain = lambda q: F.replace(q, F.lit("\\\\"), F.lit("\u0000"))

    def unescaped(q: Column) -> Column:
        out = plain(q)
        for letter, meant in ESCAPES.items():
            out = F.replace(out, F.lit(f"\\{letter}"), F.lit(meant))
        return F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\u0000"), F.lit("\\"))

    values = F.zip_with(quoted, bare, lambda q, b: F.when(b != "", b).otherwise(unescaped(q)))
    return F.when(F.col(c) == ".", F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def attribute_error(c: str) -> Column:
    """What is wrong with an attribute column, or null: the first attribute that cannot be read decides."""
    rest = F.regexp_replace(c, rf"^(?:\s*+{KEY}\s++(?:{QUOTED}|{BARE})\s*+(?:;|$))*+\s*+", "")
    has = lambda pattern: F.rlike(rest, F.lit(pattern))
    return (
        F.when((F.col(c) == ".") | (rest == ""), None)
        .when(~has(rf"^{KEY}"), "malformed attribute name")
        .when(has(rf"^{KEY}+(?:\S|$)"), "an attribute without white space and a value")
        .when(has(rf"^{KEY}\s+(?:$|;)"), "an attribute without a value")
        .when(has(rf'^{KEY}\s+"(?>[^"\\]|\\["\\nrt])*+\\'), "an unknown or open escape")
        .when(has(rf'^{KEY}\s+"(?>[^"\\]|\\["\\nrt])*+$'), "an open quote")
        .when(has(rf'^{KEY}\s+[^\s;"\\=]*["\\=]') & ~has(rf'^{KEY}\s+"'), "a malformed bare value")
        .otherwise("no semicolon after an attribute")
    )


def read(spark: SparkSession, path: str, lengths: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """number, error and the columns of each line that is neither blank nor a comment. lengths: name, length of the only contigs allowed; aliases: alias, primary."""
    if aliases is not None and lengths is None:
        raise AnnotationError("aliases need the lengths of their contigs")
    rows = lines.parted(lines.with_numbers(lines.addressed(spark, path))).filter("kind <> 'blank' AND NOT ltrim(value) LIKE '#%'")
    names = ["contig", "source", "feature", "start_text", "end_text", "score", "strand", "phase", "text"]
    rows = rows.select("number", "kind", *[F.get("fields", F.lit(k)).alias(n) for k, n in enumerate(names)])
    token = lambda n: F.col(n).isNull() | F.rlike(n, F.lit(r"^$|[\s\x00-\x1f\x7f]"))
    rows = rows.withColumns({n: F.when(F.rlike(f"{n}_text", F.lit("^[0-9]+$")), F.col(f"{n}_text").try_cast("bigint")) for n in ("start", "end")})
    rows = rows.withColumns({"primary": F.col("contig"), "limit": F.lit(None).cast("bigint"), "known": F.lit(True)})
    if lengths is not None:
        names_ = lengths.select("name", F.col("name").alias("primary"), F.col("length").alias("limit"))
        if aliases is not None:
            if aliases.join(lengths.select(F.col("name").alias("primary")), "primary", "left_anti").head(1) or aliases.join(lengths.select(F.col("name").alias("alias")), "alias").filter("alias <> primary").head(1):
                raise AnnotationError("an alias has no target or is a contig's name")
            names_ = names_.unionByName(aliases.join(lengths, F.col("primary") == F.col("name")).select(F.col("alias").alias("name"), "primary", F.col("length").alias("limit"))).distinct()
        rows = rows.drop("primary", "limit", "known").join(names_.withColumns({"contig": F.col("name"), "known": F.lit(True)}).drop("name"), "contig", "left")
    named = lambda n: F.filter("attributes", lambda a: a["key"] == n)
    ids = {n: named(n) for n in ("gene_id", "transcript_id")}
    rows = rows.withColumn("malformed", attribute_error("text"))
    rows = rows.withColumn("attributes", F.when(F.col("malformed").isNull(), attributes("text")))
    error = F.when(F.col("kind") != "record", "not nine columns")
    for n in ("contig", "source", "feature"):
        error = error.when(token(n), f"{n} is empty or has white space")
    error = error.when(F.col("start").isNull() | F.col("end").isNull(), "no decimal coordinates").when((F.col("start") < 1) | (F.col("end") < F.col("start")), "invalid interval")
    number = F.col("score").try_cast("double")
    error = error.when((F.col("score") != ".") & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))), "a score that is no finite number")
    error = error.when(~F.col("phase").isin(".", "0", "1", "2"), "invalid phase").when(~F.col("strand").isin("+", "-", "."), "invalid strand")
    error = error.when(F.col("malformed").isNotNull(), F.col("malformed"))
    for n, found in ids.items():
        error = error.when(F.size(found) > 1, f"{n} twice").when((F.size(found) == 1) & F.rlike(F.get(found, F.lit(0))["value"], F.lit(r"^$|[\x00-\x1f\x7f]")), f"{n} is empty or has control characters")
    error = error.when(F.col("known").isNull(), "an unknown contig").when(F.col("end") > F.col("limit"), "past the end of its contig")
    model = F.col("feature").isin("transcript", "exon")
    error = error.when(model & (F.col("strand") == "."), "a model without a strand").when(model & (F.size(ids["transcript_id"]) == 0), "a model without transcript_id")
    return rows.select("number", error.alias("error"), F.col("primary").alias("contig"), "feature", "start", "end", "strand", *[last_value("attributes", n).alias(n) for n in ids])


def judged(rows: DataFrame) -> DataFrame:
    """Models from the good lines of read(): transcript_id, gene_id, contig, strand, exons, number (its first line) and error."""
    good = rows.filter("error IS NULL AND feature IN ('transcript', 'exon')")
    exon, own = F.col("feature") == "exon", F.col("feature") == "transcript"
    out = good.groupBy("transcript_id").agg(
        F.min("gene_id").alias("gene_id"), F.countDistinct("gene_id").alias("genes"), F.min("contig").alias("contig"), F.min("strand").alias("strand"), F.countDistinct("contig", "strand").alias("places"),
        F.array_sort(F.collect_list(F.when(exon, F.struct("start", "end")))).alias("exons"), F.count_if(own).alias("own"), F.min(F.when(own, F.struct("start", "end"))).alias("bounds"), F.min("number").alias("number"),
    )
    next_to = F.expr("zip_with(slice(exons, 1, greatest(size(exons) - 1, 0)), slice(exons, 2, greatest(size(exons) - 1, 0)), (a, b) -> b.start - a.end)")
    error = F.when(F.col("places") > 1, "more than one contig or strand").when(F.col("genes") > 1, "more than one gene").when(F.col("own") > 1, "a second record of the transcript").when(F.size("exons") == 0, "no exons")
    error = error.when(F.exists(next_to, lambda d: d < 1), "repeated or overlapping exons").when(F.exists(next_to, lambda d: d == 1), "adjacent exons")
    error = error.when((F.col("own") == 1) & ((F.col("bounds.start") != F.expr("exons[0].start")) | (F.col("bounds.end") != F.expr("element_at(exons, -1).end"))), "bounds differ from the exons")
    return out.select("transcript_id", "gene_id", "contig", "strand", "exons", "number", error.alias("error"))


def errors(spark: SparkSession, path: str, lengths: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """number, transcript_id (null for errors of a line) and error of all that is refused."""
    rows = stored(read(spark, path, lengths, aliases), "strict-lines")
    alone = rows.filter("error IS NOT NULL").select("number", F.lit(None).cast("string").alias("transcript_id"), "error")
    return alone.unionByName(judged(rows).filter("error IS NOT NULL").select("number", "transcript_id", "error"))


def models(spark: SparkSession, path: str, lengths: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """transcript_id, gene_id, contig, strand and exons; raises for the first line, else the first transcript, that is refused."""
    rows = stored(read(spark, path, lengths, aliases), "strict-lines")
    if bad := rows.filter("error IS NOT NULL").orderBy("number").head(1):
        raise AnnotationError(f"{path}:{bad[0].number}: {bad[0].error}")
    out = stored(judged(rows), "strict-models")
    if bad := out.filter("error IS NOT NULL").orderBy("transcript_id").head(1):
        raise AnnotationError(f"{path}:{bad[0].number}: transcript {bad[0].transcript_id}: {bad[0].error}")
    if not out.head(1):
        raise AnnotationError(f"{path}: no models")
    return out.drop("number", "error")
