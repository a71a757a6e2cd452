"""Published test vectors: structures with the identities that they must have, read from one JSON document and computed anew.

A document that gives each vector a line of its own is read by lines, by many tasks; any other one is a single row and must fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.structure import with_identity, with_shape

_IDENTITY = "struct<family:string,public_id:string,full_digest:string,canonical_json:string>"
_VECTOR = f"name:string,contig:string,strand:string,exons:array<array<bigint>>,form:{_IDENTITY},splice_chain:{_IDENTITY}"
SCHEMA = f"assembly_fingerprint string, vectors array<struct<{_VECTOR}>>"
#: Lines of a document by lines: the first, one with a vector, and the last if it has none; the border of two objects in a list.
_HEAD, _LINE, _TAIL = r'^\s*\{\s*("assembly_fingerprint"\s*:\s*"[^"\\]*"\s*,\s*)?"vectors"\s*:\s*\[\s*$', r"^\s*\{.*\}\s*(,|\]\s*\})?\s*$", r"^\s*\]\s*\}\s*$"
_BORDER = r"\}\s*,\s*\{"


def _by_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """assembly_fingerprint and a vector's fields a row, or None if a vector has not a line of its own."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    is_ = lambda pattern: F.rlike("value", F.lit(pattern))
    if not lines.filter(is_(_HEAD)).head(1):
        return None
    text = F.regexp_replace("value", r"(,|\]\s*\})\s*$", "")
    v = F.from_json(text, f"struct<{_VECTOR},_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("kind", F.when(is_(_HEAD), "head").when(is_(_TAIL), "tail").when(is_(_LINE), "line").otherwise("other"))
    rows = rows.withColumn("v", F.when(F.col("kind") == "line", v))
    # more than one object, or none that is whole
    bad = (F.col("kind") == "other") | F.col("v._corrupt").isNotNull() | ((F.col("kind") == "line") & F.rlike(F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', ""), F.lit(_BORDER)))
    ended = F.rlike("value", F.lit(r"\]\s*\}\s*$"))
    heads, ends, bads = rows.agg(F.count_if(F.col("kind") == "head"), F.count_if((F.col("kind") != "head") & ended), F.count_if(bad)).first()
    if (heads, ends, bads) != (1, 1, 0):
        return None
    first = rows.filter("kind = 'head'").select(F.from_json(F.concat("value", F.lit("]}")), SCHEMA).alias("d")).first().d
    return rows.filter("kind = 'line'").select(F.lit(first.assembly_fingerprint).cast("string").alias("assembly_fingerprint"), "v.*").drop("_corrupt")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """vector, role, expected, observed (JSON, null for none), valid: a row for each vector and role."""
    rows = _by_lines(spark, path)
    if rows is None:
        document = spark.read.schema(SCHEMA).json(path, multiLine=True)
        rows = document.select("assembly_fingerprint", F.explode("vectors").alias("v")).select("assembly_fingerprint", "v.*")
    spans = F.transform("exons", lambda x: F.struct(x[0].alias("start"), x[1].alias("end")))
    expected = rows.withColumnsRenamed({"form": "want_form", "splice_chain": "want_splice_chain"}).withColumn("exons", spans)
    made = with_identity(with_shape(expected), F.col("assembly_fingerprint"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.to_json(f"want_{r}").alias("expected"), F.to_json(r).alias("observed")) for r in ("form", "splice_chain")])
    out = made.select(F.col("name").alias("vector"), F.explode(roles).alias("r")).select("vector", "r.*")
    return out.withColumn("valid", F.col("expected").eqNullSafe(F.col("observed")))


def conformance(rows: DataFrame) -> DataFrame:
    """One row: vectors, identities that were expected, and failures."""
    return rows.agg(F.countDistinct("vector").alias("vectors"), F.count("expected").alias("identities"), F.count_if(~F.col("valid")).alias("failures"))
