"""Scalar functions on names, attributes, sequences and accessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """A name for files: other characters as one underscore, no dots or underscores at the ends."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unnamed"))


def sample_name(path: Column) -> Column:
    """A file's name without folder, .gz and an annotation suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.(gtf|gff3|gff)$", "")


def escaped(c: Column) -> Column:
    """A GTF attribute value: backslash, quote and line break are escaped."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def unescaped(c: Column) -> Column:
    """A backslash is dropped, what follows it stays; an escaped n therefore becomes an n."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def percent_decoded(c: Column) -> Column:
    """Percent escapes as UTF-8. A plus stays; a text with a malformed escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTNacgtn", "TGCANtgcan"))


def accession(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%06d", number))


def hue(c: Column) -> Column:
    """A colour of 360 from a name."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") % 360).cast("long")


def cigar() -> Column:
    """Exons as M, introns as N, from left to right."""
    return F.expr("array_join(transform(exons, (x, i) -> concat(IF(i > 0, concat(CAST(x.start - exons[i - 1].end - 1 AS STRING), 'N'), ''), CAST(x.end - x.start + 1 AS STRING), 'M')), '')")


def last_value(attributes: str, key: str) -> Column:
    """The last of a repeated attribute's values, or null."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]
