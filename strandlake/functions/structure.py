"""Column expressions over a transcript row: contig, strand and exons, an array of structs with start and end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public prefix of identifiers, and how many hexadecimal digits of the digest they show.
PREFIX, SHOWN = "txid:", 24


def ordered(exons: str = "exons") -> Column:
    return F.array_sort(exons)


def problems() -> Column:
    """What makes a row no valid transcript, or null. Adjacent exons are legal, overlapping ones are not."""
    bad = F.exists("exons", lambda x: x["start"].isNull() | x["end"].isNull() | (x["start"] < 1) | (x["end"] < x["start"]))
    pairs = F.expr("exists(zip_with(slice(exons, 1, greatest(size(exons) - 1, 0)), slice(exons, 2, greatest(size(exons) - 1, 0)), (a, b) -> a.end >= b.start), x -> x)")
    return (
        F.when(F.coalesce("contig", F.lit("")) == "", "empty contig")
        .when(~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)), "unsupported strand")
        .when(F.coalesce("transcript_id", F.lit("")) == "", "no identifier")
        .when(F.coalesce(F.size("exons"), F.lit(0)) < 1, "no exons")
        .when(bad, "invalid exon interval")
        .when(pairs, "overlapping exons")
    )


def introns() -> Column:
    """Gaps between neighbouring exons, in the order of transcription."""
    gaps = F.expr("IF(size(exons) > 1, transform(sequence(1, size(exons) - 1), i -> array(exons[i - 1].end + 1, exons[i].start - 1)), CAST(array() AS array<array<bigint>>))")
    return F.when(F.col("strand") == "-", F.reverse(gaps)).otherwise(gaps)


def with_shape(df):
    """df with exons in order, start, end, exon_count, tss, tes and introns."""
    df = df.withColumn("exons", ordered())
    df = df.withColumns({"start": F.expr("exons[0].start"), "end": F.expr("element_at(exons, -1).end"), "exon_count": F.size("exons"), "introns": introns()})
    plus = F.col("strand") == "+"
    return df.withColumns({"tss": F.when(plus, F.col("start")).otherwise(F.col("end")), "tes": F.when(plus, F.col("end")).otherwise(F.col("start"))})


def _object(family: str, assembly: Column, **fields) -> Column:
    """Canonical JSON: keys in order, no spaces, characters as they are."""
    parts = {"algorithm": F.lit(family), "assembly": assembly, "contig": F.col("contig"), "strand": F.col("strand"), **fields}
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))


def with_identity(df, assembly: str | Column, shown: int = SHOWN):
    """df (with_shape) with form and splice_chain: structs of family, public_id, full_digest and canonical_json."""
    a = F.lit(assembly) if isinstance(assembly, str) else assembly
    single = F.col("exon_count") == 1
    family = F.when(single, F.lit("SE1")).otherwise(F.lit("TF1"))
    form = F.when(single, _object("SE1", a, start=F.col("start"), end=F.col("end"))).otherwise(_object("TF1", a, introns=F.col("introns"), tss=F.col("tss"), tes=F.col("tes")))
    chain = F.when(~single, _object("SC1", a, introns=F.col("introns")))
    df = df.withColumns({"_form": form, "_chain": chain})
    df = df.withColumns({"_form_digest": F.sha2("_form", 256), "_chain_digest": F.sha2("_chain", 256)})

    def identity(kind: Column, digest: str, text: str) -> Column:
        public = F.concat(F.lit(PREFIX), kind, F.lit("."), F.substring(digest, 1, shown))
        return F.struct(kind.alias("family"), public.alias("public_id"), F.col(digest).alias("full_digest"), F.col(text).alias("canonical_json"))

    return df.withColumns(
        {"form": identity(family, "_form_digest", "_form"), "splice_chain": F.when(~single, identity(F.lit("SC1"), "_chain_digest", "_chain"))}
    ).drop("_form", "_chain", "_form_digest", "_chain_digest")
