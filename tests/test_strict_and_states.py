"""Strict reading, test vectors, matrices as files, and snapshots whose state is kept between runs."""

import json
import random

import pytest

from strandlake.functions import structure
from strandlake.operators import snapshots
from strandlake.sinks import files
from strandlake.sources import strict, vectors
from strandlake.sources.annotation import AnnotationError

OK = 'gene_id "g"; transcript_id "t"'


def gtf(attributes=OK, feature="exon", start="1", end="9", contig="c", strand="+", score=".", phase=".", source="s"):
    return "\t".join([contig, source, feature, start, end, score, strand, phase, attributes])


@pytest.mark.parametrize("text, want", [
    (".", []), ("", []), ('a "b"', [("a", "b")]), ('a "b;c" ; d e', [("a", "b;c"), ("d", "e")]), ('a "x\\"y\\\\n\\n\\t\\r"', [("a", 'x"y\\n\n\t\r')]), ('a ""', [("a", "")]), ("a.b:c-d 5;", [("a.b:c-d", "5")]), ('a b;a c;a "d"', [("a", "b"), ("a", "c"), ("a", "d")]),
    ('1a "b"', "malformed attribute name"), ('a "b"; ;', "malformed attribute name"), ("a", "an attribute without white space and a value"), ('a"b"', "an attribute without white space and a value"), ("a ", "an attribute without a value"), ("a b; c ;", "an attribute without a value"),
    ('a "b', "an open quote"), ('a "b\\', "an unknown or open escape"), ('a "\\x"', "an unknown or open escape"), ('a "b\\"', "an open quote"), ("a b=c", "a malformed bare value"), ('a b"c"', "a malformed bare value"), ("a b\\", "a malformed bare value"),
    ('a "b" c "d"', "no semicolon after an attribute"), ("a b c", "no semicolon after an attribute"), ('a "b"c', "no semicolon after an attribute"),
])
def test_attributes(spark, text, want):
    r = spark.createDataFrame([(text,)], "text string").select(strict.attribute_error("text").alias("e"), strict.attributes("text").alias("a")).first()
    assert r.e == (want if isinstance(want, str) else None)
    assert isinstance(want, str) or [tuple(a) for a in r.a] == want


LINES = [
    (gtf().rsplit("\t", 1)[0], "not nine columns"), (gtf(contig=""), "contig is empty or has white space"), (gtf(source="a b"), "source is empty or has white space"), (gtf(start="+1"), "no decimal coordinates"), (gtf(start="0"), "invalid interval"), (gtf(end="0"), "invalid interval"),
    (gtf(score="x"), "a score that is no finite number"), (gtf(score="NaN"), "a score that is no finite number"), (gtf(phase="3"), "invalid phase"), (gtf(strand="*"), "invalid strand"), (gtf('gene_id "a'), "an open quote"), (gtf('gene_id "a"; gene_id "a"'), "gene_id twice"),
    (gtf('transcript_id ""'), "transcript_id is empty or has control characters"), (gtf('transcript_id "a\\n"'), "transcript_id is empty or has control characters"), (gtf(contig="z"), "an unknown contig"), (gtf(end="1001"), "past the end of its contig"), (gtf(strand="."), "a model without a strand"), (gtf('gene_id "g"'), "a model without transcript_id"),
]


def test_lines(spark, tmp_path):
    """All errors of a file are told, each by its line; what is no exon or transcript needs no id."""
    good = ["# note", "  # note", "", gtf(), gtf(feature="gene", strand=".", attributes="."), gtf(contig="C", start="20", end="30", score="1e3", phase="2")]
    (tmp_path / "x.gtf").write_text("\n".join([*good, *[x for x, _ in LINES]]) + "\n")
    lengths = spark.createDataFrame([("c", 1000)], "name string, length bigint")
    aliases = spark.createDataFrame([("C", "c")], "alias string, primary string")
    got = sorted(tuple(r) for r in strict.errors(spark, str(tmp_path / "x.gtf"), lengths, aliases).collect())
    assert got == [(7 + k, None, e) for k, (_, e) in enumerate(LINES)]
    with pytest.raises(AnnotationError, match=":7: not nine columns"):
        strict.models(spark, str(tmp_path / "x.gtf"), lengths, aliases)
    (tmp_path / "y.gtf").write_text("\n".join(good))
    assert [tuple(r) for r in strict.models(spark, str(tmp_path / "y.gtf"), lengths, aliases).collect()] == [("t", "g", "c", "+", [(1, 9), (20, 30)])]
    for bad in (spark.createDataFrame([("C", "d")], "alias string, primary string"), spark.createDataFrame([("c", "d")], "alias string, primary string")):
        with pytest.raises(AnnotationError):
            strict.models(spark, str(tmp_path / "y.gtf"), lengths, bad)


@pytest.mark.parametrize("rows, want", [
    ([gtf(), gtf(contig="d", start="20", end="30")], "more than one contig or strand"), ([gtf(), gtf('gene_id "h"; transcript_id "t"', start="20", end="30")], "more than one gene"), ([gtf(), gtf(feature="transcript"), gtf(feature="transcript")], "a second record of the transcript"),
    ([gtf(feature="transcript")], "no exons"), ([gtf(), gtf()], "repeated or overlapping exons"), ([gtf(), gtf(start="9", end="12")], "repeated or overlapping exons"), ([gtf(), gtf(start="10", end="12")], "adjacent exons"), ([gtf(), gtf(feature="transcript", end="10")], "bounds differ from the exons"),
])
def test_transcripts(spark, tmp_path, rows, want):
    (tmp_path / "x.gtf").write_text("\n".join([gtf('transcript_id "fine"', start="5", end="6"), *rows]))
    assert [tuple(r) for r in strict.errors(spark, str(tmp_path / "x.gtf")).collect()] == [(2, "t", want)]
    with pytest.raises(AnnotationError, match=f":2: transcript t: {want}"):
        strict.models(spark, str(tmp_path / "x.gtf"))


def test_without_models(spark, tmp_path):
    (tmp_path / "x.gtf").write_text("# nothing\n")
    with pytest.raises(AnnotationError, match="no models"):
        strict.models(spark, str(tmp_path / "x.gtf"))


def test_vectors(spark, tmp_path):
    schema = "name string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>"
    rows = [("one", "c", "+", [(5, 9)]), ("two", "c", "-", [(5, 9), (20, 30)]), ("wrong", "é", "+", [(5, 9), (20, 30)]), ("missing", "c", "+", [(1, 2), (8, 9)]), ("extra", "c", "+", [(1, 2)])]
    made = {r.name: r for r in structure.with_identity(structure.with_shape(spark.createDataFrame(rows, schema)), "sha256:x").collect()}
    listed = []
    for name, contig, strand, exons in rows:
        r = made[name]
        listed.append({"name": name, "contig": contig, "strand": strand, "exons": exons, "form": r.form.asDict(), "splice_chain": r.splice_chain and r.splice_chain.asDict(), "note": 1})
    listed[2]["form"]["full_digest"] = "0" * 64
    listed[3]["splice_chain"] = None
    listed[4]["splice_chain"] = listed[1]["splice_chain"]
    (tmp_path / "v.json").write_text(json.dumps({"assembly_fingerprint": "sha256:x", "vectors": listed}, indent=1))
    got = vectors.checked(spark, str(tmp_path / "v.json"))
    assert {(r.vector, r.role) for r in got.filter("NOT valid").collect()} == {("wrong", "form"), ("missing", "splice_chain"), ("extra", "splice_chain")}
    assert tuple(vectors.conformance(got).first()) == (5, 8, 3)


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_matrix(spark, tmp_path, block):
    rng = random.Random(1)
    cells = {(f"s{rng.randrange(9)}", f"column {rng.randrange(40):02d}"): rng.randrange(1, 99) for _ in range(60)} | {('q"x', "é"): 5}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "sample string, form string, n bigint").repartition(3)
    files.write_matrix(df, "sample", "form", "n", str(tmp_path / "m.tsv"), block)
    rows, columns = (sorted({k[i] for k in cells}) for i in (0, 1))
    quoted = lambda s: '"q""x"' if '"' in s else s
    want = ["\t".join(["sample", *columns]), *["\t".join([quoted(r), *[str(cells.get((r, c), 0)) for c in columns]]) for r in rows]]
    assert (tmp_path / "m.tsv").read_text() == "".join(f"{x}\n" for x in want)
    files.write_matrix(df.limit(0), "sample", "form", "n", str(tmp_path / "e.tsv"), block)
    assert (tmp_path / "e.tsv").read_text() == "sample\n"


def test_snapshots(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "form_id string, splice_chain_id string, classifications string")
    path = f"file://{tmp_path}/states"
    add = lambda df: tuple(snapshots.SnapshotState(spark, path).add(df).values())
    first = rows(("a", "x", "known"), ("a", "x", "new_locus,known"), ("b", None, "known"), ("c", "z", None))
    # snapshot, forms, new, disappeared, changed chains, lost labels
    assert add(first) == (1, 3, 3, 0, 0, 0) and add(first) == (2, 3, 0, 0, 0, 0)
    assert add(rows(("a", "x", "known"), ("b", "y", "known,more"), ("d", None, ""))) == (3, 3, 1, 1, 1, 1)
    with pytest.raises(snapshots.SnapshotError, match="two chains"):
        add(rows(("a", "x", ""), ("a", "y", "")))
    # a lost run's folder without the marker is no state
    (tmp_path / "states" / "00000004").mkdir()
    assert snapshots.SnapshotState(spark, path).last() == 3
    assert add(rows()) == (4, 0, 0, 3, 0, 0) and add(first) == (5, 3, 3, 0, 0, 0)


def test_vectors_by_lines(spark, tmp_path):
    """A document with a vector a line is read by several tasks, and its rows are those of the same document in other layouts."""
    names = ["plain", 'a "quoted" }, { name', "tab\\t", *[f"v{k}" for k in range(400)]]
    made = [{"name": n, "contig": "c", "strand": "+-"[k % 2], "exons": [[10 + k, 20 + k], [30 + k, 44 + k]][: 1 + k % 3], "form": {"family": "TF1", "public_id": "x", "full_digest": "y", "canonical_json": "{}"}, "splice_chain": None} for k, n in enumerate(names)]
    head, rows = '{"assembly_fingerprint": "sha256:a", "vectors": [', [json.dumps(m) for m in made]
    texts = {"lines": head + "\n" + ",\n".join(rows) + "]}\n", "tail": head + "\n" + ",\n".join(rows) + "\n]}", "two": head + "\n" + rows[0] + ", " + ",\n".join(rows[1:]) + "]}", "indented": json.dumps({"vectors": made, "assembly_fingerprint": "sha256:a"}, indent=2)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {}
        for k, text in texts.items():
            (tmp_path / f"{k}.json").write_text(text)
            df = vectors.checked(spark, str(tmp_path / f"{k}.json"))
            got[k] = df.rdd.getNumPartitions(), sorted(tuple(map(str, r)) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got["lines"][1]) == 2 * len(names) and all(x[1] == got["indented"][1] for x in got.values())
    assert got["lines"][0] > 1 and got["tail"][0] > 1 and got["two"][0] == 1
