import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import structure, text
from strandlake.operators import classify, metrics, registry, stateful
from strandlake.sources import annotation

#: Identifiers of known structures under an assembly of zeros.
ZERO = "sha256:" + "0" * 64
VECTORS = [
    ("chr1", "+", [(100, 199), (300, 399)], "txid:TF1.6bab4e6908c70e6e92edc1fc", "txid:SC1.c22e5152d56c9e5117702d12"),
    ("chr1", "-", [(100, 150), (250, 300), (400, 450)], "txid:TF1.32bfcf9cc6da2d994dd48abc", "txid:SC1.0afaa06952b45d79bc9002a2"),
    ("chr2", "+", [(10, 99)], "txid:SE1.4c15a0eedce98677b7885599", None),
]
MODEL = "transcript_id string, contig string, strand string, exons array<struct<start: bigint, end: bigint>>"


def test_known_identifiers(spark):
    df = spark.createDataFrame([(str(i), c, s, list(reversed(e))) for i, (c, s, e, *_) in enumerate(VECTORS)], MODEL)
    got = structure.with_identity(structure.with_shape(df), ZERO).orderBy("transcript_id").collect()
    assert [(r.form.public_id, r.splice_chain and r.splice_chain.public_id) for r in got] == [v[3:] for v in VECTORS]


def test_problems(spark):
    rows = [("a", "c", "+", [(1, 10), (11, 20)]), ("b", "c", "+", [(1, 10), (10, 20)]), ("c", "c", ".", [(1, 2)]), ("d", "", "+", [(1, 2)]), ("e", "c", "+", []), ("f", "c", "-", [(0, 2)]), ("", "c", "-", [(1, 2)])]
    got = [r.p for r in spark.createDataFrame(rows, MODEL).select(structure.problems().alias("p")).collect()]
    assert got == [None, "overlapping exons", "unsupported strand", "empty contig", "no exons", "invalid exon interval", "no identifier"]


GTF = """#comment
chr1\tx\ttranscript\t100\t399\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; note "a; \\"b\\"";
chr1\tx\texon\t300\t399\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "x"; tag "y";
chr1\tx\texon\t100\t199\t.\t+\t.\tgene_id "g1"; transcript_id "t1";
chr2\tx\tExon\t10\t99\t.\t-\t.\ttranscript_id "t2"
"""
GFF = """##gff-version 3
chr1\tx\tgene\t1\t50\t.\t+\t.\tID=g1
chr1\tx\tmRNA\t1\t50\t.\t+\t.\tID=t%201;Parent=g1
chr1\tx\texon\t1\t20\t.\t+\t.\tParent=t%201,t2;Note=50%
"""


def test_annotations(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "a.gff3").write_text(GFF)
    got = {r.transcript_id: r for r in annotation.transcripts(spark, str(tmp_path / "a.gtf")).collect()}
    assert [(x.start, x.end) for x in got["t1"].exons] == [(100, 199), (300, 399)] and got["t1"].gene_id == "g1"
    assert [a.value for a in got["t1"].exons[1].attributes if a.key == "tag"] == ["x", "y"] and got["t2"].gene_id is None
    notes = annotation.records(spark, str(tmp_path / "a.gtf")).select(text.last_value("attributes", "note").alias("n")).collect()
    assert notes[0].n == 'a; "b"'
    gff = {r.transcript_id: r for r in annotation.transcripts(spark, str(tmp_path / "a.gff3")).collect()}
    assert set(gff) == {"t 1", "t2"} and gff["t 1"].gene_id == "g1" and gff["t2"].gene_id is None
    assert gff["t2"].exons[0].attributes[1].value == "50%"
    (tmp_path / "b.gtf").write_text(GTF + 'chr1\tx\texon\t500\t600\t.\t+\t.\tgene_id "g2"; transcript_id "t1";\n')
    with pytest.raises(annotation.AnnotationError):
        annotation.transcripts(spark, str(tmp_path / "b.gtf"))


def test_reference(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr2 second\nacgt\nAC\n>chr1\nAAAA\n")
    (tmp_path / "s.fa").write_text(">chr1\nAA\naa\n>chr2\nACGTAC\n")
    (tmp_path / "alias.tsv").write_text("alias\tprimary\n1\tchr1\n")
    names = annotation.contigs(spark, str(tmp_path / "r.fa"))
    assert annotation.fingerprint(names) == annotation.fingerprint(annotation.contigs(spark, str(tmp_path / "s.fa")))
    alias = annotation.aliases(spark, str(tmp_path / "alias.tsv"), names)
    ok = spark.createDataFrame([("t", "1", "+", [(1, 4)])], MODEL)
    assert annotation.resolved(ok, names, alias).first().contig == "chr1"
    with pytest.raises(annotation.AnnotationError):
        annotation.resolved(ok.withColumn("contig", F.lit("chr9")), names, alias)


def test_classification_of_gaps_and_ties(spark):
    ref = spark.createDataFrame([("a", "r1", "c", "+", 100, 199, "f1"), ("a", "r2", "c", "+", 300, 399, "f2"), ("b", "r3", "c", "+", 380, 500, "f3"), (None, "r0", "c", "+", 900, 950, "f3"), ("z", "own", "c", "+", 380, 500, "f3")],
                                "gene_id string, transcript_id string, contig string, strand string, start bigint, end bigint, form_id string")
    q = spark.createDataFrame([("1", "x", "c", "+", 220, 250, "n1"), ("2", "x", "c", "+", 390, 400, "n2"), ("3", "x", "c", "-", 220, 250, "n3"), ("4", "own", "c", "+", 380, 500, "f3"), ("5", "x", "c", "+", 380, 500, "f3"), ("6", "x", "c", "+", 920, 930, "n4")],
                              "query_id string, transcript_id string, contig string, strand string, start bigint, end bigint, form_id string")
    got = {r.query_id: (r.label, r.output_gene_id, r.output_transcript_id, r.gene_candidates) for r in classify.classified(q, ref).collect()}
    assert got["1"] == ("novel_in_known_gene", "a", "n1", ["a"])
    assert got["2"] == ("ambiguous_gene", None, "n2", ["a", "b", "z"])
    assert got["3"][0] == got["6"][0] == "new_locus"
    assert got["4"] == ("known", "z", "own", ["b", "z"]) and got["5"] == got["4"]


def test_loci_over_two_imports(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        s = rng.randrange(1, 5000)
        rows.append((i + 1, f"c{rng.randrange(2)}", "+-"[rng.randrange(2)], ["new_locus", "ambiguous_gene"][rng.randrange(2)], f"g{rng.randrange(2)}", s, s + rng.randrange(1, 60)))
    known, want = [], {}
    for r in rows:
        hits = [k for k in known if k[2:5] == r[1:4] and (r[3] != "ambiguous_gene" or k[5] == r[4]) and k[0] <= r[6] and r[5] <= k[1]]
        if len(hits) != 1:
            hits = [(r[5], r[6], *r[1:4], r[4], len(known) + 1)]
            known.append(hits[0])
        want[r[0]] = hits[0][6]
    schema = "ordinal bigint, contig string, strand string, status string, candidates string, start bigint, end bigint"
    first = stateful.allocated(spark.createDataFrame(rows[:300], schema)).collect()
    assert {r.ordinal: r.locus for r in first} == {k: v for k, v in want.items() if k <= 300}
    done = max(v for k, v in want.items() if k <= 300)
    old = spark.createDataFrame([(k[6], k[2], k[3], k[4], k[5], k[0], k[1]) for k in known if k[6] <= done], schema.replace("ordinal", "locus"))
    second = stateful.allocated(spark.createDataFrame(rows[300:], schema), old, done).collect()
    assert {r.ordinal: r.locus for r in second} == {k: v for k, v in want.items() if k > 300}


def test_clusters_and_bridges(spark):
    schema = "form_id string, family string, assembly string, contig string, strand string, coordinates array<bigint>"
    row = lambda i, *x: (i, "SE1", "a", "c", "+", list(x))
    got = {r.form_id: (r.cluster, r.bridge_status) for r in stateful.clustered(spark.createDataFrame([row("a", 100, 200), row("b", 110, 210), row("c", 105, 205), row("d", 100, 210)], schema), 0, 5).collect()}
    assert got == {"a": ("a", "unambiguous"), "b": ("b", "unambiguous"), "c": ("c", "ambiguous_bridge"), "d": ("c", "ambiguous_bridge")}
    rng = random.Random(8)
    rows = [row(f"{i:04d}", s := rng.randrange(400), s + 50 + rng.randrange(8)) for i in range(180)]
    clusters, want = [], {}
    for r in rows:
        fit = [k for k, c in enumerate(clusters) if all(abs(x - y) <= 5 for m in c for x, y in zip(m, r[5]))]
        if len(fit) == 1:
            clusters[fit[0]].append(r[5])
        else:
            clusters.append([r[5]])
        want[r[0]] = fit[0] if len(fit) == 1 else len(clusters) - 1
    found = {r.form_id: r.cluster for r in stateful.clustered(spark.createDataFrame(rows, schema), 2, 5).collect()}
    assert len(set(zip(found.values(), (want[k] for k in found)))) == len(clusters) == len(set(found.values()))


def test_pair_errors_by_hand(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "truth string, predicted int")
    r = metrics.pair_errors(df, "truth", "predicted").first()
    assert (r.false_splits, r.false_merges) == (1, 1)
    assert metrics.bootstrap_ratio([(0, 10), (2, 10), (5, 10), (0, 0)], 200) == metrics.bootstrap_ratio([(0, 10), (2, 10), (5, 10), (0, 0)], 200)


def test_registry_imports_once(spark, tmp_path):
    df = spark.createDataFrame([(str(i), c, s, e) for i, (c, s, e, *_) in enumerate(VECTORS)], MODEL)
    rows = structure.with_identity(structure.with_shape(df), ZERO)
    r = registry.Registry(spark, str(tmp_path / "reg"))
    one = {"annotation": "a", "sample": "s", "tool": "t", "checksum": "1"}
    assert r.imported(one, rows) and not r.imported(one, rows)
    assert r.table("observation").count() == 3 and r.table("structural_object").count() == 5
    assert r.imported(one | {"checksum": "2"}, rows)
    assert r.table("observation").count() == 6 and r.table("structural_object").count() == 5
    forged = rows.withColumn("form", F.struct("form.family", "form.public_id", F.lit("0").alias("full_digest"), "form.canonical_json"))
    with pytest.raises(registry.RegistryError):
        r.imported(one | {"checksum": "3"}, forged)
    assert r.table("observation").count() == 6
    assert registry.validated(rows).first().invalid == 0 and registry.validated(forged).first().invalid == 3
