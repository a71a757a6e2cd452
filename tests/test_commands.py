import gzip
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandlake.functions import export, structure
from strandlake.operators import metrics, plots, simulate
from strandlake.operators.commands import Commands
from strandlake.operators.registry import RegistryError
from strandlake.sinks import files
from strandlake.sources import annotation, tables
from strandlake.streaming.intake import intake


def line(feature, s, e, strand, attributes, contig="chr1"):
    return f"{contig}\ttool\t{feature}\t{s}\t{e}\t.\t{strand}\t.\t{attributes}\n"


REFERENCE = (
    line("exon", 100, 199, "+", 'gene_id "g1"; transcript_id "r1"; gene_name "ALPHA";')
    + line("exon", 300, 399, "+", 'gene_id "g1"; transcript_id "r1"; gene_name "ALPHA";')
    + line("exon", 1000, 1100, "-", 'gene_id "g2"; transcript_id "r2"; gene_name "BETA";')
)
CALLS = (
    line("transcript", 100, 399, "+", 'gene_id "x"; transcript_id "a"; note "two\\"quotes"; txid_form "mine"; tag "p"; tag "q";')
    + line("exon", 300, 399, "+", 'gene_id "x"; transcript_id "a";')
    + line("exon", 100, 199, "+", 'gene_id "x"; transcript_id "a"; exon_number "9";')
    + line("exon", 120, 199, "+", 'transcript_id "b";')
    + line("exon", 5000, 5100, "+", 'transcript_id "c"; gene_id "y";')
    + line("exon", 5050, 5150, "+", 'transcript_id "d";')
)


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1\n" + "ACGTN" * 2000 + "\n")
    (tmp_path / "r.gtf").write_text(REFERENCE)
    (tmp_path / "a.gtf").write_text(CALLS)
    (tmp_path / "b.gtf.gz").write_bytes(gzip.compress((CALLS.replace('"c"', '"c2"') + line("exon", 5060, 5170, "+", 'transcript_id "e";')).encode()))
    c = Commands(spark, str(tmp_path / "reg"))
    c.initialize(str(tmp_path / "r.fa"), "asm", str(tmp_path / "r.gtf"), "v1")
    return c, tmp_path


def test_import_writes_and_repeats(place):
    c, p = place
    out = {"gtf": str(p / "o.gtf"), "mapping": str(p / "m.tsv")}
    one = c.import_file(str(p / "a.gtf"), "s", "t", "v1", **out)
    assert one["created"] and one["transcripts"] == 4
    first = (p / "o.gtf").read_bytes(), (p / "m.tsv").read_bytes()
    assert not c.import_file(str(p / "a.gtf"), "s", "t", "v1", **out)["created"]
    assert first == ((p / "o.gtf").read_bytes(), (p / "m.tsv").read_bytes())
    rows = [r.split("\t") for r in first[1].decode().splitlines()]
    assert rows[0] == list(export.MAPPING) and [r[2] for r in rows[1:]] == ["a", "b", "c", "d"]
    assert [r[8] for r in rows[1:]] == ["known", "novel_in_known_gene", "new_locus", "new_locus"]
    assert [r[5] for r in rows[1:]] == ["g1", "g1", "txid:GL1.000001", "txid:GL1.000001"] and rows[1][4] == "r1"
    gtf = first[0].decode().splitlines()
    assert gtf[0].startswith("# ") and len(gtf) == 1 + 4 + 5
    top = gtf[1].split("\t")
    assert top[1:5] == ["txid", "transcript", "100", "399"]
    assert top[8].startswith('gene_id "g1"; transcript_id "r1"; note "two\\"quotes"; tag "p"; tag "q"; txid_annotation "v1";')
    assert 'txid_upstream_txid_form "mine";' in top[8] and top[8].count("gene_id") == 2  # the original gene's too
    assert 'exon_number "1";' in gtf[2] and 'txid_upstream_exon_number "9";' in gtf[2] and 'exon_number "2";' in gtf[3]
    with pytest.raises(files.OutputError):
        c.import_file(str(p / "a.gtf"), "s", "t", "v1", gtf=str(p / "a.gtf"))
    with pytest.raises(RegistryError):
        c.import_file(str(p / "a.gtf"), "s", "t", "v1", splice=2)
    assert c.validate().count() == 0


def test_batch_clusters_reports_and_plots(place):
    c, p = place
    (p / "batch.tsv").write_text(f"input\tsample\ttool\tannotation_name\n{p}/b.gtf.gz\ts2\tt\tv1\n{p}/a.gtf\ts 1\tt\tv1\n")
    done = c.batch_file(str(p / "batch.tsv"), str(p / "out"), splice=2, end=60)
    assert [d["sample"] for d in done] == ["s 1", "s2"] and [d["transcripts"] for d in done] == [4, 5]
    assert "/s_1.t.v1." in done[0]["mapping"]
    text = [r.split("\t") for r in open(done[1]["mapping"]).read().splitlines()]
    assert {r[11][:9] for r in text[1:]} == {"txid:FC1."} and {r[5] for r in text[1:] if r[8] == "new_locus"} == {"txid:GL1.000001"}
    assert not c.cluster(2, 60) and c.cluster(0, 0)
    assert c.registry.table("fuzzy_cluster").agg(F.max("accession"), F.count_distinct("accession"), F.count(F.lit(1))).first()[1:] == (c.registry.table("fuzzy_cluster").count(),) * 2
    c.export(str(p / "catalog.tsv.gz"))
    catalog = gzip.open(p / "catalog.tsv.gz", "rt").read().splitlines()
    assert catalog[0].startswith("form_id\tsplice_chain_id") and len(catalog) == 1 + c.catalog().count()
    found = c.inspect("txid:GL1.000001")
    assert found["observation"].count() == 5 and found["locus"].count() == 1
    assert c.summary()["imports"] == 2 and c.summary()["classifications"]["known"] == 2
    plots.overview(c, str(p / "o.svg"))
    plots.gene(c, "ALPHA", str(p / "g.svg"))
    assert "known" in (p / "o.svg").read_text() and (p / "g.svg").read_text().count("<rect") > 8
    assert plots.resolved_gene(c, "x")[0] == "original_gene_id" and plots.resolved_gene(c, "g2")[0] == "gene_id"
    with pytest.raises(RegistryError):
        plots.resolved_gene(c, "nothing")
    assert c.validate().count() == 0
    c.classify_only(str(p / "a.gtf"), "v1", str(p / "labels.tsv"))
    assert len((p / "labels.tsv").read_text().splitlines()) == 5


def test_annotation_releases(place):
    c, p = place
    assert not c.annotation_add(str(p / "r.gtf"), "v1")
    (p / "r2.gtf").write_text(REFERENCE.replace('"r1"', '"n1"'))
    with pytest.raises(RegistryError):
        c.annotation_add(str(p / "r2.gtf"), "v1")
    assert c.annotation_add(str(p / "r2.gtf"), "v2")
    a, b = (c.import_file(str(p / "a.gtf"), "s", "t", v)["import_id"] for v in ("v1", "v2"))
    both = [{r.transcript_id: (r.form_id, r.output_transcript_id) for r in c.assignments(i).collect()} for i in (a, b)]
    assert both[0]["a"] == (both[1]["a"][0], "r1") and both[1]["a"][1] == "n1"
    rows = [json.loads(r.line) for r in annotation.annotation_rows(annotation.transcripts(c.spark, str(p / "a.gtf"))).collect()]
    assert list(rows[0]) == ["contig", "exons", "gene_id", "strand", "transcript_id"] and any(r["gene_id"] is None for r in rows)


def test_intake_takes_a_manifest_once(place):
    c, p = place
    (p / "in").mkdir()
    for k in (1, 2):
        (p / "in" / f"{k}.tsv").write_text(f"input\tsample\ttool\tannotation_name\tformat\n{p}/a.gtf\ts\tt\tv1\t\n")
        intake(c, str(p / "in"), str(p / "out"), str(p / "cp")).awaitTermination()
    assert c.registry.table("import_manifest").count() == 1 and c.registry.table("observation").count() == 4


def test_clashing_attribute_names(spark):
    df = spark.createDataFrame([([("ID", "1"), ("txid_upstream_ID", "2"), ("ID", "3"), ("a", "4"), ("gene_id", "5")], ["a"])], "attributes array<struct<key:string,value:string>>, taken array<string>")
    got = df.select(export.upstream_attributes("attributes", "taken").alias("a")).first().a
    assert [tuple(x) for x in got] == [("txid_upstream_ID", "1"), ("txid_upstream_txid_upstream_ID", "2"), ("txid_upstream_ID", "3"), ("txid_upstream_a", "4")]


def test_tables(spark, tmp_path):
    w = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    got = tables.tracking(spark, w("t", "C1|x\tL\tr\t=\tq1:g|t1|1,q1:g|t2\t-\nC2\tL\tr\tu\t-\tq2:-|t9|3\n"), 2).orderBy("transcript").collect()
    assert [(r.cluster, r.query, r.transcript) for r in got] == [("C1", 1, "t1"), ("C1", 1, "t2"), ("C2", 2, "t9")]
    with pytest.raises(tables.TableError):
        tables.tracking(spark, w("u", "C1\tL\tr\t=\tq2:g|t\n"), 1)
    index = tables.fasta_index(spark, w("f", "chr1\t50\t1\t2\t3\nchr2\t60\t1\t2\t3\n"))
    report = "# Name: x\n" + "\t".join(["1", "r", "1", "c", "GB1", "=", "RS1", "p", "50", "chr1"]) + "\n" + "\t".join(["9", "r", "9", "c", "na", "=", "RS9", "p", "70", "na"]) + "\n"
    assert {(r.alias, r.primary) for r in tables.assembly_aliases(spark, w("r", report), index).collect()} == {("1", "chr1"), ("GB1", "chr1"), ("RS1", "chr1")}
    with pytest.raises(tables.TableError):
        tables.assembly_aliases(spark, w("r2", report.replace("\t50\t", "\t51\t")), index).count()
    a = tables.alignments(spark, w("p", "\t".join("r1 100 0 90 + t1 200 0 100 80 100 60 tp:A:P AS:i:77".split()) + "\n")).first()
    assert (a.score, a.identity, a.query_coverage, a.target_coverage) == (77, 0.8, 0.9, 0.5)
    with pytest.raises(tables.TableError):
        tables.batch_manifest(spark, w("m", "input\tsample\ttool\tannotation_name\nx\t\tt\ta\n"))
    assert [r.sample for r in tables.inputs_manifest(spark, ["/x/S1.GFF3.gz", "/x/S0.gtf"], "t", "v").collect()] == ["S0", "S1"]
    db = str(tmp_path / "d.sqlite")
    with sqlite3.connect(db) as x:
        x.executescript("CREATE TABLE PBID(id, PBID, exp, ends_id); CREATE TABLE exp(id, exp_name); CREATE TABLE isoform_ends(id, isoform_id);"
                        "INSERT INTO PBID VALUES (1,'p',7,3); INSERT INTO exp VALUES (7,'d-c'); INSERT INTO isoform_ends VALUES (3,5);"
                        "CREATE TABLE edge(edge_ID, v1, v2, edge_type, strand); CREATE TABLE location(location_ID, chromosome, position); CREATE TABLE transcripts(transcript_ID, n_exons, jn_path);"
                        "INSERT INTO edge VALUES (1,1,2,'intron','+'); INSERT INTO location VALUES (1,'c',10),(2,'c',20); INSERT INTO transcripts VALUES (4,2,'1'),(5,1,NULL);"
                        "CREATE TABLE observed(dataset, read_name, transcript_ID); INSERT INTO observed VALUES ('d','r',4);")
    assert tuple(tables.isoform_clusters(spark, db).first()) == ("d-c", "p", 3, 5)
    assert [tuple(i)[1:] for i in tables.splice_paths(spark, db).first().introns] == [("c", "+", 10, 20)] and tables.read_clusters(spark, db).count() == 1


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("t1", None, "c", "-", [(1, 3), (6, 8)], "ACGTNACGT")], "transcript_id string, gene_id string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>, sequence string")
    df = structure.with_shape(df)
    r = df.select(export.genepred_line().alias("g"), export.spliced().alias("s"), export.wrapped(F.lit("abcdef"), 3).alias("w"), export.delimited([F.lit('a"b'), F.lit("x\ty"), F.lit(None)]).alias("d")).first()
    assert r.g == "t1\tc\t-\t0\t8\t0\t8\t2\t0,5,\t3,8," and r.s == "CGTCGT" and r.w == "abc\ndef" and r.d == '"a""b"\t"x\ty"\t'
    assert export.neutral_gtf_lines(df).count() == 4
    files.write_text(spark, str(tmp_path / "a.txt"), "x")
    files.write_checksums(spark, [str(tmp_path / "a.txt")], str(tmp_path / "SUMS"))
    assert (tmp_path / "SUMS").read_text().startswith("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881  ")


def test_simulated_labels_come_back(spark):
    from strandlake.operators import classify

    shaped = lambda df: structure.with_identity(structure.with_shape(df), "a").withColumn("form_id", F.col("form.public_id"))
    t = simulate.truth(spark, 120)
    q = shaped(t.withColumnsRenamed({"label": "want", "truth_id": "transcript_id"})).withColumn("query_id", F.col("transcript_id"))
    got = {v: classify.classified(q, shaped(simulate.reference(spark, 120, v))) for v in (1, 2)}
    assert got[1].filter("label <> want").count() == 0
    assert got[2].filter("label <> want").count() == 24
    seen = simulate.observed(t, ["s1", "s2"], ["x", "y"])
    assert 360 < seen.count() < 440
    assert metrics.audited(t, t, ["truth_id"]).count() == 0
    assert shaped(metrics.perturbed(t)).join(shaped(t), "form_id").count() == 0
    assert sorted(simulate.shuffled([1, 2, 3], 1)) == [1, 2, 3] and simulate.gtf_lines(seen).count() > 500
