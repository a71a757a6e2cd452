"""Rewritten files are equal line by line, and genomes in chunks equal plain Python, whatever the size of a task's block."""

import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandlake.session import stored
from strandlake.sinks import files
from strandlake.sources import annotation, genome, lines


@pytest.fixture(params=["128m", "100", "37"])
def blocks(spark, request):
    """Files are read in blocks of this size."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def gtf(contig, feature, start, end, attributes, strand="+"):
    return f"{contig}\tsrc\t{feature}\t{start}\t{end}\t.\t{strand}\t.\t{attributes}"


IDS = 'gene_id "g"; transcript_id "{}"; note "a\\"b"; tag "1"; tag "2"; gene_id "g"'
GOOD = ["#!first", gtf("c1", "gene", 1, 9, 'gene_id "g"'), gtf("c1", "Transcript", 1, 9, IDS.format("t1")), gtf("c2", "exon", 1, 4, IDS.format("t2")), "# ünd", gtf("c1", "exon", 1, 4, IDS.format("t1")),
        gtf("c2", "transcript", 1, 9, IDS.format("t2"), "-"), gtf("c1", "CDS", 6, 9, "x y"), gtf("c1", "exon", 6, 9, 'transcript_id t1; gene_id g'), "#last"]


def put(path, rows, end="\n"):
    path.write_text("\n".join(rows) + end)
    return str(path)


def test_numbers(spark, tmp_path, blocks):
    path = put(tmp_path / "a.txt", [f"line {k}" + "x" * (k % 50) for k in range(60)], end="")
    got = lines.with_numbers(lines.addressed(spark, path)).orderBy("number").collect()
    assert [(r.number, r.value.split("x")[0]) for r in got] == [(k + 1, f"line {k}") for k in range(60)]


@pytest.mark.parametrize("zipped", [False, True])
def test_subset(spark, tmp_path, blocks, zipped):
    source, target = put(tmp_path / "a.gtf", GOOD), tmp_path / ("b.gtf.gz" if zipped else "b.gtf")
    contigs = spark.createDataFrame([("c1",), ("c1",), ("c9",)], "name string")
    found = lines.contig_subset(spark, source, str(target), contigs)
    text = gzip.open(target, "rt").read() if zipped else target.read_text()
    assert text == "".join(f"{x}\n" for x in GOOD if x.startswith(("#", "c1")))
    assert (found["comments"], found["records"], found["features"]) == (3, 5, {"CDS": 1, "Transcript": 1, "exon": 2, "gene": 1})
    assert found["source_bytes"] == len((tmp_path / "a.gtf").read_bytes()) and found["output_sha256"].startswith("sha256:")
    with pytest.raises(files.OutputError):
        lines.contig_subset(spark, source, str(target), contigs)
    with pytest.raises(files.OutputError):
        lines.contig_subset(spark, source, source, contigs)


def test_subset_refusals(spark, tmp_path):
    contigs = spark.createDataFrame([("c1",)], "name string")
    for name, rows, what in (("eight", [*GOOD, "a\tb"], r":11: expected 9 columns, found 2"), ("blank", [*GOOD[:2], "", *GOOD], ":3: "), ("none", [x for x in GOOD if not x.startswith("c1")], "no records")):
        target = tmp_path / f"{name}.out"
        with pytest.raises(annotation.AnnotationError, match=what):
            lines.contig_subset(spark, put(tmp_path / name, rows), str(target), contigs)
        assert not target.exists()


def test_identity_view(spark, tmp_path, blocks):
    source, target = put(tmp_path / "a.gtf", [*GOOD, "", "  "]), tmp_path / "b.gtf"
    found = lines.identity_view(spark, source, str(target))
    want = []
    for x in GOOD:
        fields = x.split("\t")
        if len(fields) == 9 and fields[2].lower() in ("exon", "transcript"):
            name = "t1" if "t1" in fields[8] else "t2"
            want.append("\t".join([*fields[:8], f'gene_id "g"; transcript_id "{name}";']))
    assert target.read_text().split("\n")[1:] == [*want, ""] and target.read_text().startswith("#")
    assert found["read"] == {"cds": 1, "exon": 3, "gene": 1, "transcript": 2} and found["kept"] == {"exon": 3, "transcript": 2}
    assert found["repeated"] == {"gene_id": 4, "tag": 4} and (found["transcripts"], found["with_exons"]) == (2, 2)


@pytest.mark.parametrize("row, what", [
    (gtf("c1", "exon", 1, 2, 'gene_id "g"'), ":11: exon without transcript_id"),
    (gtf("c1", "exon", 1, 2, 'gene_id "g"; transcript_id "t1"; gene_id "h"'), r":11: gene_id has the values \['g', 'h'\]"),
    (gtf("c1", "transcript", 1, 2, 'gene_id "g"; transcript_id "t1"'), ":11: a second record of transcript t1"),
    (gtf("c1", "transcript", 1, 2, 'gene_id "g"; transcript_id "t3"'), "1 transcripts without exons"),
    ("c1\texon", ":11: expected 9 columns, found 2"),
])
def test_identity_view_refusals(spark, tmp_path, row, what):
    with pytest.raises(annotation.AnnotationError, match=what):
        lines.identity_view(spark, put(tmp_path / "a.gtf", [*GOOD, row]), str(tmp_path / "b.gtf"))
    assert not (tmp_path / "b.gtf").exists()


def test_identity_view_without_exons(spark, tmp_path):
    with pytest.raises(annotation.AnnotationError, match="no exons"):
        lines.identity_view(spark, put(tmp_path / "a.gtf", GOOD[:3]), str(tmp_path / "b.gtf"))


def test_feature_counts(spark, tmp_path, blocks):
    got = {tuple(r)[:-1]: r.n for r in lines.feature_counts(spark, put(tmp_path / "a.gtf", [*GOOD, "", "x\ty"])).collect()}
    assert got[("record", "c1", "src", "exon")] == 2 and got[("comment", None, None, None)] == 3 and got[("malformed", None, None, None)] == 1 and got[("blank", None, None, None)] == 1
    assert sum(got.values()) == len(GOOD) + 2


def fasta(rng):
    contigs = {f"c{k}": "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in enumerate([1, 64, 300, 5, 777])}
    rows = []
    for name, bases in contigs.items():
        rows.append(f">{name} and more")
        at = 0
        while at < len(bases):
            n = rng.randrange(1, 90)
            rows.append(rng.choice([str.lower, str.upper])(bases[at : at + n]) + rng.choice(["", "", " ", "\n"]))
            at += n
    return contigs, rows


@pytest.mark.parametrize("size", [1, 50, 1000])
def test_chunks_and_spliced(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    contigs, rows = fasta(rng)
    store = stored(genome.chunks(spark, put(tmp_path / "g.fa", rows), size), "test-genome")
    got = store.collect()
    assert {(r.contig, r.chunk): r.bases for r in got} == {(c, k): s[k * size : (k + 1) * size] for c, s in contigs.items() for k in range(-(-len(s) // size))}
    assert {tuple(r) for r in genome.contig_lengths(store, size).collect()} == {(c, len(s)) for c, s in contigs.items()}
    models, want = [], {}
    for k in range(40):
        name = rng.choice(["c1", "c2", "c4"])
        cuts = sorted(rng.sample(range(1, len(contigs[name]) + 1), 2 * rng.randrange(1, 6)))
        exons, strand = list(zip(cuts[::2], cuts[1::2])), rng.choice("+-")
        models.append((f"t{k:02d}", name, strand, exons))
        bases = "".join(contigs[name][s - 1 : e] for s, e in exons)
        want[f"t{k:02d}"] = bases if strand == "+" else bases[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    df = spark.createDataFrame(models, "transcript_id string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>")
    spliced = stored(genome.spliced(df, store, size=size), "test-spliced")
    assert {r.transcript_id: r.bases for r in spliced.collect()} == want
    if size == 50:
        genome.write_transcriptome(spliced, str(tmp_path / "t.fa"), str(tmp_path / "t.tsv"))
        record = lambda k, s: f">{k}\n" + "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80))
        assert (tmp_path / "t.fa").read_text() == "".join(record(k, s) for k, s in sorted(want.items()))
        for line, (name, contig, strand, exons) in zip((tmp_path / "t.tsv").read_text().splitlines()[1:], models, strict=True):
            f = line.replace('"', "").split("\t")
            assert f[:3] == [name, contig, strand] and json.loads(f[3]) == [list(x) for x in exons] and int(f[5]) == len(want[name])
            assert json.loads(f[4]) == [[a[1] + 1, b[0] - 1] for a, b in zip(exons, exons[1:])]
        genome.write_sam(spliced, store, str(tmp_path / "t.sam"), size)
        sam = (tmp_path / "t.sam").read_text().splitlines()
        assert sam[0].startswith("@HD") and [x.split("\t")[1] for x in sam[1:6]] == [f"SN:{c}" for c in sorted(contigs)]
        assert [x.split("\t")[0] for x in sam[6:]] == [m[0] for m in sorted(models, key=lambda m: (m[1], m[3][0][0], m[3][-1][1], m[0]))]
        assert all(x.split("\t")[9] == want[x.split("\t")[0]] for x in sam[6:])


def test_genome_errors(spark, tmp_path):
    for name, rows in (("a", ["ACGT", ">a", "A"]), ("b", [">a", "A", ">a", "C"]), ("c", ["> ", "A"])):
        with pytest.raises(annotation.AnnotationError):
            genome.chunks(spark, put(tmp_path / name, rows))
    store = genome.chunks(spark, put(tmp_path / "d", [">a", "ACGT"]))
    for contig, end in (("a", 5), ("b", 2)):
        with pytest.raises(annotation.AnnotationError, match="t is not within"):
            genome.spliced(spark.createDataFrame([("t", contig, "+", [(1, end)])], "transcript_id string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>"), store)


def test_folder_of_parts_counts_as_one_file(spark, tmp_path):
    """Lines are numbered over a folder's gzipped parts, header first; rewrites, sizes and digests take it for one file, and a gzipped output's parts are zipped."""
    rows = spark.createDataFrame([(k, f"t{k}", f) for k in range(50) for f in ("transcript", "exon")], "k int, t string, f string")
    rows = rows.withColumn("line", F.format_string('c\ts\t%s\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "%s"; tag "x"; tag "y"', "f", "t"))
    path, plain = str(tmp_path / "a.gtf"), str(tmp_path / "b.gtf")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_parts(rows, ["k", F.desc("f")], path, "# head")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_lines(rows, ["k", F.desc("f")], plain, "# head")
    want = open(plain).read().splitlines()
    assert len(list((tmp_path / "a.gtf").glob("part-*.gz"))) > 2
    assert [(r.number, r.value) for r in lines.with_numbers(lines.addressed(spark, path)).orderBy("number").collect()] == list(enumerate(want, 1))
    found = [lines.identity_view(spark, p, str(tmp_path / f"{k}.gtf.gz")) for k, p in enumerate((path, plain))]
    assert found[0]["read"] == found[1]["read"] == {"exon": 50, "transcript": 50} and found[0]["repeated"] == found[1]["repeated"] == {"tag": 100}
    texts = [gzip.open(tmp_path / f"{k}.gtf.gz", "rt").read() for k in range(2)]
    assert texts[0] == texts[1] and texts[0].count("\n") == 101
    parts = sorted((tmp_path / "a.gtf").glob("part-*"), key=lambda p: p.name)
    f = files.Files(spark, path)
    assert f.size(path) == sum(p.stat().st_size for p in parts) and f.sha256(path) == "sha256:" + hashlib.sha256(b"".join(p.read_bytes() for p in parts)).hexdigest()
    assert annotation.transcripts(spark, path).count() == 50


def test_pieces_that_the_reader_takes_at_once_fit_a_task(spark, tmp_path, monkeypatch):
    """A contig on one line is digested from rows so short that a whole batch of Spark's reader is 32 MB at most."""
    import hashlib

    from strandlake.sources import annotation

    bases, longest, stored = "ACGTTGCA" * 20_000, [], annotation.stored

    def seen(df, name):
        out = stored(df, name)
        if name == "contig-pieces":
            longest.append(max(len(r.bases) for r in out.filter("bases IS NOT NULL").collect()))
        return out

    monkeypatch.setattr(annotation, "stored", seen)
    (tmp_path / "r.fa").write_text(f">a\n{bases}\n>b\nAC\n")
    found = {r.name: (r.length, r.sequence_digest) for r in annotation.contigs(spark, str(tmp_path / "r.fa")).collect()}
    assert found == {n: (len(s), hashlib.sha256(s.encode()).hexdigest()) for n, s in (("a", bases), ("b", "AC"))}
    assert longest[0] * int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", "4096")) <= 32 << 20


def test_gzipped_contigs_are_digested_as_they_are_read(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(annotation, "stored", lambda df, name, f=annotation.stored: (kept.append(name), f(df, name))[1])
    rng = random.Random(4)
    made = {f"c{k}": "".join(rng.choice("ACGTacgt") for _ in range(n)) for k, n in enumerate((1, 80, 30_000, 9000, 8192))}

    def told(name, text):
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()[: len(text) // 2]) + gzip.compress(text.encode()[len(text) // 2 :]))  # two members
        return annotation.contigs(spark, str(path))

    lines = lambda s: "\n".join(s[k : k + 70] for k in range(0, len(s), 70))
    got = told("a.fa.gz", "\n".join(f">{n} of a test\n{lines(s)}\n" for n, s in made.items()))
    assert {tuple(r) for r in got.collect()} == {(n, len(s), hashlib.sha256(s.upper().encode()).hexdigest()) for n, s in made.items()}
    assert kept == ["contigs"]  # no pieces of sequences
    for k, (text, problem) in enumerate([("A\n>a\nA\n", "before any header"), (">a\nA\n>b\nA\n>a\nA\n", "repeats"), (">a\nA\n>a\nA\n", "repeats"), (">a\n>b\nA\n", "no bases"), ("\n", "no sequences")]):
        with pytest.raises(annotation.AnnotationError, match=problem):
            told(f"{k}.fa.gz", text)


def test_lines_made_after_the_sort(spark, tmp_path):
    files.write_lines(spark.range(300), [F.col("id").desc()], str(tmp_path / "x.txt"), line=F.repeat(F.lit("a"), F.col("id").cast("int")))
    assert (tmp_path / "x.txt").read_text().split("\n") == ["a" * k for k in range(299, -1, -1)] + [""]
