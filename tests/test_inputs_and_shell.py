import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import metrics, plots, registry, stateful
from strandlake.plans import registry_queries
from strandlake.sinks import files
from strandlake.sources import annotation

from .test_commands import CALLS, REFERENCE, line


def test_attribute_errors(spark, tmp_path):
    """Open quotes, keys without a value and text after a quote are errors; quotes within quotes and delimiters are not."""
    good = ['gene_id "a;b"; note "x \\"y\\" \\\\";', "gene_id a; level 2 ;", 'gene_id ""', ' gene_id "g" ; tag "p"; tag "q"']
    bad = ['gene_id "open; x 1', "gene_id", 'gene_id "a" b', 'gene_id "a"; note "b\\"']
    (tmp_path / "x.gtf").write_text("".join(line("exon", 1, 2, "+", a) for a in good + bad))
    rows = [(r.error, [tuple(a) for a in r.attributes]) for r in annotation.records(spark, str(tmp_path / "x.gtf")).orderBy("at").collect()]
    assert [e for e, _ in rows] == [None] * 4 + ["malformed attributes"] * 4
    assert rows[0][1] == [("gene_id", "a;b"), ("note", 'x "y" \\')] and rows[1][1] == [("gene_id", "a"), ("level", "2")] and rows[2][1] == [("gene_id", "")] and len(rows[3][1]) == 3
    (tmp_path / "x.gff3").write_text("".join(line("exon", 1, 2, "+", a) for a in ("Parent=a;x=", ".", "Parent", "=a", "a=1;a=2")))
    assert [r.error for r in annotation.records(spark, str(tmp_path / "x.gff3")).orderBy("at").collect()] == [None, None, "malformed attributes", "malformed attributes", "repeated key"]


@pytest.mark.parametrize("text", ["ACGT\n>a\nAC\n", "ACGT\n", "", "\n\n", ">a\nACé\n", ">a\n>b\nAC\n", ">a\nA\n>a\nC\n", "> \nAC\n"])
def test_fasta_errors(spark, tmp_path, text):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(annotation.AnnotationError):
        annotation.contigs(spark, str(tmp_path / "x.fa"))


def test_fasta_with_leading_blank_lines(spark, tmp_path):
    (tmp_path / "x.fa").write_text("\n\n>a first\nAC\n\ngt\n>b\nN\n")
    assert sorted((r.name, r.length) for r in annotation.contigs(spark, str(tmp_path / "x.fa")).collect()) == [("a", 4), ("b", 1)]


def test_registry_lock_and_names(spark, tmp_path):
    """A manifest of any letters is imported once; a second writer is refused; a lost state leaves the one before."""
    rows = spark.createDataFrame([("a",)], "form_id string").withColumn("form", F.struct(F.lit("f").alias("family"), F.lit("p").alias("public_id"), F.lit("d").alias("full_digest"), F.lit("j").alias("canonical_json"))).withColumn("splice_chain", F.lit(None).cast("struct<family:string,public_id:string,full_digest:string,canonical_json:string>"))
    r = registry.Registry(spark, str(tmp_path / "reg"))
    assert r.imported({"sample": "é\"", "tool": "t"}, rows) and not r.imported({"sample": "é\"", "tool": "t"}, rows)
    assert r.table("observation").count() == 1 and not (tmp_path / "reg" / "writer.lock").exists()
    other = registry.Registry(spark, str(tmp_path / "reg"))
    with r.writing(), pytest.raises(registry.RegistryError, match="process [0-9]+, since 2"):
        other.commit({"observation": r.table("observation")})
    r.commit({"observation": r.table("observation")})
    assert other.table("observation").count() == 2
    (tmp_path / "reg" / "state-00000002.json").unlink()
    assert other.table("observation").count() == 1


def test_replaced_in_one_step(spark, tmp_path):
    p = tmp_path / "x.txt"
    for text in ("old", "new"):
        files.write_text(spark, str(p), text)
        assert p.read_text() == text
    with pytest.raises(ZeroDivisionError):
        files.Files(spark, str(p)).replaced(str(p), lambda out: 1 / 0)
    assert p.read_text() == "new" and [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["x.txt"]


def test_snapshots_against_the_very_next(spark):
    rows = [(1, "a", "x", 1), (1, "a", "y", 1), (1, "b", "x", 2), (2, "a", "x", 1), (2, "c", "x", 1), (3, "b", "z", 1), (3, "c", "z", 1)]
    got = {r.s: tuple(r)[:5] for r in metrics.snapshots(spark.createDataFrame(rows, "k int, s string, label string, chain int"), "k", "s", "label", "chain").collect()}
    # n_keys, n_new, n_gone, n_lost_labels, n_changed_chains
    assert got == {"a": (2, 2, 0, 0, 0), "b": (2, 1, 1, 1, 1), "c": (2, 1, 1, 0, 0)}


def test_bootstrap_by_brute_force():
    """Against resampling one stratum at a time, within the noise of the draws; the estimate is exact."""
    rng, strata = random.Random(3), [(k % 5, 10) for k in range(40)] + [(0, 0)] * 5
    drawn = []
    for _ in range(4000):
        a, b = map(sum, zip(*rng.choices(strata, k=len(strata))))
        drawn.append(a / b)
    got = metrics.bootstrap_ratio(strata, 4000)
    assert got["estimate"] == 80 / 400 and got == metrics.bootstrap_ratio(strata, 4000)
    assert got["low"] == pytest.approx(metrics.percentile(drawn, 0.025), abs=0.005) and got["high"] == pytest.approx(metrics.percentile(drawn, 0.975), abs=0.005)
    assert metrics.bootstrap_ratio([], 10) == {"estimate": 0.0, "low": 0.0, "high": 0.0}


def test_islands_by_brute_force(spark, monkeypatch):
    """Intervals that reach over several ranges, and gaps at the ranges' borders."""
    monkeypatch.setattr(stateful, "RANGE", 50)
    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(3)}", s := rng.randrange(1500), s + rng.choice([0, 5, 20, 200]), False) for i in range(150)]
    want = {}
    for g in {r[1] for r in rows}:
        reach, island = None, 0
        for i, _, s, e, _ in sorted((r for r in rows if r[1] == g), key=lambda r: r[2:4]):
            island += reach is not None and s > reach
            reach = max(e, reach or 0)
            want[i] = (g, island)
    df = spark.createDataFrame(rows, "ordinal int, g string, start int, end int, known boolean")
    assert {r.ordinal: (r.g, r.island) for r in stateful.islands(df, "g").collect()} == want
    assert max(k for _, k in want.values()) > 3


def test_wrapped_items():
    assert plots.wrapped_items("in ", []) == []
    assert plots.wrapped_items("in ", ["a" * 30, "b" * 22, "c" * 9]) == ["in " + "a" * 30 + " · " + "b" * 22, "   " + "c" * 9]
    assert plots.wrapped_items("in ", ["x" * 80]) == ["in " + "x" * 80]


def test_shell(spark, tmp_path, capsys):
    """Commands from a shell: JSON and 0, or one line of error and 2."""
    (tmp_path / "r.fa").write_text(">chr1\n" + "ACGTN" * 2000 + "\n")
    (tmp_path / "r.gtf").write_text(REFERENCE)
    (tmp_path / "a.gtf").write_text(CALLS)
    p, db = str(tmp_path), f"--db={tmp_path}/reg"

    def run(*args):
        code = cli.main([args[0], db, *args[1:]])
        out, err = capsys.readouterr()
        return code, json.loads(out) if code < 2 else err

    assert run("init", f"--fasta={p}/r.fa", "--assembly=asm", f"--annotation={p}/r.gtf", "--annotation-name=v1")[1]["assembly"] == "asm"
    code, err = run("init", f"--fasta={p}/r.fa", "--assembly=asm", f"--annotation={p}/r.gtf", "--annotation-name=v1")
    assert code == 2 and "the registry exists" in err
    add = ("add", f"--input={p}/a.gtf", "--sample=s", "--tool=t", "--annotation-name=v1", f"--output-gtf={p}/o.gtf", f"--mapping={p}/m.tsv")
    assert [run(*add)[1]["created"] for _ in range(2)] == [True, False]
    assert run(*add, "--fuzzy-end-tolerance=5")[0] == 2
    assert run("export", f"--catalog={p}/c.tsv")[1]["observations"] == 4
    valid = run("validate")
    assert valid[0] == 0 and valid[1]["valid"] and valid[1]["issues"] == [] and valid[1]["summary"]["observations"] == 4
    assert len(run("inspect", "txid:GL1.000001")[1]["observation"]) == 2 and run("inspect", "nothing")[0] == 2
    assert run("plot", f"--output={p}/g.svg", "--gene=ALPHA")[0] == 0 and "samples s" in (tmp_path / "g.svg").read_text()
    r = registry.Registry(spark, str(tmp_path / "reg"))
    r.commit({}, {"contig": r.table("contig").limit(0)})
    code, told = run("validate")
    assert code == 1 and not told["valid"] and "reference without contig: " in told["issues"][-1]
    with pytest.raises(SystemExit) as e:
        cli.main(["add", db])
    assert e.value.code == 2


def test_contigs_over_batches_blocks_and_pieces(spark, tmp_path, monkeypatch):
    """Sequences that go over Arrow batches, blocks of the file and pieces have the digests of the whole; gzipped in members too."""
    rng, text, want = random.Random(5), [], []
    for k, size in enumerate((1, 200_000, 64, 70_001, 3)):
        bases = "".join(rng.choices("ACGTacgtN", k=size))
        text.append(f">c{k} told\n" + "".join(f"{bases[i : i + 70]} \n" for i in range(0, size, 70)) + "\n" * (k % 2))
        want.append((f"c{k}", size, hashlib.sha256(bases.upper().encode()).hexdigest()))
    (tmp_path / "x.fa").write_text("".join(text))
    (tmp_path / "y.fa.gz").write_bytes(b"".join(gzip.compress(t.encode()) for t in text))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for block, records in (("10000", "50"), ("128m", "10000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            for name in ("x.fa", "y.fa.gz"):
                assert sorted(tuple(r) for r in annotation.contigs(spark, str(tmp_path / name)).collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_registry_genome_has_short_lines(spark, tmp_path, monkeypatch):
    """The registry's queries write a genome of lines, as a contig of large tables is longer than a row may be."""
    seen = []
    monkeypatch.setattr(registry_queries, "_built", {})
    real = registry_queries.Commands.initialize
    monkeypatch.setattr(registry_queries.Commands, "initialize", lambda c, fasta, *a, **k: (seen.append(fasta), real(c, fasta, *a, **k)))
    c, *_ = registry_queries._registry(spark, "/root/testdata/sf0.001")
    longest, lines = spark.read.text(seen[0]).selectExpr("max(length(value))", "count(*)").first()
    names = {r.name: r.length for r in c.registry.table("contig").collect()}
    assert longest == registry_queries.LINE < min(names.values()) and lines == 5 + sum(-(-n // longest) for n in names.values())
