"""The ledger of artifacts: batches that go on after an interruption, and files that are lost or altered."""

import os

import pytest

from strandlake.operators import artifacts
from strandlake.operators.registry import RegistryError
from strandlake.sinks import files

from .test_commands import CALLS, line, place  # noqa: F401


def manifest(p, *names):
    rows = "".join(f"{p}/{n}.gtf\t{n}\tt\tv1\n" for n in names)
    (p / "batch.tsv").write_text(f"input\tsample\ttool\tannotation_name\n{rows}")
    return str(p / "batch.tsv"), str(p / "out")


@pytest.fixture
def three(place):  # noqa: F811
    c, p = place
    for k, n in enumerate("abc"):
        (p / f"{n}.gtf").write_text(CALLS + line("exon", 7000 + 9 * k, 7100, "+", f'transcript_id "{n}0";'))
    return c, p


def test_resumes_after_an_interruption(three):
    c, p = three
    one = c.batch_file(*manifest(p, "a"))
    assert one[0]["created"] and one[0]["written"]
    before = os.stat(one[0]["output_gtf"]).st_mtime_ns, open(one[0]["output_gtf"]).read()
    # the second import was committed, but its outputs were not written
    c.import_file(str(p / "b.gtf"), "b", "t", "v1")
    done = c.batch_file(*manifest(p, "a", "b", "c"), completed=2)
    assert [(d["sample"], d["created"], d["written"]) for d in done] == [("a", False, False), ("b", False, True), ("c", True, True)]
    assert before == (os.stat(one[0]["output_gtf"]).st_mtime_ns, open(one[0]["output_gtf"]).read())
    again = c.batch_file(*manifest(p, "a", "b", "c"), completed=3)
    assert not any(d["created"] or d["written"] for d in again) and c.lost_artifacts().count() == 0
    # clusters change what outputs show, so all are written again, and then not once more
    assert all(d["written"] for d in c.batch_file(*manifest(p, "a", "b", "c"), splice=2, end=60, completed=3))
    assert "txid:FC1." in open(done[0]["mapping"]).read()
    assert not any(d["written"] for d in c.batch_file(*manifest(p, "a", "b", "c"), splice=2, end=60, completed=3))


def test_refuses_what_does_not_agree(three):
    c, p = three
    done = c.batch_file(*manifest(p, "a", "b"))
    for n in (0, 1, 3, 4):
        with pytest.raises(RegistryError):
            c.batch_file(*manifest(p, "a", "b", "c"), completed=n)
    with pytest.raises(RegistryError, match="just the first"):
        c.batch_file(*manifest(p, "a", "c"), completed=2)
    text = open(done[0]["mapping"]).read()
    # as long as before, and lines only swapped
    lines = text.splitlines(keepends=True)
    # first the file system's own checksum tells, then the ledger
    crc = f"{os.path.dirname(done[0]['mapping'])}/.{os.path.basename(done[0]['mapping'])}.crc"
    open(done[0]["mapping"], "w").write(text.replace("known", "knowm", 1))
    with pytest.raises(ValueError, match="altered"):
        c.batch_file(*manifest(p, "a", "b", "c"), completed=2)
    os.remove(crc)
    for other in (text.replace("known", "knowm", 1), "".join([lines[0], *lines[:0:-1]]), text[:-1], text + "\n"):
        open(done[0]["mapping"], "w").write(other)
        with pytest.raises(ValueError, match="altered"):
            c.batch_file(*manifest(p, "a", "b", "c"), completed=2)
    open(done[0]["mapping"], "w").write(text)
    os.remove(done[1]["output_gtf"])
    with pytest.raises(RegistryError, match="lost"):
        c.batch_file(*manifest(p, "a", "b", "c"), completed=2)
    assert [r.problem for r in c.lost_artifacts().collect()] == ["lost"]
    assert c.registry.table("import_manifest").count() == 2
    # without a count the batch writes all again, and then the ledger holds
    assert all(d["written"] for d in c.batch_file(*manifest(p, "a", "b", "c")))
    assert c.lost_artifacts().count() == 0 and c.validate().count() == 0


def test_a_write_that_was_cut_off_is_not_an_alteration(three, monkeypatch):
    c, p = three
    done = c.batch_file(*manifest(p, "a"))

    def cut(rows, path):
        open(path, "w").write("half")
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(files, "write_mapping", cut)
        with pytest.raises(OSError):
            c.batch_file(*manifest(p, "a"))
    again = c.batch_file(*manifest(p, "a"), completed=1)
    assert again[0]["written"] and open(done[0]["mapping"]).read() != "half" and c.lost_artifacts().count() == 0


def test_digests_do_not_depend_on_splits(spark, tmp_path):
    body = "".join(f"line {k}\r\n" for k in range(9000)) + "last"
    (tmp_path / "a b.txt").write_bytes(body.encode())
    (tmp_path / "c.txt").write_bytes(body.encode())
    (tmp_path / "d.txt").write_bytes(body.replace("\r", "", 1).encode())
    (tmp_path / "e.txt").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("a b.txt", "c.txt", "d.txt", "e.txt", "none.txt")]
    found = []
    for size in (2000, 50_000, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append({os.path.basename(r.path): (r.bytes, r.digest) for r in artifacts.digests(spark, paths).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and len(found[0]) == 5
    got = found[0]
    assert got["a b.txt"] == got["c.txt"] != got["d.txt"] and got["e.txt"][0] == 0 and got["none.txt"] == (None, None)
    assert len({got[n][1] for n in ("c.txt", "d.txt", "e.txt")}) == 3
