"""Runs against each other: completeness, partitions with unequal members, members that truth does not know, files of aliases."""

import itertools
import random

import pytest

from strandlake.operators import runs
from strandlake.sinks import files


def test_compared(spark):
    df = lambda *rows: spark.createDataFrame(rows, "s string, t string, a string, b string")
    base = df(("x", "1", "f", None), ("x", "2", "g", "c"), (None, "1", "h", "d"))
    other = df((None, "1", "h", None), ("x", "2", "G", "c"), ("x", "1", "f", None))
    got = runs.compared({"base": base, "same": base, "other": other}, ["s", "t"], ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("same", "a", 0), ("same", "b", 0), ("other", "a", 1), ("other", "b", 1)]
    for bad in (base.filter("t = '1'"), base.unionByName(base.limit(1)), base.unionByName(df(("y", "1", "f", "c")))):
        with pytest.raises(ValueError):
            runs.compared({"base": base, "other": bad}, ["s", "t"], ["a"])


def test_membership_changes(spark):
    rng = random.Random(5)
    a = {m: rng.choice("pqr") for m in range(60) if rng.random() < 0.8}
    b = {m: rng.choice("pqrs") if rng.random() < 0.4 else a.get(m, "p") for m in range(70) if rng.random() < 0.8}
    frame = lambda x: spark.createDataFrame([*x.items(), (99, None)], "m long, c string")
    got = runs.membership_changes(frame(a), frame(b), "c", "m").first().asDict()
    both = sorted(set(a) & set(b))
    assert got == {
        "members_left": len(a), "members_right": len(b), "members_shared": len(both), "only_left": len(set(a) - set(b)), "only_right": len(set(b) - set(a)),
        "changed_clusters": sum(a[m] != b[m] for m in both), "changed_pairs": sum((a[x] == a[y]) != (b[x] == b[y]) for x, y in itertools.combinations(both, 2)),
    }
    none = spark.createDataFrame([], "m long, c string")
    assert set(runs.membership_changes(none, none, "c", "m").first()) == {0}
    with pytest.raises(ValueError):
        runs.membership_changes(frame(a), spark.createDataFrame([(1, "p"), (1, "q")], "m long, c string"), "c", "m")


def test_restricted(spark):
    c = spark.createDataFrame([("k", 1), ("k", 2), ("l", 2), ("l", 3), ("l", 3)], "c string, m long")
    kept, ignored = runs.restricted(c, spark.createDataFrame([(1,), (1,), (9,)], "m long"), "m")
    assert [tuple(r) for r in kept.select("c", "m").collect()] == [("k", 1)] and ignored.first().ignored == 2


def test_aliases(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "alias string, primary string")
    path = str(tmp_path / "a.tsv")
    files.write_aliases(df(("b", "c1"), ("b", "c1"), ("a", "c2"), ("c1", "c1"), ("na", "c1"), ("", "c2")), path)
    assert open(path).read() == "alias\tprimary\na\tc2\nb\tc1\n"
    for bad in (df(("b", "c1"), ("b", "c2")), df(("b\tx", "c1")), df(("b", "c\n1"))):
        with pytest.raises(files.OutputError):
            files.write_aliases(bad, path)
    assert open(path).read() == "alias\tprimary\na\tc2\nb\tc1\n"
