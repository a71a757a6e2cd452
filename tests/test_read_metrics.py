"""Metrics of reads with intervals, structural categories, and clusters on stretches of several coordinates."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import structure
from strandlake.operators import categories, metrics, stateful

STRATA = "numerator long, denominator long"


@pytest.mark.parametrize("kinds, chunk", [(4096, 250), (3, 70)])
def test_interval_by_resampling(spark, monkeypatch, kinds, chunk):
    """Against strata drawn one at a time, within the noise of the draws; some replicates have no denominator."""
    monkeypatch.setattr(metrics, "KINDS", kinds)
    monkeypatch.setattr(metrics, "REPLICATES", chunk)
    rng = random.Random(5)
    for strata in ([(k % 7, 10 + k % 9) for k in range(60)], [(0, 0)] * 3 + [(1, 4)], [(1000, 1000)] + [(0, 9)] * 30):
        drawn = []
        for _ in range(6000):
            a, b = map(sum, zip(*rng.choices(strata, k=len(strata))))
            if b:
                drawn.append(a / b)
        df = spark.createDataFrame(strata, STRATA)
        got = metrics.interval(df.repartition(5), 2000, 3).first()
        assert tuple(got) == tuple(metrics.interval(df.coalesce(1), 2000, 3).first())
        assert got.effective == pytest.approx(2000 * len(drawn) / 6000, abs=90)
        assert got.lower == pytest.approx(metrics.percentile(drawn, 0.025), abs=0.03) and got.upper == pytest.approx(metrics.percentile(drawn, 0.975), abs=0.03)


def test_interval_without_errors_or_strata(spark):
    rows = lambda *x: spark.createDataFrame(list(x), STRATA)
    assert tuple(metrics.interval(rows((0, 4), (0, 0)), 50).first()) == (0.0, 0.0, 50)
    assert tuple(metrics.interval(rows((0, 0)), 50).first()) == (0.0, 0.0, 0)
    assert tuple(metrics.interval(rows(), 50).first()) == (0.0, 0.0, 0)
    assert tuple(metrics.interval(rows((5, 5)), 50).first()) == (1.0, 1.0, 50)
    for bad in ((2, 1), (-1, 1)):
        with pytest.raises(ValueError):
            metrics.interval(rows(bad))
    with pytest.raises(ValueError):
        metrics.interval(rows((1, 2)), 0)


def test_read_partition_by_pairs(spark):
    rng = random.Random(6)
    reads = [(f"r{k}", rng.choice("ABCD") if k % 9 else None, rng.choice(["x", "y", "z"])) for k in range(90)]
    df = spark.createDataFrame(reads, "read string, cluster string, truth string")
    seen = [(c, t) for _, c, t in reads if c]
    pairs = [(a, b) for i, a in enumerate(seen) for b in seen[i + 1 :]]
    merged, split = sum(a[0] == b[0] and a[1] != b[1] for a, b in pairs), sum(a[1] == b[1] and a[0] != b[0] for a, b in pairs)
    same_cluster, same_truth = sum(a[0] == b[0] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs)
    got = metrics.read_partition(df, "read", "cluster", "truth").first().asDict()
    assert got == {"requested": 90, "missing": 10, "clusters": 4, "mixed_clusters": 4, "cluster_pairs": same_cluster, "false_merges": merged, "truth_groups": 3, "split_groups": 3, "truth_pairs": same_truth, "false_splits": split,
                   "observations": 80, "false_merge_rate": merged / same_cluster, "false_split_rate": split / same_truth}
    sums = lambda s: tuple(s.agg(F.sum("numerator"), F.sum("denominator")).first())
    assert sums(metrics.partition_strata(df.filter("cluster IS NOT NULL"), "cluster", "truth")) == (merged, same_cluster)
    for r in metrics.read_intervals(df, "cluster", "truth", 400).collect():
        assert r.lower <= got[r.metric] <= r.upper and r.effective == 400
    with pytest.raises(ValueError, match="several rows"):
        metrics.read_partition(df.unionByName(df.limit(1)), "read", "cluster", "truth")
    empty = metrics.read_partition(df.limit(0), "read", "cluster", "truth").first()
    assert empty.clusters == empty.false_merges == 0 and empty.false_merge_rate == 0


def test_categories_by_hand(spark):
    schema = "k int, transcript_id string, gene_id string, contig string, strand string, exons array<struct<start:bigint,end:bigint>>"
    shaped = lambda rows: structure.with_shape(spark.createDataFrame(rows, schema))
    reference = shaped([
        (1, "splice", "g", "c", "+", [(1, 10), (20, 30)]), (2, "later", "g", "c", "+", [(5, 10), (20, 40)]), (3, "exact", "g", "c", "+", [(2, 10), (20, 33)]),
        (4, "one", "g", "c", "+", [(50, 60)]), (5, "minus", "g", "c", "-", [(1, 10), (20, 30)]), (6, "nameless", None, "c", "+", [(70, 80)]), (7, "other", "h", "d", "+", [(1, 2)]),
    ])
    models = shaped([
        (1, "a", "g", "c", "+", [(2, 10), (20, 33)]),  # all exons of a later one come before the introns of the first
        (2, "b", "g", "c", "+", [(3, 10), (20, 22)]), (3, "c", "g", "c", "-", [(4, 10), (20, 22)]), (4, "d", "g", "c", "+", [(50, 60)]),
        (5, "e", "g", "c", "+", [(50, 61)]),  # one exon has no introns to share
        (6, "f", "h", "c", "+", [(2, 10), (20, 33)]), (7, "i", None, "c", "+", [(70, 80)]), (10, "j", "none", "c", "+", [(70, 80)]),
    ])
    got = {r.isoform: tuple(r)[1:] for r in categories.structural_categories(models, reference, "k", F.col("k") % 10 == 0).collect()}
    spliced, single = ("multi-exon", "canonical", 1), ("mono-exon", "canonical", 1)
    assert got == {
        "a": ("full-splice_match", "g", "exact", "2", 2, *spliced, 23), "b": ("full-splice_match", "g", "splice", "2", 2, *spliced, 11), "c": ("full-splice_match", "g", "minus", "2", 2, *spliced, 10),
        "d": ("full-splice_match", "g", "one", "1", 1, *single, 11), "e": ("novel_not_in_catalog", "g", "novel", "NA", 1, *single, 12), "f": ("novel_not_in_catalog", "h", "novel", "NA", 2, *spliced, 23),
        "i": ("intergenic", "unresolved-i", "novel", "NA", 1, *single, 11), "j": ("fusion", "none", "novel", "NA", 1, *single, 11),
    }


@pytest.mark.parametrize("pack", [50_000, 6, 1])
def test_clusters_on_one_dense_stretch(spark, monkeypatch, pack):
    """Against forms taken one after the other over all of them; first coordinates leave no gap, later ones do."""
    monkeypatch.setattr(stateful, "PACK", pack)
    rng, splice, end = random.Random(9), 3, 10
    rows = []
    for k in range(260):
        tss = 2 * k + rng.randrange(5)
        x = [tss, 9000 + rng.choice([0, 8, 60]) + rng.randrange(4), 3000 + rng.choice([0, 2, 4]), 4000 + rng.choice([0, 90]), *([6000 + rng.choice([0, 70]), 7000] if k % 3 else [])]
        rows.append((f"f{rng.randrange(10**9):09d}", "TF1", "a", "c", "+", x))
    rows += rows[:20]
    forms, hulls, want = sorted({(r[0], tuple(r[5])) for r in rows}), [], {}
    for name, x in forms:
        t = [end, end, *[splice] * (len(x) - 2)]
        fit = [h for h in hulls if len(h[1]) == len(x) and all(abs(v - lo) <= d and abs(v - hi) <= d for v, lo, hi, d in zip(x, h[1], h[2], t))]
        if len(fit) == 1:
            h = fit[0]
            h[1], h[2] = [min(p) for p in zip(h[1], x)], [max(p) for p in zip(h[2], x)]
        else:
            hulls.append([name, x, x, "ambiguous_bridge" if fit else "unambiguous"])
            h = hulls[-1]
        want[name] = (h[0], h[3])
    df = spark.createDataFrame(rows, "form_id string, family string, assembly string, contig string, strand string, coordinates array<bigint>").repartition(3)
    assert {r.form_id: (r.cluster, r.bridge_status) for r in stateful.clustered(df, splice, end).collect()} == want
    assert any(s == "ambiguous_bridge" for _, s in want.values()) and len({c for c, _ in want.values()}) < len(want) - 40
