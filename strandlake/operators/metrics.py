"""Agreement of partitions, truth and labels. Pairs are counted from group sizes and never listed."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import stored

from .registry import numbered


def _pairs(df: DataFrame, *keys: str, name: str) -> DataFrame:
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).cast("long").alias(name))


def ratio(a, b):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def pair_errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pairs that truth joins and prediction splits, and the reverse; with rates."""
    t, p, j = (_pairs(df, *k, name=n) for k, n in (((truth,), "truth_pairs"), ((predicted,), "predicted_pairs"), ((truth, predicted), "joint_pairs")))
    out = t.join(p).join(j)  # three single rows
    out = out.withColumns({"false_splits": F.col("truth_pairs") - F.col("joint_pairs"), "false_merges": F.col("predicted_pairs") - F.col("joint_pairs")})
    return out.withColumns({"false_split_rate": ratio("false_splits", "truth_pairs"), "false_merge_rate": ratio("false_merges", "predicted_pairs")})


def changed_relations(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs that one of two partitions of the same members joins and the other does not, and members whose label changed."""
    a, b, j = (_pairs(df, *k, name=n) for k, n in (((left,), "a"), ((right,), "b"), ((left, right), "j")))
    labels = df.agg(F.sum((~F.col(left).eqNullSafe(F.col(right))).cast("long")).alias("changed_labels"))
    return a.join(b).join(j).join(labels).select((F.col("a") + F.col("b") - 2 * F.col("j")).alias("changed_pairs"), "changed_labels")


def cross_pairs(left: DataFrame, right: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pairs between two callers: joined by prediction, correct ones, those truth asks for, and rates (null if none)."""

    def product(*keys):
        a, b = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), right.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
        return a.join(b, list(keys)).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).cast("long").alias("pairs"))

    t, p, j = product(truth), product(predicted), product(truth, predicted)
    out = t.withColumnRenamed("pairs", "expected").join(p.withColumnRenamed("pairs", "joined")).join(j.withColumnRenamed("pairs", "correct"))
    return out.withColumns({"false_merge_rate": F.when(F.col("joined") > 0, 1 - F.col("correct") / F.col("joined")), "false_split_rate": F.when(F.col("expected") > 0, 1 - F.col("correct") / F.col("expected"))})


def discovery(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Precision, recall, F1 and redundancy of distinct keys."""
    t, p = truth.select(key).distinct(), predicted.select(key).distinct()
    one = lambda df, n: df.agg(F.count(F.lit(1)).cast("long").alias(n))
    out = one(t, "truth").join(one(p, "predicted")).join(one(t.join(p, key), "hits")).join(one(predicted.filter(F.col(key).isNotNull()), "rows"))
    out = out.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "truth"), "redundancy": ratio("rows", "predicted")})
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(F.lit(0.0))).drop("rows")


def end_errors(truth: DataFrame, predicted: DataFrame, order: str) -> DataFrame:
    """Count, median and maximum of |TSS| and |TES| differences together, to the truth of the same chain that is last in the order.

    Rows without a chain (one exon) and chains without a truth do not count; without any, median and maximum are null.
    """
    last = truth.filter("chain_id IS NOT NULL").groupBy("chain_id").agg(F.max_by(F.struct("tss", "tes"), order).alias("_t"))
    both = predicted.select("chain_id", "tss", "tes").join(last, "chain_id")
    gaps = both.select(F.explode(F.array(F.abs(F.col("tss") - F.col("_t.tss")), F.abs(F.col("tes") - F.col("_t.tes")))).alias("gap"))
    return gaps.agg(F.count("gap").alias("n"), F.median("gap").alias("median_end_error"), F.max("gap").alias("max_end_error"))


def matrix_metrics(df: DataFrame, row: str, column: str) -> DataFrame:
    """Rows, columns, filled cells, columns that several rows share, and the share of empty cells."""
    cells = df.select(row, column).distinct()
    shared = cells.groupBy(column).count().filter("count > 1").agg(F.count(F.lit(1)).alias("shared_columns"))
    sizes = cells.agg(F.countDistinct(row).alias("n_rows"), F.countDistinct(column).alias("n_columns"), F.count(F.lit(1)).alias("n_cells"))
    return sizes.join(shared).withColumn("sparsity", F.when(F.col("n_cells") > 0, 1 - F.col("n_cells") / (F.col("n_rows") * F.col("n_columns"))).otherwise(F.lit(0.0)))


def transitions(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    a, b = old.select(key, F.col(label).alias("old_label")), new.select(key, F.col(label).alias("new_label"))
    return a.join(b, key).groupBy("old_label", "new_label").agg(F.count(F.lit(1)).alias("n"))


def snapshots(df: DataFrame, key: str, snapshot: str, labels: str, chain: str) -> DataFrame:
    """Per snapshot: keys held, and against the very next one before it keys that are new, that are gone, whose label set lost a member, and whose chain changed.

    Snapshots are numbered in their order, so a key that skips one counts as gone and then as new.
    """
    order = df.select(snapshot).distinct().withColumn("_i", F.row_number().over(Window.orderBy(snapshot)))  # a row a snapshot
    sets = df.groupBy(key, snapshot).agg(F.collect_set(labels).alias("now"), F.max(chain).alias("chain")).join(F.broadcast(order), snapshot)
    before = sets.select(key, (F.col("_i") + 1).alias("_i"), F.col("now").alias("old"), F.col("chain").alias("old_chain"))
    both = sets.select(key, "_i", "now", "chain").join(before, [key, "_i"], "full")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    held, had = F.col("now").isNotNull(), F.col("old").isNotNull()
    found = both.groupBy("_i").agg(
        count(held).alias("n_keys"), count(held & ~had).alias("n_new"), count(had & ~held).alias("n_gone"),
        count(held & had & (F.size(F.array_except("old", "now")) > 0)).alias("n_lost_labels"), count(held & had & ~F.col("chain").eqNullSafe(F.col("old_chain"))).alias("n_changed_chains"),
    )
    return found.join(F.broadcast(order), "_i").drop("_i")


def best_alignments(df: DataFrame, query: str, target: str, score: str, order: list[str]) -> DataFrame:
    """The best row of each (query, target), then each query's best with its runner-up's score; ties by `order`."""
    best = df.withColumn("_k", F.row_number().over(Window.partitionBy(query, target).orderBy(F.desc(score), *order))).filter("_k = 1").drop("_k")
    w = Window.partitionBy(query).orderBy(F.desc(score), target, *order)
    return best.withColumns({"_k": F.row_number().over(w), "runner_up": F.lead(score).over(w)}).filter("_k = 1").drop("_k")


def cascade(rules: list[tuple[str, F.Column]]) -> F.Column:
    """The name of the first rule that a row fails, or accepted."""
    out = F.when(F.lit(False), "")
    for name, passes in rules:
        out = out.when(~F.coalesce(passes, F.lit(False)), name)
    return out.otherwise("accepted")


def percentile(values: list[float], share: float) -> float:
    """Linear interpolation between order statistics."""
    v = sorted(values)
    at = share * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def bootstrap_ratio(strata: list[tuple[int, int]], draws: int = 1000, seed: int = 1, level: float = 0.95) -> dict[str, float]:
    """Interval of sum(a) / sum(b) over resampled strata; the strata come from an aggregate. Equal ones are drawn together, by their number."""
    kinds = sorted(Counter(strata).items())
    n, (a, b) = len(strata), np.array([k for k, _ in kinds], dtype=np.float64).reshape(-1, 2).T
    times = np.random.default_rng(seed).multinomial(n, np.array([m for _, m in kinds]) / n, size=draws) if n else np.zeros((draws, 0))
    top, bottom = times @ a, times @ b
    found = np.divide(top, bottom, out=np.zeros(draws), where=bottom > 0).tolist()
    total = sum(y for _, y in strata)
    tail = (1 - level) / 2
    return {"estimate": sum(x for x, _ in strata) / total if total else 0.0, "low": percentile(found, tail), "high": percentile(found, 1 - tail)}


#: Kinds of strata that a task draws at once, and replicates of a task.
KINDS, REPLICATES = 4096, 250


def partition_strata(df: DataFrame, by: str, other: str) -> DataFrame:
    """(numerator, denominator) of each group of `by`: its pairs of members that `other` keeps apart, and all its pairs."""
    cells = df.groupBy(by, other).agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    return groups.select(F.expr("n * (n - 1) div 2 - same").alias("numerator"), F.expr("n * (n - 1) div 2").alias("denominator"))


def interval(strata: DataFrame, replicates: int = 2000, seed: int = 20260731, level: float = 0.95) -> DataFrame:
    """One row (lower, upper, effective): the interval of sum(numerator) / sum(denominator) over strata drawn with replacement.

    Equal strata are one kind with a number. A replicate draws how many strata fall to each part of KINDS kinds, from the parts' totals and a seed that hangs
    on the replicate alone, so that all tasks agree; within a part, its kinds' numbers. Parts and replicates are spread over the
    executors; only sums by replicate are shuffled. Replicates without a denominator do not count. Without strata, or if no numerator is above zero, the bounds are 0.
    """
    if replicates <= 0 or not 0 < level < 1:
        raise ValueError("replicates must be positive and the level between 0 and 1")
    if strata.filter("numerator < 0 OR numerator > denominator").head(1):
        raise ValueError("strata need 0 <= numerator <= denominator")
    spark = strata.sparkSession
    kinds = strata.groupBy("numerator", "denominator").agg(F.count(F.lit(1)).alias("times"))
    kinds = numbered(kinds, [F.pmod(F.xxhash64("numerator", "denominator"), F.lit(1024))], ["numerator", "denominator"], "no", -1)
    kinds = stored(kinds.withColumn("part", F.floor(F.col("no") / KINDS)), "strata-kinds")
    sizes = kinds.groupBy("part").agg(F.sum("times").alias("n"), F.max("numerator").alias("a"), F.max("denominator").alias("b")).orderBy("part").collect()  # a row for KINDS kinds
    if not any(r.a for r in sizes):
        return spark.createDataFrame([(0.0, 0.0, replicates if any(r.b for r in sizes) else 0)], "lower double, upper double, effective long")
    parts = np.array([r.n for r in sizes], dtype=np.int64)

    def drawn(key, pdf):
        part, chunk = map(int, key)
        pdf, out = pdf.sort_values("no"), []
        times = pdf["times"].to_numpy()
        a, b = pdf["numerator"].to_numpy(dtype=np.float64), pdf["denominator"].to_numpy(dtype=np.float64)
        for r in range(chunk * REPLICATES, min(replicates, (chunk + 1) * REPLICATES)):
            here = np.random.default_rng([seed, r]).multinomial(parts.sum(), parts / parts.sum())[part]
            taken = np.random.default_rng([seed, r, 1 + part]).multinomial(here, times / times.sum())
            out.append((r, float(taken @ a), float(taken @ b)))
        return pd.DataFrame(out, columns=["r", "a", "b"])

    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATES)))
    sums = kinds.withColumn("chunk", chunks).groupBy("part", "chunk").applyInPandas(drawn, "r long, a double, b double").groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tail = (1 - level) / 2
    found = sums.filter("b > 0").agg(F.percentile(F.col("a") / F.col("b"), F.array(F.lit(tail), F.lit(1 - tail))).alias("p"), F.count(F.lit(1)).alias("effective"))
    zero = F.lit(0.0)
    return found.select(F.coalesce(F.col("p")[0], zero).alias("lower"), F.coalesce(F.col("p")[1], zero).alias("upper"), "effective")


def read_partition(df: DataFrame, member: str, cluster: str, truth: str) -> DataFrame:
    """One row: clusters of reads against the groups they come from. Rows without a cluster are reads that the clusters miss, and only counted.

    A read that stands in several rows is refused.
    """
    if df.groupBy(member).count().filter("count > 1").head(1):
        raise ValueError("a read stands in several rows")
    asked = df.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col(cluster).isNull()).alias("missing"))
    df = df.filter(F.col(cluster).isNotNull())
    cells = df.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))

    def side(by: str, names: tuple[str, str, str, str]) -> DataFrame:
        groups = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"), F.count(F.lit(1)).alias("others"))
        sums = [F.count(F.lit(1)), F.count_if(F.expr("others > 1")), F.sum(F.expr("n * (n - 1) div 2")), F.sum(F.expr("n * (n - 1) div 2 - same"))]
        return groups.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for c, k in zip(sums, names, strict=True)])

    out = asked.join(side(cluster, ("clusters", "mixed_clusters", "cluster_pairs", "false_merges"))).join(side(truth, ("truth_groups", "split_groups", "truth_pairs", "false_splits")))  # single rows
    out = out.withColumn("observations", F.col("requested") - F.col("missing"))
    return out.withColumns({"false_merge_rate": ratio("false_merges", "cluster_pairs"), "false_split_rate": ratio("false_splits", "truth_pairs")})


def read_intervals(df: DataFrame, cluster: str, truth: str, replicates: int = 2000, seed: int = 20260731) -> DataFrame:
    """metric, lower, upper, effective: false merges with clusters drawn, false splits with truth groups drawn."""
    df = df.filter(F.col(cluster).isNotNull())
    merge = interval(partition_strata(df, cluster, truth), replicates, seed).withColumn("metric", F.lit("false_merge_rate"))
    return merge.unionByName(interval(partition_strata(df, truth, cluster), replicates, seed + 1).withColumn("metric", F.lit("false_split_rate")))


def bootstrap_discovery(hits: int, truth: int, right: int, predicted: int, draws: int = 1000, seed: int = 1, level: float = 0.95) -> dict[str, float]:
    """Intervals of precision, recall and F1 when truths and predictions are resampled; counts come from an aggregate."""
    rng, found = random.Random(seed), {"precision": [], "recall": [], "f1": []}
    for _ in range(draws):
        r = rng.binomialvariate(truth, hits / truth) / truth if truth else 0.0
        p = rng.binomialvariate(predicted, right / predicted) / predicted if predicted else 0.0
        for k, v in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r) if p + r else 0.0)):
            found[k].append(v)
    tail = (1 - level) / 2
    return {f"{k}_{end}": percentile(v, share) for k, v in found.items() for end, share in (("low", tail), ("high", 1 - tail))}


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: share, value."""
    one = df.agg(F.percentile(column, F.array(*[F.lit(s) for s in shares])).alias("v"))
    return one.select(F.posexplode("v").alias("i", "value")).select(F.array(*[F.lit(s) for s in shares])[F.col("i")].alias("share"), "value")


def partition_metrics(df: DataFrame, cluster: str, form: str, chain: str, row: str) -> DataFrame:
    """Clusters against exact forms: mixed clusters, those that only merge end variants, split forms, and the matrix of rows and clusters.

    Rows without a cluster are omitted members: they are counted, with the forms that are omitted as a whole, and take no part in the rest.
    """
    lost = df.groupBy(form).agg(F.count_if(F.col(cluster).isNull()).alias("o"), F.count(cluster).alias("k"))
    lost = lost.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("omitted"), F.count_if(F.expr("k = 0")).alias("omitted_forms"))
    df = df.filter(F.col(cluster).isNotNull())
    by_cluster = df.groupBy(cluster).agg(F.count_distinct(form).alias("f"), F.count_distinct(F.coalesce(chain, form)).alias("c"))
    by_form = df.groupBy(form).agg(F.count_distinct(cluster).alias("k"))
    a = by_cluster.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.expr("f > 1")).alias("mixed"), F.count_if(F.expr("f > 1 AND c = 1")).alias("end_merges"))
    b = by_form.agg(F.count(F.lit(1)).alias("forms"), F.count_if(F.expr("k > 1")).alias("split_forms"))
    cells = df.select(row, cluster).distinct().agg(F.count(F.lit(1)).alias("cells"), F.count_distinct(row).alias("rows"))
    out = a.join(b).join(cells).join(lost)  # single rows
    out = out.withColumn("occupancy", ratio("cells", "clusters") / F.greatest("rows", F.lit(1)))
    return out.withColumn("sparsity", F.when(F.col("cells") > 0, 1 - F.col("occupancy")).otherwise(F.lit(0.0)))


def signature_changes(left: DataFrame, right: DataFrame, label: str, member: str) -> DataFrame:
    """Groups of members that only one of two partitions holds, labels aside: side and how many."""

    def signatures(df):
        return df.groupBy(label).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(member)), "\n"), 256).alias("s")).select("s").distinct()

    a, b = signatures(left), signatures(right)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(a.join(b, "s", "left_anti"), "only_left").join(one(b.join(a, "s", "left_anti"), "only_right")).join(one(a.join(b, "s", "left_semi"), "both"))


def audited(stored: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that only one of two tables holds, with repeats: side and the columns."""
    a, b = stored.select(*keys), computed.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("computed")))


def perturbed(models: DataFrame) -> DataFrame:
    """The first exon's end moved by a base, or a single exon's start."""
    one = F.expr("IF(size(exons) = 1, array(named_struct('start', exons[0].start + 1, 'end', exons[0].end)), transform(exons, (x, i) -> named_struct('start', x.start, 'end', IF(i = 0, x.end + 1, x.end))))")
    return models.withColumn("exons", one)
