"""Runs of one data set against each other: the same observations labelled again, partitions of members, and what truth does not cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import stored


def compared(runs: dict[str, DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """run, column and changes: how many observations have another value than in the first run; nulls are equal.

    Every run must hold the same keys, each once; otherwise nothing is compared. All runs meet in one grouping by key.
    """
    names = list(runs)
    told = reduce(DataFrame.unionByName, [df.select(*key, F.lit(i).alias("_run"), F.struct(*columns).alias("_v")) for i, df in enumerate(runs.values())])
    seen = [F.count_if(F.col("_run") == i).alias(f"_n{i}") for i in range(len(names))]
    by = told.groupBy(*key).agg(*seen, *[F.max(F.when(F.col("_run") == i, F.col("_v"))).alias(f"_v{i}") for i in range(len(names))])
    once = reduce(lambda x, y: x & y, [F.col(f"_n{i}") == 1 for i in range(len(names))])
    cells = [(i, c) for i in range(1, len(names)) for c in columns]
    other = [F.count_if(~F.col(f"_v0.{c}").eqNullSafe(F.col(f"_v{i}.{c}"))) for i, c in cells]
    bad, *changes = by.agg(F.count_if(~once), *other).first()
    if bad:
        raise ValueError(f"{bad} observations are not in each run once")
    return by.sparkSession.createDataFrame([(names[i], c, n) for (i, c), n in zip(cells, changes, strict=True)], "run string, column string, changes long")


def membership_changes(left: DataFrame, right: DataFrame, cluster: str, member: str) -> DataFrame:
    """One row on two partitions that need not have the same members: members of each, shared, of one alone; pairs that only one of the two
    joins and members with another cluster, both among shared members. Members without a cluster are none; one with several is refused.
    """
    side = lambda df, i: df.filter(F.col(cluster).isNotNull()).select(F.col(member).alias("m"), F.lit(i).alias("side"), F.col(cluster).alias("c"))
    pick = lambda i: [F.max(F.when(F.col("side") == i, F.col("c"))).alias("ab"[i]), F.count_distinct(F.when(F.col("side") == i, F.col("c"))).alias(f"n{i}")]
    by = side(left, 0).unionByName(side(right, 1)).distinct().groupBy("m").agg(*pick(0), *pick(1))
    cells = stored(by.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("n0 > 1 OR n1 > 1")).alias("several")), "membership")
    if cells.filter("several > 0").head(1):
        raise ValueError("a member stands in several clusters")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    told = {"members_left": a, "members_right": b, "members_shared": a & b, "only_left": a & ~b, "only_right": b & ~a, "changed_clusters": F.col("a") != F.col("b")}
    shared = cells.filter(a & b)
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))
    sizes = [shared.groupBy(k).agg(F.sum("n").alias("n")) for k in ("a", "b")]
    x, y, z = (pairs(df).withColumnRenamed("p", name) for df, name in zip([*sizes, shared], "xyz", strict=True))
    out = cells.agg(*[total(c).alias(k) for k, c in told.items()]).join(x).join(y).join(z)  # single rows
    return out.withColumn("changed_pairs", (F.col("x") + F.col("y") - 2 * F.col("z")).cast("long")).drop("x", "y", "z")


def restricted(clusters: DataFrame, truth: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """Rows of clusters whose member truth knows, and one row with how many members it does not know."""
    known = truth.select(member).distinct()
    return clusters.join(known, member, "left_semi"), clusters.join(known, member, "left_anti").agg(F.count_distinct(member).alias("ignored"))
