"""The state of the last snapshot between runs: a new snapshot of a catalog is compared with it alone.

A state is a folder of its own number; Spark's success marker says that it is whole. A run that is lost leaves a folder without the marker,
which the next run writes over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sinks.files import Files


class SnapshotError(ValueError):
    """A snapshot in which a form has two chains."""


class SnapshotState:
    """States (form_id, splice_chain_id, classifications) in a folder; a state is hashed by form and sorted, so that the next one meets it evenly."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def last(self) -> int:
        """The number of the last whole state; 0 for none."""
        folder = self.files.path(self.path)
        if not self.files.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.files.fs.listStatus(folder)]
        whole = [int(n) for n in names if n.isdigit() and self.files.fs.exists(self.files.path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def state(self) -> DataFrame | None:
        at = self.last()
        return self.spark.read.parquet(f"{self.path}/{at:08d}") if at else None

    def add(self, catalog: DataFrame) -> dict[str, int]:
        """Compare a snapshot with the last state and put it in its place. catalog: form_id, splice_chain_id, classifications (joined by commas); a form may have several rows."""
        at = self.last()
        before = self.state()
        chain = F.coalesce("splice_chain_id", F.lit(""))
        labels = F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("classifications", F.lit("")), ","), lambda x: x != ""))))
        rows = catalog.groupBy("form_id").agg(F.min(chain).alias("splice_chain_id"), F.max(chain).alias("_other"), F.array_sort(labels).alias("classifications"))
        path = f"{self.path}/{at + 1:08d}"
        rows.repartition("form_id").sortWithinPartitions("form_id").write.mode("overwrite").parquet(f"{path}.new")
        now = self.spark.read.parquet(f"{path}.new")
        if bad := now.filter("splice_chain_id <> _other").head(1):
            self.files.fs.delete(self.files.path(f"{path}.new"), True)
            raise SnapshotError(f"form {bad[0].form_id} has two chains")
        found = {"snapshot": at + 1, "forms": now.count(), "new": 0, "disappeared": 0, "changed_chains": 0, "lost_labels": 0}
        if before is not None:
            old = before.select("form_id", F.col("splice_chain_id").alias("old_chain"), F.col("classifications").alias("old"))
            both = now.join(old, "form_id", "full")
            held, had = F.col("classifications").isNotNull(), F.col("old").isNotNull()
            counts = {"new": held & ~had, "disappeared": had & ~held, "changed_chains": held & had & (F.col("splice_chain_id") != F.col("old_chain")), "lost_labels": held & had & (F.size(F.array_except("old", "classifications")) > 0)}
            found |= both.agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).first().asDict()
        else:
            found["new"] = found["forms"]
        # a folder that a lost run left under the number has no marker and goes
        self.files.fs.delete(self.files.path(path), True)
        if not self.files.fs.rename(self.files.path(f"{path}.new"), self.files.path(path)):
            raise SnapshotError(f"cannot write state {at + 1}")
        return found
