"""The registry: one Parquet dataset a table, staged imports, and what is computed over it.

A commit writes new parts of tables and then, by rename, one small file that names all parts: the state of the next
number. Readers take the greatest number, so they see the old state or the new one and never none. A lock file keeps writers apart.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.session import stored

SCHEMA_VERSION = 1


class RegistryError(ValueError):
    """A registry that does not hold together, or input that does not fit it."""


def numbered(df: DataFrame, bucket: list, order: list, name: str, after: int = 0) -> DataFrame:
    """Consecutive numbers from after + 1 in the order of `bucket`, then `order`.

    Rows are numbered within buckets, and the buckets' counts are summed; only these counts meet in one task.
    """
    keys = [f"_b{i}" for i in range(len(bucket))]
    df = df.withColumns(dict(zip(keys, bucket, strict=True)))
    counts = df.groupBy(*keys).count()
    base = counts.select(*keys, (F.sum("count").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))).alias("_base"))
    within = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = within.alias("w").join(base.alias("b"), same).select("w.*", "b._base")
    return out.withColumn(name, (F.col(name) + F.coalesce("_base", F.lit(0)) + after).cast("long")).drop("_base", *keys)


def summary(observations: DataFrame) -> DataFrame:
    n = F.countDistinct
    return observations.agg(
        F.count(F.lit(1)).alias("observations"), n("form_id").alias("forms"), n("chain_id").alias("chains"), n("sample").alias("samples"), n("tool").alias("tools"),
        F.sum(F.col("chain_id").isNull().cast("long")).alias("single_exon"),
    )


def catalog(observations: DataFrame) -> DataFrame:
    """One row a form, chain and gene: labels, observations, samples and tools."""
    return observations.groupBy("form_id", "splice_chain_id", F.col("output_gene_id").alias("gene_id")).agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("classifications"),
        F.count(F.lit(1)).alias("observation_count"),
        F.countDistinct("sample").alias("sample_count"),
        F.countDistinct("tool").alias("tool_count"),
    )


def collisions(rows: DataFrame, repeated: bool = False) -> DataFrame:
    """Forms with more than one digest; with repeated, also those that merely recur."""
    out = rows.groupBy("form_id").agg(F.countDistinct("form.full_digest").alias("digests"), F.count(F.lit(1)).alias("n"))
    return out.filter("digests > 1 OR n > 1" if repeated else "digests > 1")


def validated(rows: DataFrame) -> DataFrame:
    """How many stored identities do not follow from their canonical JSON."""
    wrong = (F.sha2("form.canonical_json", 256) != F.col("form.full_digest")) | ~F.endswith("form.public_id", F.substring("form.full_digest", 1, 24))
    return rows.agg(F.sum(F.coalesce(wrong, F.lit(True)).cast("long")).alias("invalid"), F.count(F.lit(1)).alias("checked"))


def orphans(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per foreign key the rows whose non-null value has no parent."""
    found = []
    for name, (child, column, parent, key) in references.items():
        lone = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        found.append(lone.agg(F.count(F.lit(1)).alias(name)))
    return reduce(lambda a, b: a.join(b), found)  # single rows


def inspected(observations: DataFrame, ids: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Observations that have one of the ids in any of the columns, each once."""
    long = observations.select(key, F.explode(F.array_distinct(F.array(*columns))).alias("id"))
    hits = long.join(ids.distinct(), "id", "left_semi").select(key).distinct()
    return observations.join(hits, key, "left_semi")


class Registry:
    """Tables by name in a folder; see the module for commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hpath = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._hpath(self.path).getFileSystem(conf)
        self._held = False
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._hpath(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hpath(self.path))]
        return sorted(int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json"))

    def _state(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"schema_version": SCHEMA_VERSION, "number": 0, "tables": {}}
        stream = self._fs.open(self._hpath(f"{self.path}/state-{numbers[-1]:08d}.json"))
        try:
            state = json.loads(self._text(stream))
        finally:
            stream.close()
        if state["schema_version"] != SCHEMA_VERSION:
            raise RegistryError(f"schema version {state['schema_version']} is not {SCHEMA_VERSION}")
        return state

    def number(self) -> int:
        """How many commits there have been."""
        return self._state()["number"]

    def _point(self, state: dict) -> None:
        state["number"] += 1
        staged, target = (self._hpath(f"{self.path}/{n}") for n in (f".{uuid.uuid4().hex}.json", f"state-{state['number']:08d}.json"))
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(staged, target):
            raise RegistryError(f"cannot write state {state['number']}")

    def _holder(self, lock) -> str:
        """Who holds the lock, and since when."""
        try:
            stream = self._fs.open(lock)
        except Py4JJavaError:
            return "it has just ended"
        try:
            return self._text(stream) or "it has just begun"
        finally:
            stream.close()

    @contextmanager
    def writing(self):
        """Hold the writer's lock; a command holds it from its first read to its last commit."""
        if self._held:
            yield
            return
        lock = self._hpath(f"{self.path}/writer.lock")
        try:
            out = self._fs.create(lock, False)
        except Py4JJavaError as e:
            raise RegistryError(f"another writer is at work: {self._holder(lock)}; if it was lost, delete {self.path}/writer.lock") from e
        out.write(bytearray(f"{socket.gethostname()}, process {os.getpid()}, since {datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}".encode()))
        out.close()
        self._held = True
        try:
            yield
        finally:
            self._held = False
            self._fs.delete(lock, False)

    def table(self, name: str) -> DataFrame | None:
        parts = self._state()["tables"].get(name)
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None

    def commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> None:
        """Append rows to tables and replace others, all or nothing."""
        with self.writing():
            state = self._state()
            for name, df in [*added.items(), *(replaced or {}).items()]:
                part = f"{name}/{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{part}")
                state["tables"][name] = [*(state["tables"].get(name, []) if name in added else []), part]
            self._point(state)

    def imported(self, manifest: dict[str, str], observations: DataFrame) -> bool:
        """Append an import once; the same manifest again changes nothing."""
        with self.writing():
            old = self.table("import_manifest")
            same = lambda k: F.col(k).eqNullSafe(F.lit(manifest[k]))
            if old is not None and old.filter(reduce(lambda x, y: x & y, map(same, manifest))).head(1):
                return False
            forms = self.new_structures(observations)
            row = self.spark.createDataFrame([tuple(manifest[k] for k in sorted(manifest))], ", ".join(f"{k} string" for k in sorted(manifest)))
            self.commit({"import_manifest": row, "structural_object": forms, "observation": observations.withColumns({k: F.lit(v) for k, v in manifest.items()})})
            return True

    def new_structures(self, rows: DataFrame) -> DataFrame:
        """Forms and chains that are not stored yet, each once, in a table of their own; raises if a public id would name two structures."""
        forms = rows.select("form.*").unionByName(rows.filter("splice_chain IS NOT NULL").select("splice_chain.*"))
        one = F.struct("family", "full_digest", "canonical_json")
        found = forms.groupBy("public_id").agg(F.min(one).alias("low"), F.max(one).alias("high"))
        if (held := self.table("structural_object")) is not None:
            found = found.join(held.groupBy("public_id").agg(F.min(one).alias("old"), F.max(one).alias("_old")), "public_id", "left")
        else:
            found = found.withColumns({"old": F.lit(None).cast(found.schema["low"].dataType), "_old": F.lit(None).cast(found.schema["low"].dataType)})
        differs = (F.col("low") != F.col("high")) | F.coalesce((F.col("old") != F.col("low")) | (F.col("_old") != F.col("low")), F.lit(False))
        found = found.withColumn("differs", differs).filter("differs OR old IS NULL").select("low.family", "public_id", "low.full_digest", "low.canonical_json", "differs")
        found = stored(found, "new-structures")  # the check and the commit read it
        if found.filter("differs").head(1):
            raise RegistryError("two structures share a public id")
        return found.drop("differs")
