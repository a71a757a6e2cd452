"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

A batch's digests are counted first, by an aggregate whose partial sums come before any shuffle. They meet the
index in a sort-merge anti-join, and what it lacks is appended. The index keeps, for each digest,
the document that owns it and the rows of the batch that brought it.

Defined results: a null text counts as empty, so null and empty texts are copies of each
other; of equal texts within a batch the largest doc_id stays, and of several rows with that doc_id
one; a text that the index holds already is dropped in favour of the owner, with its first batch's and the
present batch's rows as group_size, but rows with the owner's doc_id stay, so that a batch given again after a failure keeps its owners; an empty batch gives no rows and leaves the index as it is; rows with a
null doc_id take part and own a digest only if no other row does; extra columns are carried and
never read. A text is one row, however long; only its digest is shuffled, if it has copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, dropped, kept, looked_up, shared_dir


def digest(text: str = "text") -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class DigestIndex:
    """A table of (digest, keep_id, group_size) in a folder, bucketed and sorted by digest.

    The folder holds the number of buckets, so that any session opens the index as it was made. Another number that is asked for is refused, and
    so is a folder with data that does not tell its number.
    """

    SCHEMA = "digest string, keep_id bigint, group_size bigint"
    #: Spark does not read files whose names begin with an underscore.
    MARK = "_buckets"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = self._held()
        if held is not None and buckets not in (None, held):
            raise ValueError(f"the index {self.path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if held is None:
            out = self._files().create(self._file(self.MARK), False)
            out.write(bytearray(str(self.buckets).encode()))
            out.close()
        self.name = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        # files that another session has added since this one opened the index
        spark.catalog.refreshTable(self.name)

    def _file(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._file().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _held(self) -> int | None:
        """The number of buckets that the folder tells, None for a new one."""
        files = self._files()
        if files.exists(self._file(self.MARK)):
            stream = files.open(self._file(self.MARK))
            try:
                return int(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        if files.exists(self._file()) and len(files.listStatus(self._file())):
            raise ValueError(f"the folder {self.path} has files but no number of buckets")
        return None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the batch's digests that the index lacks: (digest, keep_id, group_size), one row each."""
        new = batch.hint("merge").join(self.rows(), "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        """Delete the index with its files."""
        self.spark.sql(f"DROP TABLE {self.name}")
        self._files().delete(self._file(), True)


def _owners(rows: DataFrame, top: F.Column, index: DigestIndex) -> DataFrame:
    """(digest, copies, keep_id, group_size, top) of the batch's digests; the index gains the new ones.

    rows: (digest, doc_id, ...); top: what tells the row that stays from the others, null if the index had the digest.
    """
    grouped = kept(rows.groupBy("digest").agg(F.max("doc_id").alias("best"), top.alias("top"), F.count(F.lit(1)).alias("copies")), "dedup-batch")
    before = index.rows().select("digest", F.col("keep_id").alias("owner"), F.col("group_size").alias("held"))
    # written before the index grows
    found = kept(grouped.hint("merge").join(before, "digest", "left"), "dedup-owners")
    index.add(grouped.select("digest", F.col("best").alias("keep_id"), F.col("copies").alias("group_size")))
    dropped(index.spark, grouped)
    new = F.col("held").isNull()
    return found.select("digest", "copies", F.when(new, F.col("best")).otherwise(F.col("owner")).alias("keep_id"), (F.coalesce("held", F.lit(0)) + F.col("copies")).alias("group_size"), F.when(new, F.col("top")).alias("top"))


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row; the index gains the batch's new digests."""
    named = docs.select("doc_id", digest().alias("digest")).withColumn("row", F.monotonically_increasing_id())
    named = kept(named, "dedup-rows")  # so that rows keep their numbers
    owners = _owners(named, F.max(F.struct("doc_id", "row")), index)
    owners = owners.select("digest", "copies", "keep_id", "group_size", F.col("top.row").alias("top"))
    out = looked_up(named, owners, "digest", "copies", named.count())
    return out.select("doc_id", "keep_id", "group_size", F.when(F.col("top").isNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.col("row") == F.col("top")).alias("kept"), F.col("digest").alias("text_sha256"))


def fresh_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")


def decisions(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, against an empty index."""
    index = fresh_index(docs.sparkSession)
    out = deduplicated(docs.select("doc_id", "text"), index)
    index.drop()
    return out


def unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, one a text, with their own columns.

    Rows go to their digest's owner; those that are not it leave at once. Several rows with the owner's doc_id shrink to
    the one with the least hash of all its columns.
    """
    rows = docs.select("doc_id", digest().alias("digest"), F.struct(*columns(docs)).alias("row"))  # so that no name clashes
    mark = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.xxhash64("row"))
    index = fresh_index(docs.sparkSession)
    owners = _owners(rows, F.max(mark), index).select("digest", "copies", "top")
    index.drop()
    total = owners.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    staying = lambda df: df.filter(F.col("mark").eqNullSafe(F.col("top"))).dropDuplicates(["digest"])
    return looked_up(rows.withColumn("mark", mark), owners, "digest", "copies", total, staying).select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
