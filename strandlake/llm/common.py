"""What the operators share: tables, the shared folder, skew-proof lookups, byte hashing.

The byte kernel hashes runs of bytes with C[e] - C[s], where C is the running sum of
table[byte] * A**i modulo 2**64. A is odd, so A**-s takes the position out again and equal
runs get equal numbers. All work is whole-array work on the concatenated texts of a batch. The
tables of powers have a fixed length, so a very long text costs memory only while it is worked on.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A key is hot if it has over 1 / HOT of all rows, so there are fewer than HOT hot keys.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """The name, with further underscores if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandlake-"))
    return f"file://{_own[0]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of kept() that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = shared_dir(spark)
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if folder.split(":", 1)[-1].lstrip("/").startswith(top.split(":", 1)[-1].lstrip("/")):
                path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Between large phases: without references to finished shuffles Spark deletes their files from the executors' disks."""
    for _ in range(2):  # the first frees Python's references, the second what the JVM held for them; the cleaner then needs a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Actions within send Arrow batches of about this size to Python; rows of tens of KB make large ones else."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def looked_up(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, after=lambda df: df) -> DataFrame:
    """left with the columns of right, which has one row a key. weight: the key's rows in left; total: all rows.

    Hot keys (fewer than HOT of them, whatever the data) go by broadcast; the rest by a shuffled
    join, in which no key has over total / HOT rows. Rows of left without a match are dropped. after is
    applied to both parts before they are put together; no key is in both.
    """
    hot = F.col(weight) * HOT > total
    few = F.broadcast(right.filter(hot).withColumn("_hot", F.lit(True)))
    names = [c for c in right.columns if c != key]
    tagged = left.join(few.select(key, "_hot", *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    done = tagged.filter(F.col("_hot")).select(*left.columns, *[F.col(f"_{c}").alias(c) for c in names])
    rest = tagged.filter(F.col("_hot").isNull()).select(*left.columns).join(right.filter(~hot), key)
    return after(done.select(*left.columns, *names)).unionByName(after(rest.select(*left.columns, *names)))


# ---------------------------------------------------------------------------- bytes
_MULT = 0x9E3779B97F4A7C15 | 5
_M64 = (1 << 64) - 1


@cache
def byte_table(lower: bool) -> np.ndarray:
    """A fixed random number for each byte; with lower, A-Z count as a-z."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    t = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
    if lower:
        t[65:91] = t[97:123]
    return t


#: Bytes that one table of powers covers; later stretches of a long batch use it again.
STRETCH = 1 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, of fixed length."""
    out = []
    for base in (_MULT, pow(_MULT, -1, 1 << 64)):
        p = np.full(STRETCH, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Bytes:
    """The texts of a batch as one array of bytes, with hashes of any of its runs."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n, power = len(self.data), _powers()[0]
        self._far = np.array([pow(_MULT, -STRETCH * k, 1 << 64) for k in range(n // STRETCH + 1)], dtype=np.uint64)
        self._sum, table = np.zeros(n + 1, dtype=np.uint64), byte_table(lower)
        for k, s in enumerate(range(0, n, STRETCH)):
            part = table[self.data[s : s + STRETCH]]
            part *= power[: len(part)]
            if k:
                part *= np.uint64(pow(_MULT, STRETCH * k, 1 << 64))
                part[:1] += self._sum[s : s + 1]
            np.cumsum(part, out=self._sum[s + 1 : s + 1 + len(part)])

    def _back(self, at: np.ndarray) -> np.ndarray:
        """What takes the position out of a difference of sums."""
        near = _powers()[1]
        return near[at] if len(self.data) < STRETCH else near[at % STRETCH] * self._far[at // STRETCH]

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[start]) * self._back(start) + (end - start).astype(np.uint64))

    def hashed_all(self, width: int) -> np.ndarray:
        """Hashes of all runs of `width` bytes, whether or not they cross texts."""
        n = max(0, len(self.data) - width + 1)
        out, near = self._sum[width : width + n] - self._sum[:n], _powers()[1]
        for k, s in enumerate(range(0, n, STRETCH)):
            out[s : s + STRETCH] *= near[: len(out[s : s + STRETCH])]
            if k:
                out[s : s + STRETCH] *= self._far[k]
        return mixed(out + np.uint64(width))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word (a run without the bytes 0x20, 0x09-0x0D)."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        inside = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.starts[(self.sizes > 0) & (self.starts > 0)]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return s, e, np.searchsorted(self.ends, s, side="right")


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches, limit: int = 1 << 20):
    """Arrow batches (doc_id, text) cut or joined so that each holds about limit bytes of text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0), dtype=np.int64)
        total, first = np.cumsum(sizes), 0
        while first < len(sizes):
            base = total[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
