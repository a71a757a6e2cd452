"""Session settings used by tests and benchmarks; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandlake-"))
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder, for plans that read them several times."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    jvm, conf, top = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), work_dir(spark)
    plain = lambda p: p.split(":", 1)[-1].lstrip("/")
    for folder in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        if plain(folder).startswith(plain(top)):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Actions within send Arrow batches of about this size to Python, however long their rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandlake")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
