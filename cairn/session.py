"""What the session gives: the shared folder, and tables in it that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary folder of this machine stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"cairn-{os.getuid()}")
    return named.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive lost executors. What isn't dropped before goes
    when the driver ends, as results may be read from it until then."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cairn/{what}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the table that was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again; without names, all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that stand for much work each, such as paths of files: adaptive execution, which sees small rows alone,
    would put them into one task, but leaves a number that is asked for as it is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches of this session hold no more than so many bytes (by default they may hold 64 MB).

    Each task has batches on both sides, in the JVM and in Python, so their size is a good part of an executor's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
