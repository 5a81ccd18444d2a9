"""Intermediate tables in the folder that all executors share.

A step that is read more than once, or that should survive the loss of an
executor, is written as Parquet under ``spark.checkpoint.dir``.  Where that setting is
absent, a local master (tests, notebooks) gets a folder of this machine and a cluster a
folder in its warehouse, which its executors share.  What an operator's result no longer
reads is deleted as soon as that is known, the rest when the application ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; one of our own only if there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/barquarry-{app}"
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="barquarry-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def names(spark: SparkSession, path: str, start: str) -> list[str]:
    """Names in a folder that begin so."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return [x for x in found if x.startswith(start)]


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = new(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, new(path)):
        raise RuntimeError(f"{path} is there already")


def input_bytes(df: DataFrame) -> int:
    """The size that Spark's planner expects."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the application ends, however it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles are no longer referenced.

    Shuffle files live until the driver's garbage is collected; between the
    phases of one operator that would keep several phases on disk at once.
    """
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables of one run of an operator, in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[tuple[DataFrame, str]] = []
        delete_at_end(spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *numbers: int) -> None:
        """Delete the tables written as these, counted from 1."""
        self.remove(*[df for df, path in self.tables if path in [f"{self.root}/{n}" for n in numbers]])

    def remove(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df, path in self.tables:
            if any(df is x for x in tables):
                delete(self.spark, path)
        self.tables = [(df, path) for df, path in self.tables if not any(df is x for x in tables)]

    def stands_for(self, derived: DataFrame, table: DataFrame) -> DataFrame:
        """Know a written table by what is derived from it."""
        self.tables = [(derived if df is table else df, path) for df, path in self.tables]
        return derived

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.remove(*[df for df, _ in self.tables if not any(df is x for x in tables)])


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions; shards and salts follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 1 << 22) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts and runs can be long: it exists in the executor, outside the heap, and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
