"""Sessions, table loading, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_written: list[str] = []


def local_session(cpus: int = 8, app: str = "loomgraph", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a Parquet file or a folder of them. Times are zone-less UTC, so the session's zone is pinned."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set; in tests, where it is unset, an own temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        _own.append(root[7:])
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


class Cut:
    """A DataFrame written to the shared folder and read back, so later plans start from files that outlive any executor.

    Unlike checkpoint(), the write computes the plan once. drop() removes the files once nothing reads them any more.
    """

    def __init__(self, df: DataFrame, label: str = "cut", partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    return Cut(df, label).df


def bounded(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Marks a written, narrow table for broadcast if it is counted to have at most so many rows; else it is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of plans that are no longer held; without it they stay until some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in _written:
        if path.startswith("file:") or path.startswith("/"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    for path in _own:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
