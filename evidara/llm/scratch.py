"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset (tests): a temporary folder on a local master, else a folder of the warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        known = f"file://{tempfile.mkdtemp(prefix='evidara-')}"
    else:
        known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", known)
    return known


def filesystem(spark: SparkSession, folder: str):
    """(Hadoop file system of a folder, class of its paths)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the table has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *replaced: str) -> list[str]:
    """Columns of the table but for the named ones, in whatever case."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


class Scratch:
    """Tables written to the shared folder and read again.

    ``keep`` cuts the lineage at a durable copy: a lost executor costs the tasks that it ran, not the steps before
    the table. What is not dropped earlier goes when the session ends. ``hold`` is for what is read a few times soon
    after and is one step away from a table: it stays on the executors' disks until ``release``, and what goes with an
    executor is computed again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._fs, self._path = filesystem(spark, self.root)
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0
        self._held: list[DataFrame] = []

    def hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()  # computed once, before several branches of a plan ask for it
        return df

    def release(self, *tables: DataFrame) -> None:
        """Gives up the held tables named, or all."""
        for t in tables or self._held:
            t.unpersist()
        self._held = [t for t in self._held if tables and t not in tables]

    def keep(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            self._fs.delete(self._path(t._scratch_path), True)
