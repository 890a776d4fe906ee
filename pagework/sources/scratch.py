"""Intermediate tables that are used more than once.

They are written to the shared folder the cluster names in ``spark.checkpoint.dir``. A written table
cuts the lineage, survives the loss of executors, and is read back with only the columns needed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagework-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Folder of one run. ``drop`` removes it when the results have been written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_root(spark).rstrip('/')}/pagework-{uuid.uuid4().hex}"
        self.made = 0
        self.tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table. Every call has a place of its own, so jobs may
        share a scratch."""
        path = self.place(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def place(self, name: str) -> str:
        self.made += 1
        return f"{self.folder}/{self.made:03d}-{name}"

    def keep_bucketed(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """The same in buckets of ``keys``: joins on these keys move the other side only."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"pagework_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", self.place(name)).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def bucketed(self, name: str) -> BucketedTable:
        """A table in buckets that grows by what is appended to it."""
        return BucketedTable(self, name)

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class BucketedTable:
    """Rows in buckets of keys, appended part by part. A join on the keys moves the other side only, however
    many parts there are."""

    def __init__(self, scratch: Scratch, name: str):
        self.spark, self.path = scratch.spark, scratch.place(name)
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"pagework_{uuid.uuid4().hex}"
        scratch.tables.append(self.table)

    def append(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Add the rows and return the whole table."""
        writer = df.repartition(self.buckets, *keys).write.mode("append").bucketBy(self.buckets, *keys)
        writer.sortBy(*keys).option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)
