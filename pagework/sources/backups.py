"""A store of the texts that repairs have replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.operators.linkfix import FILE_KEY, restore

BACKUP = "site string, path string, html string"


class BackupStore:
    """Folder of generations, one for each repair that was kept: the files it changed, as they were before.

    A generation is a table that is written once and counts when it is whole. A file that several repairs
    changed is in several generations: ``'first'`` names its text before all of them, ``'last'`` its text before
    the latest.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.store = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _child(self, *names: str):
        place = self.folder
        for name in names:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(place, name)
        return place

    def generations(self) -> list[int]:
        """Numbers of the whole generations, ascending."""
        if not self.store.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.store.listStatus(self.folder)]
        found = [n for n in names if n.startswith("generation=") and self.store.exists(self._child(n, "_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in found)

    def add(self, backups: DataFrame) -> int:
        """Keep ``backups(site, path, html)`` as a new generation and return its number. A generation that was
        not finished is written over."""
        number = max(self.generations(), default=0) + 1
        rows = backups.select(*FILE_KEY, "html")
        rows.write.mode("overwrite").parquet(self._child(f"generation={number}").toString())
        return number

    def rows(self, which: str = "first") -> DataFrame:
        """One text ``(site, path, html)`` of each file. Which generation counts is found without the texts."""
        if which not in ("first", "last"):
            raise ValueError(f"not a choice of generations: {which}")
        numbers = self.generations()
        if not numbers:
            return self.spark.createDataFrame([], BACKUP)
        every = None
        for n in numbers:
            one = self.spark.read.schema(BACKUP).parquet(self._child(f"generation={n}").toString())
            one = one.withColumn("generation", F.lit(n))
            every = one if every is None else every.unionByName(one)
        if len(numbers) == 1:
            return every.drop("generation")
        pick = F.min if which == "first" else F.max
        chosen = every.groupBy(*FILE_KEY).agg(pick("generation").alias("generation"))
        return every.join(chosen, [*FILE_KEY, "generation"], "left_semi").drop("generation")

    def restore(self, files: DataFrame, which: str = "first") -> DataFrame:
        """``(site, path, html, restored)``: the files with all texts put back. The store keeps them until
        ``clear``, which is for the time when the files are written."""
        return restore(files, self.rows(which))

    def clear(self) -> None:
        """Drop all generations: their texts are back."""
        self.store.delete(self.folder, True)
