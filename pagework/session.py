"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL settings the jobs are written for; all can be changed at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Work on text costs far more per byte than the default assumes; small inputs keep their tasks.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Page text meets its edits by a hash join where the edits of a partition are small, so that the
    # text is not sorted; adaptive execution checks the size.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # What a job writes between its steps is read a few times at most, so space counts more than time to pack it.
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and measurements on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagework")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
