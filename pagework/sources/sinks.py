"""Writing pages, bundles, backups and site maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.operators.linkfix import backups_of
from pagework.operators.sitemap import sitemap_lines
from pagework.sources.site_files import save_files


def write_pages(pages: DataFrame, path: str, by_site: bool = False) -> None:
    """Saved pages ``(site, path, html)`` as Parquet. ``by_site`` makes a folder per site, which
    suits a few big sites; the rows of a site stay spread over as many files as tasks."""
    writer = pages.write.mode("overwrite")
    (writer.partitionBy("site") if by_site else writer).parquet(path)


def write_bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Fetched pages as a table bucketed by page, so that edits join without moving page text."""
    pages.write.mode("overwrite").bucketBy(buckets, "site", "url").sortBy("site", "url").saveAsTable(
        table
    )


def write_bundles(chunks: DataFrame, path: str) -> None:
    """Bundle chunks as text, one folder per site and kind.

    Chunks are range-partitioned in bundle order, so a big bundle is written by many tasks. The files
    of a folder in the order of their names are the bundle. An empty bundle writes nothing.
    """
    (
        chunks.repartitionByRange("site", "kind", "chunk_order")
        .sortWithinPartitions("site", "kind", "chunk_order")
        .select("site", "kind", F.col("chunk").alias("value"))
        .write.mode("overwrite")
        .partitionBy("site", "kind")
        .text(path)
    )


def write_backups(files: DataFrame, fixes: DataFrame, path: str, earlier: str | None = None) -> None:
    """The original text of the files that ``fixes`` changes, before they are overwritten, as one table.

    ``earlier`` is the folder of the last run's backups. They go along into the new folder, which must
    be another one; of a file that both runs change the new backup counts. ``BackupStore`` keeps the texts of
    all runs by itself.
    """
    made = backups_of(files, fixes)
    if earlier is not None:
        old = files.sparkSession.read.parquet(earlier)
        changed = fixes.select("site", "path").distinct()
        made = made.unionByName(old.join(changed, ["site", "path"], "left_anti"))
    made.write.mode("overwrite").parquet(path)


def write_sitemap(rows: DataFrame, path: str, lines: bool = False) -> None:
    """Site map rows as Parquet, or as lines of text; both keep the order of the rows."""
    if lines:
        sitemap_lines(rows).write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def export_files(pages: DataFrame, root: str) -> DataFrame:
    """Write every page ``(site, path, html)`` to its own file below ``root``, from the tasks, and return the
    pages that were refused as ``(site, path, reason)``. ``root`` must be a folder that all executors share."""
    return save_files(pages.select("site", "path", F.col("html").cast("binary").alias("body")), root)
