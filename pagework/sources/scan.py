"""Reading pages, assets and saved sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.functions.urls import netloc_of
from pagework.sources.site_files import read_files

HTML_SUFFIXES = (".html", ".htm")


def scan_pages(raw: DataFrame) -> DataFrame:
    """``(site, url, page_order, html)`` from a table ``(page_id, url, html[, status])``.

    A failed page yields nothing.
    """
    if "status" in raw.columns:
        raw = raw.filter(F.col("status") < 400)
    return raw.select(
        netloc_of(F.col("url")).alias("site"), "url", F.col("page_id").alias("page_order"), "html"
    )


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are no UTF-8 are dropped. A replacement character that stands in the
    text stays: it is written as a mark, and the mark as another, while the bytes are tested."""
    mark, itself, replacement = F.lit("\ue000"), F.lit("\ue000A"), F.lit("\ufffd")
    there = F.lit("\ue000B")
    marked = F.replace(F.replace(content.cast("string"), mark, itself), replacement, there)
    clean = F.replace(F.make_valid_utf8(marked), replacement, F.lit(""))
    return F.replace(F.replace(clean, there, replacement), itself, mark)


def list_html_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of all ``.html`` and ``.htm`` files below a folder; bodies are not read."""
    return _files(spark, folder, HTML_SUFFIXES, False).select("path", "length")


def scan_html_files(spark: SparkSession, folder: str, site: str = "") -> DataFrame:
    """Saved site below a folder as ``(site, path, html)``."""
    return _files(spark, folder, HTML_SUFFIXES, True).select(
        F.lit(site).alias("site"), "path", decode_text(F.col("content")).alias("html")
    )


def list_files(spark: SparkSession, folder: str, site: str = "") -> DataFrame:
    """``(site, path)`` of every file below a folder, whatever its kind."""
    return _files(spark, folder, (), False).select(F.lit(site).alias("site"), "path")


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...], content: bool) -> DataFrame:
    """Files by their path below the folder; the tasks list and read them."""
    found = read_files(spark, folder, content, suffixes)
    return found.withColumn("path", F.when(F.col("site") == "", F.col("path")).otherwise(F.concat_ws("/", "site", "path")))
