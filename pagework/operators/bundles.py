"""Bundles: all style sheets of a site in one file, all scripts in another.

A bundle is a table of ordered chunks. It is never gathered in one place, because the bundle of a big
site does not fit there; the writer cuts it into parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions.paths import Layout
from pagework.operators.ordering import page_slice, running_total
from pagework.operators.resources import first_order
from pagework.sources.scratch import Scratch

PART_CHARACTERS = 64 * 1024 * 1024


def bundle_order(resources: DataFrame) -> DataFrame:
    """``(site, url, chunk_order)`` of the style sheets and scripts that were fetched, numbered in the order of
    first sight by site and kind. Only this narrow table is sorted; text meets its number in a join."""
    ordered = running_total(
        resources.filter(F.col("ok") & F.col("kind").isin("css", "js")).select("site", "url", "kind", "first"),
        ["site", "kind"],
        page_slice(F.col("first.page_order")),
        first_order("url"),
        F.lit(1),
        "chunk_order",
    )
    return ordered.select("site", "url", "chunk_order")


def bundle_chunks(bodies: DataFrame, resources: DataFrame) -> DataFrame:
    """Chunks ``(site, kind, chunk_order, source_url, chunk)`` in the order of first sight.

    ``bodies(site, url, kind, content)``: the fetched bodies of kind css or js, each URL once, as catalogued in
    ``resources``.
    """
    ordered = bodies.filter(F.col("kind").isin("css", "js")).join(bundle_order(resources), ["site", "url"])
    header = F.concat(F.lit("\n/* Source: "), F.col("url"), F.lit(" */\n"))
    return ordered.select(
        "site",
        "kind",
        "chunk_order",
        F.col("url").alias("source_url"),
        F.concat(header, F.col("content")).alias("chunk"),
    )


def _placed(chunks: DataFrame, size: Column) -> DataFrame:
    """Chunks with ``_start``: the sum of the sizes before, a line break after each counted."""
    sizes = chunks.select("site", "kind", "chunk_order", size.cast("long").alias("_size"))
    placed = running_total(
        sizes, ["site", "kind"], page_slice(F.col("chunk_order")), ["chunk_order"], F.col("_size") + 1, "_start"
    )
    return chunks.join(placed.drop("_size"), ["site", "kind", "chunk_order"])


def bundle_parts(chunks: DataFrame, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """The text of each bundle in parts ``(site, kind, part, text)``.

    The parts of a bundle, in order and joined by a line break, are the bundle. A part ends with the
    chunk that fills it, so a bundle below the bound is one part.
    """
    placed = _placed(chunks, F.length("chunk"))
    part = F.floor(F.col("_start") / F.lit(part_characters)).cast("long")
    texts = F.array_sort(F.collect_list(F.struct("chunk_order", "chunk")))
    return (
        placed.groupBy("site", "kind", part.alias("part"))
        .agg(texts.alias("chunks"))
        .select(
            "site",
            "kind",
            "part",
            F.array_join(F.transform("chunks", lambda c: c["chunk"]), "\n").alias("text"),
        )
    )


def bundle_pieces(chunks: DataFrame, layout: Layout, scratch: Scratch) -> DataFrame:
    """The bundles as pieces of files, ``(site, path, start, size, body)``: the chunks in order, joined by a line
    break. Where a piece begins is known from the sizes of those before it, so each task writes the pieces it
    has; no task holds a bundle. Chunks are written once, because their sizes are read before their text."""
    chunks = scratch.keep(chunks, "chunks")
    sizes = chunks.groupBy("site", "kind").agg((F.sum(F.octet_length("chunk") + 1) - 1).alias("size"))
    path = F.when(F.col("kind") == "css", F.lit(layout.css_bundle)).otherwise(F.lit(layout.js_bundle))
    inner = F.col("chunk_order") > 0
    return _placed(chunks, F.octet_length("chunk")).join(sizes, ["site", "kind"]).select(
        "site",
        path.alias("path"),
        F.when(inner, F.col("_start") - 1).otherwise(F.col("_start")).alias("start"),
        "size",
        F.when(inner, F.concat(F.lit("\n"), "chunk")).otherwise(F.col("chunk")).cast("binary").alias("body"),
    )


def first_of_kind(matched: DataFrame) -> DataFrame:
    """The style sheet and the script of each page that stay when the others are merged: the first
    fetched one of its kind."""
    return (
        matched.filter(F.col("kind").isin("css", "js") & F.col("ok"))
        .groupBy("site", "url", "kind")
        .agg(F.min(F.struct("pos", "abs_url")).alias("first"), F.count(F.lit(1)).alias("n_merged"))
        .select("site", "url", "kind", "first.pos", "first.abs_url", "n_merged")
    )
