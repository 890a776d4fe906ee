"""Edits of pages and style sheets.

An edit is a row ``(site, url, pos, name, value, dropped)``: give attribute ``name`` of the element at
``pos`` a new value, or drop the element. Operators produce edits; ``apply_edits`` brings them and the
page together. That join is the only place where page text is shuffled, and not even there if the
pages are bucketed by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import paths, urls
from pagework.functions.css import splice_css
from pagework.functions.markup import set_attributes, splice, tokens
from pagework.functions.paths import Layout
from pagework.operators.joins import lookup

PAGE_KEY = ["site", "url"]


def page_path(url: Column, layout: Layout) -> Column:
    return paths.page_path_tree(url) if layout.name == "tree" else paths.page_path_flat(url)


def page_folder(url: Column, layout: Layout) -> Column:
    """Folder of a page's file, needed for relative paths. A flat copy has no folders."""
    return paths.folder_of(paths.page_path_tree(url)) if layout.name == "tree" else F.lit("")


def asset_edits(matched: DataFrame, layout: Layout, consolidate: bool = True) -> DataFrame:
    """Edits that make a page refer to local files.

    ``matched`` comes from ``attach_resources``. A failed reference stays as it is. With
    ``consolidate`` the first style sheet and the first script of a page become the bundles; a flat
    copy drops the others, a tree points them all at the bundle. A column ``base`` is the address that
    decides where the page is saved, if that is not its ``url``.
    """
    placed = matched.repartition(*PAGE_KEY)
    bundled = F.col("kind").isin("css", "js") & F.lit(consolidate)
    bundle = F.when(F.col("kind") == "css", F.lit(layout.css_bundle)).otherwise(F.lit(layout.js_bundle))
    folder = page_folder(F.col("base" if "base" in matched.columns else "url"), layout)
    target = F.when(bundled, bundle).otherwise(F.col("local_path"))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    kind_of_page = Window.partitionBy(*PAGE_KEY, "kind")
    first = F.min(F.when(ok, F.col("pos"))).over(kind_of_page)
    collapse = bundled & F.lit(layout.name == "flat")
    parts = placed.select(
        *PAGE_KEY,
        "pos",
        "slot",
        "cand_pos",
        "raw_ref",
        "descriptor",
        "holder",
        ok.alias("ok"),
        (collapse & ok & (F.col("pos") != first)).alias("dropped"),
        F.when(ok, paths.relative_path(target, folder)).alias("value"),
    )
    part = F.struct("cand_pos", "ok", "value", "raw_ref", "descriptor")
    slots = parts.groupBy(*PAGE_KEY, "pos", "slot").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max("holder").alias("holder"),
        F.max("dropped").alias("dropped"),
    )
    good = F.filter("parts", lambda p: p["ok"])
    return slots.filter(F.array_contains("parts.ok", True)).select(
        *PAGE_KEY,
        "pos",
        F.col("slot").alias("name"),
        F.when(F.col("slot") == "srcset", srcset_value(F.col("parts"), layout))
        .when(
            F.col("slot") == "style",
            splice_css(
                F.col("holder"),
                F.transform(
                    good, lambda p: F.struct(p["cand_pos"].alias("pos"), p["value"].alias("value"))
                ),
            ),
        )
        .otherwise(F.get("parts", 0)["value"])
        .alias("value"),
        "dropped",
    )


def srcset_value(parts: Column, layout: Layout) -> Column:
    """A ``srcset`` again. A flat copy leaves failed candidates out, a tree keeps them as they are."""
    kept = F.filter(parts, lambda p: p["ok"]) if layout.name == "flat" else parts
    written = F.transform(
        kept,
        lambda p: F.rtrim(F.concat(F.coalesce(p["value"], p["raw_ref"]), F.lit(" "), p["descriptor"])),
    )
    return F.array_join(written, ", ")


def link_edits(links: DataFrame, saved: DataFrame, layout: Layout) -> DataFrame:
    """Edits that point links at saved pages.

    ``links`` comes from ``site_links``; ``saved(site, url[, path])`` lists the pages of the copy by their
    normal URL, and where they are saved if not where the layout puts them. Links to other pages of the
    site become absolute. Fragments are kept.
    """
    place = F.col("path") if "path" in saved.columns else page_path(F.col("url"), layout)
    target = saved.select(
        "site", F.col("url").alias("dst"), F.lit(True).alias("is_saved"), place.alias("_place")
    )
    found = lookup(links.filter("crawlable"), target, ["site", "dst"])
    fragment = F.regexp_extract("abs_url", r"#[\s\S]*$", 0)
    local = paths.relative_path(F.col("_place"), page_folder(F.col("page_norm"), layout))
    value = F.when(F.col("is_saved"), F.concat(local, fragment)).otherwise(F.col("abs_url"))
    # Made once: the filter would have the paths computed again.
    return (
        urls.once(found.select(*PAGE_KEY, "pos", "href", "page_norm", "abs_url", "is_saved", "_place"), value=value)
        .filter(F.col("value") != F.col("href"))
        .select(
            *PAGE_KEY, "pos", F.lit("href").alias("name"), "value", F.lit(False).alias("dropped")
        )
    )


def apply_edits(pages: DataFrame, edits: DataFrame, key: Sequence[str] = PAGE_KEY) -> DataFrame:
    """Pages with the edits applied. Pages without edits pass unchanged, byte for byte."""
    key = list(key)
    by_element = edits.groupBy(*key, "pos").agg(
        F.array_sort(
            F.collect_list(F.when(~F.col("dropped"), F.struct("name", "value")))
        ).alias("attrs"),
        F.max("dropped").alias("dropped"),
    )
    by_page = by_element.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "attrs", "dropped"))).alias("_edits")
    )

    def changed(token: Column, edit: Column) -> Column:
        return F.when(edit["dropped"], F.lit("")).otherwise(set_attributes(token, edit["attrs"]))

    html = F.when(F.col("_edits").isNull(), F.col("html")).otherwise(
        splice(tokens(F.col("html")), F.col("_edits"), changed)
    )
    return (
        pages.join(by_page, key, "left")
        .withColumn("html", html)
        .select(*pages.columns)
    )


def rewrite_css(sheets: DataFrame, matched: DataFrame) -> DataFrame:
    """Style sheets ``(site, url, local_path, content)`` with local addresses.

    ``matched(site, sheet_url, css_pos, ok, local_path)`` are the references inside them. Addresses
    are relative to the sheet's folder; failed references stay as they are.
    """
    holder = sheets.select("site", F.col("url").alias("sheet_url"), F.col("local_path").alias("_sheet"))
    edits = (
        matched.filter("ok")
        .join(holder, ["site", "sheet_url"])
        .select(
            "site",
            F.col("sheet_url").alias("url"),
            F.col("css_pos").alias("pos"),
            paths.relative_path(F.col("local_path"), paths.folder_of(F.col("_sheet"))).alias("value"),
        )
        .groupBy("site", "url")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_edits"))
    )
    content = F.when(F.col("_edits").isNull(), F.col("content")).otherwise(
        splice_css(F.col("content"), F.col("_edits"))
    )
    return sheets.join(edits, ["site", "url"], "left").withColumn("content", content).drop("_edits")
