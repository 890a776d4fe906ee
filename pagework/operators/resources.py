"""The catalogue of assets of a site: one row per URL, with its outcome and its local path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagework.functions import paths, urls
from pagework.functions.css import css_urls, is_kept
from pagework.functions.paths import Layout
from pagework.operators.joins import lookup, salted_join
from pagework.operators.ordering import page_slice, running_total
from pagework.sources.scan import decode_text
from pagework.sources.scratch import Scratch

FIRST = ["page_order", "rank", "pos", "cand_pos", "sub_pos"]


def first_order(url: str) -> list[str]:
    """The order of first sight; assets first seen at one place follow by their URL, the column ``url``."""
    return [*(f"first.{c}" for c in FIRST), url, "first.kind"]


def best_status(assets: DataFrame) -> DataFrame:
    """``(url, status)``, each URL once: of several fetches the least status, one without status last."""
    return assets.groupBy("url").agg(F.min("status").alias("status"))


def text_assets(assets: DataFrame) -> DataFrame:
    """Assets with their bodies as text, if they are bytes. Only bodies of sheets and scripts are then read."""
    if isinstance(assets.schema["content"].dataType, BinaryType):
        return assets.withColumn("content", decode_text(F.col("content")))
    return assets


def body_of(assets: DataFrame, urls_: DataFrame) -> DataFrame:
    """``(url, content)`` of the fetched URLs in ``urls_(url)``, each once. Only URLs that were fetched
    more than once are compared by their bodies."""
    wanted = assets.filter(is_fetched(F.col("status"))).join(urls_.distinct(), "url", "left_semi")
    many = wanted.groupBy("url").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("url")
    single = wanted.join(many, "url", "left_anti").select("url", "content")
    best = wanted.join(many, "url", "left_semi").groupBy("url").agg(
        F.min(F.struct("status", "content")).alias("_b")
    )
    return single.unionByName(best.select("url", "_b.content"))


def first_seen(refs: DataFrame) -> DataFrame:
    """Distinct assets per site with the place, and the kind, of their first reference."""
    sub_pos = F.col("sub_pos") if "sub_pos" in refs.columns else F.lit(0).cast("long").alias("sub_pos")
    return (
        refs.select("site", "abs_url", *FIRST[:-1], sub_pos, "kind")
        .groupBy("site", "abs_url")
        .agg(F.min(F.struct(*FIRST, "kind")).alias("first"), F.count(F.lit(1)).alias("n_refs"))
    )


def is_fetched(status: Column) -> Column:
    """A fetch has succeeded if there is a status below 400."""
    return F.coalesce(status < 400, F.lit(False))


def css_refs(sheets: DataFrame) -> DataFrame:
    """References inside style sheets ``(url, content)``, fonts and embedded data left out."""
    return (
        sheets.select(F.col("url").alias("sheet_url"), F.inline_outer(css_urls(F.col("content"))))
        .filter(F.col("ref").isNotNull() & ~is_kept(F.col("ref")))
        .select(
            "sheet_url",
            F.col("pos").alias("css_pos"),
            F.col("ref").alias("raw_ref"),
            urls.resolve(F.col("sheet_url"), F.col("ref")).alias("abs_url"),
        )
    )


def sheet_bodies(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """Fetched bodies of the style sheets in ``sheets(abs_url)``, each URL once."""
    return body_of(assets, sheets.select(F.col("abs_url").alias("url")))


def css_child_refs(sheets: DataFrame, inner: DataFrame) -> DataFrame:
    """References of ``inner`` (see ``css_refs``) at the place of the sheet that holds them.

    ``sheets(site, abs_url, first)``: where each site sees each style sheet first.
    """
    placed = sheets.select("site", F.col("abs_url").alias("sheet_url"), "first")
    return salted_join(placed, inner, ["sheet_url"]).select(
        "site",
        "abs_url",
        "sheet_url",
        "css_pos",
        "raw_ref",
        F.lit("other").alias("kind"),
        *[F.col(f"first.{c}").alias(c) for c in FIRST[:-1]],
        (F.col("css_pos") + 1).alias("sub_pos"),
    )


def name_resources(firsts: DataFrame, assets: DataFrame, layout: Layout, scratch: Scratch) -> DataFrame:
    """Outcome and local path of each asset.

    Images keep their clean name and get ``_1``, ``_2`` ... in the order of first sight when several
    of a site share it; a number that would meet a name already in use gives way to the URL's hash.
    All other names end in the hash. ``local_path`` is NULL where a failed asset gets no name.
    """
    status = best_status(assets).withColumnRenamed("url", "abs_url")
    found = lookup(firsts, status, ["abs_url"]).withColumn("ok", is_fetched(F.col("status")))

    kind, url = F.col("first.kind"), F.col("abs_url")
    named = (
        found.withColumn("_name", paths.asset_name(url, layout))
        .withColumn("_suffix", paths.asset_suffix(F.col("_name"), kind, layout))
        .withColumn("_low", F.lower("_suffix"))
        .withColumn("folder", paths.folder_of_suffix(F.col("_low"), kind, layout))
        .withColumn(
            "_plain",
            F.when(
                F.col("folder") == f"{layout.prefix}images", paths.clean_name(F.col("_name"))
            ).otherwise(paths.hashed_name(F.col("_name"), F.col("_suffix"), url)),
        )
        .drop("_name", "_suffix", "_low")
    )
    if not layout.keep_failed_names:
        no_name = F.lit(None).cast("string")
        named = named.withColumn("folder", F.when(F.col("ok"), F.col("folder")).otherwise(no_name))
        named = named.withColumn("_plain", F.when(F.col("ok"), F.col("_plain")).otherwise(no_name))
    named = scratch.keep(named, "named")
    wanted = named if layout.keep_failed_names else named.filter("ok")
    numbered = running_total(
        wanted,
        ["site", "folder", "_plain"],
        page_slice(F.col("first.page_order")),
        first_order("abs_url"),
        F.lit(1),
        "_number",
    )
    # Written once: the names are moved to be numbered, and not again to be compared or given out.
    numbered = scratch.keep(numbered, "numbered")
    stem, suffix = paths.stem_of(F.col("_plain")), paths.suffix_of(F.col("_plain"))
    candidate = F.when(F.col("_number") == 0, F.col("_plain")).otherwise(
        F.concat(stem, F.lit("_"), F.col("_number").cast("string"), suffix)
    )
    given = numbered.withColumn("_candidate", candidate)
    final = F.when(
        (F.col("_number") > 0) & F.col("_used"), paths.hashed_name(F.col("_plain"), suffix, url)
    ).otherwise(F.col("_candidate"))
    placed = given.join(names_in_use(given, scratch), ["site", "folder", "_candidate"], "left").withColumn(
        "local_path", F.concat(F.col("folder"), F.lit("/"), final)
    )
    columns = ["site", F.col("abs_url").alias("url"), F.col("first.kind").alias("kind"), "folder"]
    columns += ["local_path", "ok", "status", "n_refs", "first"]
    result = placed.select(*columns)
    if layout.keep_failed_names:
        return result
    failed = named.filter(~F.col("ok")).withColumn("local_path", F.lit(None).cast("string"))
    return result.unionByName(failed.select(*columns))


def names_in_use(given: DataFrame, scratch: Scratch) -> DataFrame:
    """``(site, folder, _candidate, _used)``: the numbered names that are also the plain name of an asset, each once.

    ``given(site, folder, _plain, _number, _candidate)``. Names are compared by a hash first, and only those that agree
    are moved as text. Both tables are written, so that their size is known: small ones need not move the rest.
    """
    key = ["site", "folder", "_candidate"]
    mark = F.xxhash64(*key).alias("_mark")
    numbered = given.filter("_number > 0").select(*key, mark)
    plain = given.filter("_number = 0").select(*key, mark)
    both = numbered.select("_mark").distinct().join(plain.select("_mark"), "_mark", "left_semi")
    both = scratch.keep(both, "same_marks")
    in_use = numbered.join(both, "_mark", "left_semi").select(*key).distinct()
    in_use = in_use.join(plain.join(both, "_mark", "left_semi").select(*key), key, "left_semi")
    return scratch.keep(in_use.withColumn("_used", F.lit(True)), "in_use")


def attach_resources(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """References with ``ok`` and ``local_path`` of what they refer to."""
    target = resources.select("site", F.col("url").alias("abs_url"), "ok", "local_path")
    return lookup(refs, target, ["site", "abs_url"])
