"""Finding and repairing broken links in a saved site. Tables are keyed by ``(site, path)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import paths
from pagework.functions.urls import DOT_SEGMENT, let
from pagework.operators.elements import anchors
from pagework.operators.joins import lookup
from pagework.operators.rewrite import apply_edits

FILE_KEY = ["site", "path"]

# How links start that work without a local file.
WORKING_PREFIXES = ["http://", "https://", "mailto:", "tel:", "#"]
SCRIPT_PREFIX = "javascript:"


def site_entries(files: DataFrame) -> DataFrame:
    """Everything that exists in a saved site: its files and their folders, the root being ''."""
    parts = F.split("path", "/", -1)
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    folders = files.select("site", F.explode(above).alias("entry"), F.lit(True).alias("is_folder"))
    plain = files.select("site", F.col("path").alias("entry"), F.lit(False).alias("is_folder"))
    return folders.unionByName(plain).distinct()


def _fold(path: Column) -> Column:
    """Path without dot segments; NULL if it climbs above the root."""

    def climb(done: Column, seg: Column) -> Column:
        at_root = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1)) == "..")
        return (
            F.when((seg == "") | (seg == "."), done)
            .when((seg == "..") & ~at_root, F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.concat(done, F.array(seg)))
        )

    folded = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), climb)
    deep = let(folded, lambda f: F.when(~F.array_contains(f, ".."), F.array_join(f, "/")))
    flat = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")
    return F.when(path.rlike(DOT_SEGMENT), deep).otherwise(flat)


def _candidates(href: Column, folder: Column | None) -> Column:
    """ARRAY<STRUCT<entry, folder_only>>: what may stand behind a link."""
    rooted = href.startswith("/") | href.startswith("./") | href.startswith("../")
    if folder is None:
        start = F.regexp_replace(href, "^/+", "")
    else:
        inside = F.when(folder == "", href).otherwise(F.concat(folder, F.lit("/"), href))
        plain = F.regexp_replace(href, r"[?#][\s\S]*$", "")
        start = F.when(href.startswith("/"), F.regexp_replace(plain, "^/+", "")).otherwise(
            F.regexp_replace(inside, r"[?#][\s\S]*$", "")
        )

    def candidate(path: Column) -> Column:
        return F.struct(
            _fold(path).alias("entry"), path.rlike(r"(?:^|/)\.{0,2}$").alias("folder_only")
        )

    def all_of(p: Column) -> Column:
        two = F.array(candidate(p), candidate(F.concat(p, F.lit(".html"))))
        index = F.array(candidate(F.concat(F.when(p == "", p).otherwise(F.concat(p, F.lit("/"))), F.lit("index.html"))))
        return F.when(rooted, F.concat(two, index)).otherwise(two)

    return let(start, all_of)


def broken_links(links: DataFrame, files: DataFrame, resolve: str = "root") -> DataFrame:
    """The links ``(site, path, pos, href)`` that lead nowhere in the saved site.

    Each distinct link of a site is tested once: its candidates are rows, and one equi-join to the
    stored entries decides. ``resolve='root'`` takes every path from the site root with its query and
    fragment, ``'page'`` from the page's folder without them.
    """
    href = F.col("href")
    working = F.lit(False)
    for prefix in WORKING_PREFIXES:
        working = working | href.startswith(prefix)
    tested = links.filter((href != "") & ~working)
    scripts = tested.filter(href.startswith(SCRIPT_PREFIX))
    local = tested.filter(~href.startswith(SCRIPT_PREFIX))
    key = ["site", "href"]
    folder = None
    if resolve == "page":
        local = local.withColumn("folder", paths.folder_of(F.col("path")))
        key, folder = ["site", "folder", "href"], F.col("folder")
    asked = local.select(*key).distinct()
    options = asked.select(*key, F.inline(_candidates(href, folder)))
    entries = site_entries(files)
    hit = (
        options.join(entries, ["site", "entry"])
        .filter(F.col("is_folder") | ~F.col("folder_only"))
        .select(*key)
        .distinct()
    )
    dead = asked.join(hit, key, "left_anti").withColumn("_dead", F.lit(True))
    broken = lookup(local, dead, key).filter("_dead")
    return broken.select(*links.columns).unionByName(scripts.select(*links.columns))


def plan_fixes(
    broken: DataFrame, replacement_url: str | None = None, local_fallback: str | None = None
) -> DataFrame:
    """One row per repaired link: ``(site, path, pos, original, replaced)``. A local fallback page
    wins over the URL and is written relative to the page."""
    if local_fallback is not None:
        replaced = paths.relative_path(F.lit(local_fallback), paths.folder_of(F.col("path")))
    else:
        replaced = F.lit(replacement_url)
    return broken.select(*FILE_KEY, "pos", F.col("href").alias("original"), replaced.alias("replaced"))


def file_links(files: DataFrame) -> DataFrame:
    return anchors(files.select(*FILE_KEY, "html"))


def fix_links(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files with the fixes applied; files without a fix stay as they are."""
    edits = fixes.select(
        *FILE_KEY,
        "pos",
        F.lit("href").alias("name"),
        F.col("replaced").alias("value"),
        F.lit(False).alias("dropped"),
    )
    return apply_edits(files, edits, FILE_KEY)


def fix_report(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per site: files processed, files changed, links fixed."""
    per_file = fixes.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = (
        files.select("site", F.lit(1).alias("file"), F.lit(0).alias("changed"), F.lit(0).cast("long").alias("n"))
        .unionByName(per_file.select("site", F.lit(0).alias("file"), F.lit(1).alias("changed"), "n"))
    )
    return rows.groupBy("site").agg(
        F.sum("file").alias("files_processed"),
        F.sum("changed").alias("files_changed"),
        F.sum("n").alias("links_fixed"),
    )


def backups_of(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """The original text of the files that a repair changes."""
    return files.join(fixes.select(*FILE_KEY).distinct(), FILE_KEY, "left_semi")


def restore(files: DataFrame, backups: DataFrame) -> DataFrame:
    """Files with every backup put back, and whether one was: ``(site, path, html, restored)``."""
    old = backups.select(*FILE_KEY, F.col("html").alias("_old"))
    return files.join(old, FILE_KEY, "full").select(
        *FILE_KEY,
        F.coalesce("_old", "html").alias("html"),
        F.col("_old").isNotNull().alias("restored"),
    )
