"""File names and paths inside a saved site. Paths are relative to the site root, with ``/``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagework.functions.urls import NO_BLANK, let, short_hash, split_url

# Suffixes that decide the folder of an asset.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico"]
FONT_SUFFIXES = [".woff", ".woff2", ".ttf", ".eot", ".otf"]


@dataclass(frozen=True)
class Layout:
    """Where the files of a saved site go.

    ``flat`` is used for single pages and page lists, ``tree`` for a crawled site.
    """

    name: str
    prefix: str
    default_name: str
    default_suffix: str
    safe_names: bool
    keep_failed_names: bool

    @property
    def css_bundle(self) -> str:
        return f"{self.prefix}css/all-styles.css"

    @property
    def js_bundle(self) -> str:
        return f"{self.prefix}js/all-scripts.js"


FLAT = Layout("flat", "", "index.html", ".html", safe_names=False, keep_failed_names=True)
TREE = Layout("tree", "assets/", "resource", "", safe_names=True, keep_failed_names=False)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    """Folder part of a path, empty at the root."""
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return F.when(path.contains("/"), folder).when(path.isNotNull(), F.lit(""))


def _before_suffix(name: Column) -> Column:
    """What stands before the last dot; cut off without a pattern, which takes many times as long."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)


def has_suffix(name: Column) -> Column:
    """Is there a last dot, and before it more than dots?"""
    return name.contains(".") & (F.ltrim(_before_suffix(name), F.lit(".")) != "")


def stem_of(name: Column) -> Column:
    return F.when(has_suffix(name), _before_suffix(name)).otherwise(name)


def suffix_of(name: Column) -> Column:
    last = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    return F.when(has_suffix(name), last).when(name.isNotNull(), F.lit(""))


def without_parameters(path: Column) -> Column:
    """URL path without the ``;parameters`` of its last segment."""
    return F.when(path.contains(";"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


# The path of a web address that needs no parsing: no blanks, control characters or parameters in it.
WEB_PATH = rf"^https?://[^/?#{NO_BLANK}]+(/[^?#;{NO_BLANK}]*)(?=\?|#|\z)[^{NO_BLANK}]*\z"


def url_path(url: Column) -> Column:
    """Path of a URL without parameters. Web addresses are decided before any lambda."""
    web = F.regexp_extract(url, WEB_PATH, 1)
    parsed = let(let(split_url(url), lambda p: p["path"]), without_parameters)
    return F.when(web != "", web).otherwise(parsed)


# The version hash at the end of a name, and the characters that names may not hold.
VERSION_HASH = r"[_-][a-f0-9]{6,}$"
UNSAFE_IN_NAMES = r'[<>:"|?*]'
UNSAFE_IN_FLAT_NAMES = r"[^a-zA-Z0-9_-]"


def clean_name(name: Column) -> Column:
    """Take one version hash off the end of the stem: ``seal_0badcafe.png`` is ``seal.png``."""
    return F.concat(F.regexp_replace(stem_of(name), VERSION_HASH, ""), suffix_of(name))


def asset_name(url: Column, layout: Layout) -> Column:
    name = base_name(url_path(url))
    name = F.when(name == "", F.lit(layout.default_name)).otherwise(name)
    return F.regexp_replace(name, UNSAFE_IN_NAMES, "_") if layout.safe_names else name


def asset_suffix(name: Column, kind: Column, layout: Layout) -> Column:
    """Suffix of the name, or one that fits the declared kind if it has none."""
    given = suffix_of(name)
    declared = (
        F.when(kind == "css", F.lit(".css"))
        .when(kind == "js", F.lit(".js"))
        .otherwise(F.lit(layout.default_suffix))
    )
    return F.when(given != "", given).otherwise(declared)


def asset_folder(suffix: Column, kind: Column, layout: Layout) -> Column:
    """Folder of an asset. The declared kind beats the suffix for css and js only."""

    return let(F.lower(suffix), lambda low: folder_of_suffix(low, kind, layout))


def folder_of_suffix(low: Column, kind: Column, layout: Layout) -> Column:
    """The same for a suffix in lower case that is a column, so that it needs no lambda."""
    name = (
        F.when((kind == "css") | (low == ".css"), F.lit("css"))
        .when((kind == "js") | (low == ".js"), F.lit("js"))
        .when(low.isin(IMAGE_SUFFIXES), F.lit("images"))
        .when(low.isin(FONT_SUFFIXES), F.lit("fonts"))
        .otherwise(F.lit("other"))
    )
    return F.concat(F.lit(layout.prefix), name)


def hashed_name(name: Column, suffix: Column, url: Column) -> Column:
    return F.concat(stem_of(name), F.lit("_"), short_hash(url), suffix)


# Web addresses whose path is taken as it is: whole segments and nothing behind them. The last segment has no dot, or
# it ends in the suffix of a page. The segments before it are possessive, so they are matched in a loop.
_PLAIN = rf"^https?://[^/?#{NO_BLANK}]+/((?:[^/?#;{NO_BLANK}]++/)*+"
PLAIN_FOLDER = rf"{_PLAIN}[^/?#;.{NO_BLANK}]+)\z"
PLAIN_FILE = rf"{_PLAIN}[^/?#;.{NO_BLANK}][^/?#;{NO_BLANK}]*\.html?)\z"


def page_path_tree(url: Column) -> Column:
    """Path of a page that keeps the shape of the site. Plain web addresses are decided before any lambda."""

    def place(p: Column) -> Column:
        return (
            F.when(p == "", F.lit("index.html"))
            .when(suffix_of(base_name(p)) == "", F.concat(p, F.lit("/index.html")))
            .when(p.endswith(".html") | p.endswith(".htm"), p)
            .otherwise(F.concat(p, F.lit(".html")))
        )

    def with_query(p: Column) -> Column:
        name = base_name(p)
        folder = F.substring(p, F.lit(1), F.length(p) - F.length(name))
        return F.concat(folder, hashed_name(name, F.lit(".html"), url))

    def of_parts(parts: Column) -> Column:
        path = F.regexp_replace(F.trim(without_parameters(parts["path"]), F.lit("/")), "/{2,}", "/")
        return let(
            let(path, place), lambda p: F.when(parts["query"] != "", with_query(p)).otherwise(p)
        )

    return (
        F.when(url.rlike(PLAIN_FOLDER), F.concat(F.regexp_extract(url, PLAIN_FOLDER, 1), F.lit("/index.html")))
        .when(url.rlike(PLAIN_FILE), F.regexp_extract(url, PLAIN_FILE, 1))
        .otherwise(let(split_url(url), of_parts))
    )


def page_path_flat(url: Column) -> Column:
    """File name of a page in a flat copy: the last word of its path."""

    def place(path: Column) -> Column:
        stem = stem_of(base_name(path))
        return F.when(path == "", F.lit("index.html")).otherwise(
            F.concat(F.regexp_replace(stem, UNSAFE_IN_FLAT_NAMES, "-"), F.lit(".html"))
        )

    return let(F.trim(url_path(url), F.lit("/")), place)


def relative_path(target: Column, folder: Column) -> Column:
    """How a file in ``folder`` refers to ``target``. Both are plain paths from the root."""

    def climb(there: Column, here: Column) -> Column:
        same = F.zip_with(here, there, lambda x, y: x.eqNullSafe(y))
        shared = F.coalesce(
            F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)
        ).cast("int")
        ups = F.array_repeat(F.lit(".."), F.size(here) - shared)
        rest = F.slice(there, shared + 1, F.size(there) - shared)
        return F.array_join(F.concat(ups, rest), "/")

    def between(p: Column) -> Column:
        there, here = F.split(p["target"], "/", -1), F.split(p["folder"], "/", -1)
        deep = let(there, lambda t: let(here, lambda h: climb(t, h)))
        return (
            F.when(p["folder"] == "", p["target"])
            .when(p["folder"] == p["target"], F.lit("."))
            .otherwise(deep)
        )

    # Files in the root, all of a flat copy, are told apart before any lambda.
    lower = let(F.struct(target.alias("target"), folder.alias("folder")), between)
    return F.when(folder == "", target).otherwise(lower)


def language_file(lang: Column) -> Column:
    return F.concat(F.lit("index-"), lang, F.lit(".html"))
