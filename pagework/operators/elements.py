"""Elements and the references in them, from a table of pages.

All columns of the page except its text are carried along, so the operators work on any table that
has an ``html`` column and a key of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import urls
from pagework.functions.css import css_urls, is_embedded, is_kept
from pagework.functions.markup import (
    attribute_of,
    attribute_pattern,
    attributes,
    decode_references,
    marked_tokens,
    opening_tag,
    tag_name,
    value_of_written,
    written_attribute,
    written_text,
    written_value,
)

# Where images are referenced, in the order in which they are looked at.
IMAGE_SLOTS = [
    ("img", "src"),
    ("amp-img", "src"),
    ("amp-anim", "src"),
    ("source", "src"),
    ("source", "srcset"),
    ("img", "data-src"),
    ("img", "data-lazy-src"),
    ("img", "srcset"),
]
BASIC_IMAGE_SLOTS = [("img", "src"), ("img", "srcset")]
ICON_RELS = ["icon", "shortcut icon"]
SAVED_ICON_RELS = ["icon", "shortcut icon", "apple-touch-icon"]

STYLESHEET_RANK = 0
SCRIPT_RANK = 1
FIRST_IMAGE_RANK = 2
ICON_RANK = FIRST_IMAGE_RANK + len(IMAGE_SLOTS)
INLINE_STYLE_RANK = ICON_RANK + 1


def _tagged(pages: DataFrame, tags: Sequence[str] | None) -> DataFrame:
    """One row per wanted opening tag: the page's columns, ``pos`` and ``raw``.

    The outer form of the generator keeps the optimizer from testing the array for emptiness first,
    which would cut every page into tokens twice.
    """
    kept = [c for c in pages.columns if c != "html"]
    return (
        pages.select(*kept, F.posexplode_outer(marked_tokens(F.col("html"), tags)).alias("pos", "_token"))
        .filter(F.col("_token") != "")
        .select(*kept, F.col("pos").cast("long").alias("pos"), opening_tag(F.col("_token")).alias("raw"))
    )


def elements(pages: DataFrame, tags: Sequence[str] | None = None) -> DataFrame:
    """Opening tags in document order: ``pos``, ``tag``, ``attrs``, ``raw``."""
    return _tagged(pages, tags).select(
        *[c for c in pages.columns if c != "html"],
        "pos",
        tag_name(F.col("raw")).alias("tag"),
        attributes(F.col("raw")).alias("attrs"),
        "raw",
    )


def anchors(pages: DataFrame) -> DataFrame:
    """``a`` elements with an ``href``, which may be empty."""
    piece = F.regexp_extract(F.col("raw"), attribute_pattern("href"), 1)
    tagged = urls.once(_tagged(pages, ["a"]), _piece=piece).filter(F.col("_piece") != "").drop("raw")
    # A column for each step, so that only values with character references come to a lambda.
    written = tagged.withColumn("_written", value_of_written(F.col("_piece"), F.lit("href"))).drop("_piece")
    return urls.once(written, href=decode_references(F.col("_written"))).drop("_written")


def rel_tokens(rel: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(rel, F.lit("")), r"^\s+|\s+$", ""), r"\s+")


def is_stylesheet(tag: Column, rel: Column) -> Column:
    return (tag == "link") & F.array_contains(rel_tokens(rel), "stylesheet")


def is_icon(tag: Column, rel: Column, rels: Sequence[str] = ICON_RELS) -> Column:
    tokens = rel_tokens(rel)
    named = F.array_join(tokens, " ").isin(list(rels))
    return (tag == "link") & (F.arrays_overlap(tokens, F.array(*map(F.lit, rels))) | named)


def srcset_candidates(value: Column) -> Column:
    """ARRAY<STRUCT<cand_pos, ref, descriptor>> of a ``srcset`` value."""
    trimmed = F.transform(F.split(value, ",", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))

    def candidate(part: Column, i: Column) -> Column:
        descriptor = F.when(part.contains(" "), F.substring_index(part, " ", -1)).otherwise(F.lit(""))
        url = F.when(
            part.contains(" "),
            F.substring(part, F.lit(1), F.length(part) - F.length(descriptor) - 1),
        ).otherwise(part)
        return F.struct(
            i.cast("long").alias("cand_pos"), url.alias("ref"), descriptor.alias("descriptor")
        )

    return F.transform(F.filter(trimmed, lambda p: p != ""), candidate)


def _style_candidates(value: Column) -> Column:
    wanted = F.filter(css_urls(value), lambda u: ~is_kept(u["ref"]))
    return F.transform(
        wanted,
        lambda u: F.struct(
            u["pos"].alias("cand_pos"), u["ref"].alias("ref"), F.lit("").alias("descriptor")
        ),
    )


def _single_candidate(value: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(0).cast("long").alias("cand_pos"), value.alias("ref"), F.lit("").alias("descriptor")
        )
    )


def page_refs(
    pages: DataFrame, profile: str = "full", saved: bool = False, bases: DataFrame | None = None
) -> DataFrame:
    """Every reference of a page to an asset, one row per candidate URL.

    ``profile='full'`` reads all image slots and inline styles, ``'basic'`` only ``img`` and no
    styles. ``saved=True`` is for pages read from disk: the column ``base`` may be NULL, and relative
    references of such a page are left out. Their bases may also come as a table ``bases(site, url,
    base)``, which joins the references and not the page text. For fetched pages ``base``, if there
    is one, goes before ``url``.

    Adds ``pos, slot, kind, rank, cand_pos, raw_ref, descriptor, holder, abs_url``. ``rank`` is the
    order in which the kinds of references are looked at; ``holder`` is the text of an inline style.
    """
    carried = [c for c in pages.columns if c != "html"]
    image_slots = IMAGE_SLOTS if profile == "full" else BASIC_IMAGE_SLOTS
    icon_rels = SAVED_ICON_RELS if saved else ICON_RELS
    base = F.col("url")
    if "base" in pages.columns:
        base = F.col("base") if saved else F.coalesce(F.col("base"), F.col("url"))
    if not saved:
        pages = pages.withColumn("_base", base).withColumn("_origin", urls.web_origin(base))
    elif bases is None:
        pages = pages.withColumn("_base", base)

    named = ["link", "script", *dict.fromkeys(tag for tag, _ in image_slots)]
    tag, raw = F.col("tag"), F.col("raw")
    tagged = _tagged(pages, None if profile == "full" else named).withColumn("tag", tag_name(raw))
    # What a link is for is asked by several slots. The usual relations, and those that name none of them, are told
    # apart before the lambdas.
    rel = F.col("_rel")
    parsed = urls.let(
        urls.let(rel, decode_references),
        lambda r: F.when(is_stylesheet(tag, r), F.lit("css")).when(is_icon(tag, r, icon_rels), F.lit("icon")),
    )
    other = ~reduce(or_, (rel.contains(part) for part in ("&", "stylesheet", *icon_rels)))
    use = (
        F.when(rel == "stylesheet", F.lit("css"))
        .when(rel.isin(icon_rels), F.lit("icon"))
        .when(other, F.lit(None).cast("string"))
        .otherwise(parsed)
    )
    found = tagged.withColumn("_rel", F.when(tag == "link", written_text(raw, "rel")))
    found = found.withColumn("_use", F.when(tag == "link", use))

    # The slots by attribute: those of one attribute exclude each other, so a tag has at most one of them. The array
    # is not filtered by a lambda, which would have all slots interpreted.
    by_name: dict[str, list[tuple[Column, str, int]]] = {
        "href": [(F.col("_use") == "css", "css", STYLESHEET_RANK), (F.col("_use") == "icon", "icon", ICON_RANK)],
        "src": [(tag == "script", "js", SCRIPT_RANK)],
    }
    for t, name in image_slots:
        by_name.setdefault(name, []).append((tag == t, "image", FIRST_IMAGE_RANK + IMAGE_SLOTS.index((t, name))))
    if profile == "full":
        by_name["style"] = [(F.lower(raw).contains("style"), "style", INLINE_STYLE_RANK)]

    def slot(name: str, uses: list[tuple[Column, str, int]]) -> Column:
        kind, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
        for when, k, r in reversed(uses):
            kind, rank = F.when(when, F.lit(k)).otherwise(kind), F.when(when, F.lit(r)).otherwise(rank)
        written = F.when(reduce(or_, (when for when, _, _ in uses)), written_attribute(raw, name))
        return F.struct(F.lit(name).alias("slot"), kind.alias("kind"), rank.alias("rank"), written.alias("piece"))

    kept = [c for c in pages.columns if c != "html"] + ["pos"]
    # Tags without slots get no array, not a filter, which would have the name of every tag made once more.
    slots = F.array(*(slot(name, uses) for name, uses in by_name.items()))
    if profile == "full":
        slots = F.when(tag.isin(named) | F.lower(raw).contains("style"), slots)
    slotted = found.select(*kept, slots.alias("_slots")).select(*kept, F.explode_outer("_slots").alias("s"))
    slotted = slotted.filter(F.col("s.piece") != "").select(*kept, "s.slot", "s.kind", "s.rank", F.col("s.piece").alias("_piece"))
    slotted = slotted.withColumn("_written", value_of_written(F.col("_piece"), F.col("slot"))).drop("_piece")
    # A value is decoded once, because several columns need it.
    slotted = slotted.withColumn("value", decode_references(F.col("_written"))).drop("_written")
    value = F.col("value")
    candidates = (
        F.when(value == "", F.lit(None))
        .when(F.col("slot") == "srcset", srcset_candidates(value))
        .when(F.col("slot") == "style", _style_candidates(value))
        .otherwise(_single_candidate(value))
    )
    kept += ["slot", "kind", "rank", F.when(F.col("slot") == "style", value).alias("holder")]
    parts = slotted.select(*kept, candidates.alias("_candidates"))
    kept = [c for c in parts.columns if c != "_candidates"]
    parts = parts.select(*kept, F.inline_outer("_candidates")).filter(F.col("ref").isNotNull() & ~is_embedded(F.col("ref")))
    if bases is not None:
        parts = parts.join(bases.withColumnRenamed("base", "_base"), ["site", "url"], "left")
    if saved:
        parts = parts.filter(urls.is_resolvable(F.col("ref"), F.col("_base")))
        target = urls.resolve_saved(F.col("_base"), F.col("ref"))
    else:
        target = urls.resolve_from(F.col("_base"), F.col("_origin"), F.col("ref"))
    return parts.select(
        *carried,
        "pos",
        "slot",
        "kind",
        "rank",
        "cand_pos",
        F.col("ref").alias("raw_ref"),
        "descriptor",
        "holder",
        target.alias("abs_url"),
    )


def detect_base(pages: DataFrame, key: Sequence[str]) -> DataFrame:
    """Base URL per page: ``<base href>`` as written, else the origin of the first absolute
    ``link``, ``script`` or ``img``/``amp-img`` reference, in this order of kinds; else no row."""
    found = _tagged(pages.select(*key, "html"), ["base", "link", "script", "img", "amp-img"])
    found = urls.once(found, tag=tag_name(F.col("raw")))
    rank = (
        F.when(F.col("tag") == "base", 0)
        .when(F.col("tag") == "link", 1)
        .when(F.col("tag") == "script", 2)
        .otherwise(3)
    )
    href, src = written_value(F.col("raw"), "href"), written_value(F.col("raw"), "src")
    value = urls.let(F.when(F.col("tag").isin("base", "link"), href).otherwise(src), decode_references)
    absolute = F.col("value").startswith("http://") | F.col("value").startswith("https://")
    return (
        urls.once(found, value=value)
        .select(*key, "pos", rank.alias("rank"), "value")
        .filter(F.col("value").isNotNull() & ((F.col("rank") == 0) | absolute))
        .groupBy(*key)
        .agg(F.min(F.struct("rank", "pos", "value")).alias("first"))
        .select(
            *key,
            F.when(F.col("first.rank") == 0, F.col("first.value"))
            .otherwise(urls.origin_of(F.col("first.value")))
            .alias("base"),
        )
    )


def language_selectors(pages: DataFrame) -> DataFrame:
    """``li`` elements of class ``language_selector`` with their ``data-language``."""
    raw = F.col("raw")
    selector = F.array_contains(rel_tokens(attribute_of(raw, "class")), "language_selector")
    found = urls.once(_tagged(pages, ["li"]), data_language=F.when(selector, attribute_of(raw, "data-language")))
    return found.filter(F.col("data_language").isNotNull()).drop("raw")
