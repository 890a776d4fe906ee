"""Style-sheet text: finding and replacing the ``url(...)`` references in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagework.functions.markup import splice
from pagework.functions.paths import FONT_SUFFIXES

# Fixed pattern: url(...), quotes optional, no white space or quotes inside.
CSS_URL = r"""url\(['"]?([^'")\s]+)['"]?\)"""

# Tokens that concatenate to the text; group 1 is set for references only.
CSS_TOKEN = r"""(url\(['"]?+[^'")\s]++['"]?+\))|(?:[^u]++|u(?!rl\())++|u"""


def css_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CSS_TOKEN), F.lit(0))


def css_urls(text: Column) -> Column:
    """ARRAY<STRUCT<pos, ref>> of the references; ``pos`` is a position in ``css_tokens``."""
    marked = F.regexp_extract_all(text, F.lit(CSS_TOKEN), F.lit(1))
    numbered = F.transform(
        marked,
        lambda t, i: F.struct(i.cast("long").alias("pos"), F.regexp_extract(t, CSS_URL, 1).alias("ref")),
    )
    found = F.filter(numbered, lambda s: s["ref"] != "")
    empty = F.array().cast("array<struct<pos:bigint,ref:string>>")
    return F.when(text.contains("url("), found).otherwise(empty)


def is_embedded(ref: Column) -> Column:
    return ref.startswith("data:")


def is_font(ref: Column) -> Column:
    """Font files stay where they are; the suffix may stand anywhere in the reference."""
    low = F.lower(ref)
    test = F.lit(False)
    for suffix in FONT_SUFFIXES:
        test = test | low.contains(suffix)
    return test


def is_kept(ref: Column) -> Column:
    """References in style text that are never rewritten."""
    return is_embedded(ref) | is_font(ref)


def splice_css(text: Column, edits: Column) -> Column:
    """``edits``: ARRAY<STRUCT<pos, value>> sorted by ``pos``; value is the new address."""
    return splice(css_tokens(text), edits, lambda token, e: F.concat(F.lit("url("), e["value"], F.lit(")")))
