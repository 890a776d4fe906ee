"""Markup as an array of tokens.

A page is cut into tokens that concatenate to the page, so an edit touches one token and leaves all
other bytes alone. The position of a token in the array is the position of the element.
The patterns use possessive quantifiers: they cannot backtrack, so neither a huge tag nor an unclosed
quote makes the regular expression engine recurse.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagework.functions.urls import let

# What ``\s`` stands for, by its characters: a class of single characters is looked up in a table, one that holds
# ``\s`` or a range asks a chain of predicates for every character.
SPACE = r" \t\n\x0B\f\r"
# A run of one class is greedy where it can give nothing back, because what follows it is not in the class or always
# matches: the engine has a loop of its own for such runs, and possessive ones go character by character.
ATTRIBUTE = (
    rf"""[^{SPACE}/>=]+(?:[{SPACE}]*=[{SPACE}]*(?:"[^"]*"|'[^']*'|[^{SPACE}"'>][^{SPACE}>]*)?+)?+"""
)
INSIDE = rf"(?:[{SPACE}/=]+|{ATTRIBUTE})*+"
TAG = rf"<[a-zA-Z][^{SPACE}/>]*+{INSIDE}>"
COMMENT = r"<!--[\s\S]*?(?:-->|\z)"
CLOSE_OR_DECLARATION = r"</[a-zA-Z][^>]*>|<[!?/][^>]*>"
TEXT = r"[^<]+"

# A written attribute, with its value in one of three groups, whatever the quotes.
PIECE_VALUE = r"""^[^=]*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^"'][\s\S]*+|\z)))?+\z"""

# Pieces of one tag; they concatenate to the tag. The first piece is ``<name``.
TAG_PIECE = rf"{ATTRIBUTE}|[{SPACE}/=>]"


def _named_tag(name: str) -> str:
    return rf"<(?i:{name})(?:[{SPACE}/]{INSIDE})?+>"


def _raw_element(name: str) -> str:
    """An element whose body is not markup, up to its closing tag or the end of the page."""
    return rf"{_named_tag(name)}[\s\S]*?(?:</(?i:{name})(?:[{SPACE}/][^>]*+)?+>|\z)"


def token_pattern(tags: Sequence[str] | None = None) -> str:
    """Token pattern whose group 1 holds the opening tags of ``tags`` (None: of any tag).

    A script element is one token, so that removing or editing it needs no second position.
    """
    raw = _raw_element("style")
    script = _raw_element("script")
    if tags is None:
        return rf"{TEXT}|({script}|{raw}|{TAG})|{COMMENT}|{CLOSE_OR_DECLARATION}|<"
    plain = [t for t in tags if t != "script"]
    wanted = [script] if "script" in tags else []
    if plain:
        wanted.append(_named_tag("(?:" + "|".join(plain) + ")"))
    hidden = raw if "script" in tags else f"{raw}|{script}"
    return rf"{TEXT}|({'|'.join(wanted)})|{hidden}|{TAG}|{COMMENT}|{CLOSE_OR_DECLARATION}|<"


def tokens(html: Column) -> Column:
    """All tokens of a page, in order and without loss."""
    return F.regexp_extract_all(html, F.lit(token_pattern()), F.lit(0))


def marked_tokens(html: Column, tags: Sequence[str] | None = None) -> Column:
    """Array as long as ``tokens``: the token where an opening tag is wanted, else an empty string."""
    return F.regexp_extract_all(html, F.lit(token_pattern(tags)), F.lit(1))


def has_body(token: Column) -> Column:
    """Is the token a whole element rather than one tag?"""
    return F.substring(token, 1, 2).isin("<s", "<S") & token.rlike(rf"^<(?i:script|style)[{SPACE}/>]")


def head_of(token: Column) -> Column:
    """The opening tag at the start of a token."""
    return F.regexp_extract(token, "^" + TAG, 0)


def opening_tag(token: Column) -> Column:
    return F.when(has_body(token), head_of(token)).otherwise(token)


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, rf"^<([a-zA-Z][^{SPACE}/>]*+)", 1))


WHITE_SPACE = " \t\n\r\f\v"
# A character reference: a number of any length, or a name that may be cut short by what follows it.
REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[^\t\n\f <&#;]{1,32}+;?+)"
#: Names that need no semicolon also count at the start of a longer word.
_SHORT_NAMES = {name: text for name, text in html5.items() if not name.endswith(";")}
REPLACEMENT = "\ufffd"


def _table(names: dict[str, str]) -> Column:
    """A map as one literal, which the optimizer makes once for a query."""
    pairs = "\x02".join(f"{name}\x01{text}" for name, text in names.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference. Numbers of the C1 controls mean the characters that Windows has
    there; zero, surrogates and numbers beyond Unicode are replaced; other controls and noncharacters vanish."""
    short = F.ltrim(digits, F.lit("0"))
    most = 7 if base == 10 else 6

    def of(number: Column) -> Column:
        windows = F.array(*(F.lit(_windows_character(n)) for n in range(0x80, 0xA0)))
        noncharacter = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
        control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        return (
            F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit(REPLACEMENT))
            .when(number.between(0x80, 0x9F), F.get(windows, number - 0x80))
            .when(control | noncharacter, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        )

    known = let(F.conv(F.concat(F.lit("0"), short), base, 10).cast("long").cast("int"), of)
    return F.when(F.length(short) > most, F.lit(REPLACEMENT)).otherwise(known)


def _windows_character(number: int) -> str:
    try:
        return bytes([number]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(number)


def _named(name: Column) -> Column:
    """The text of a named reference: the whole name, else the longest start of it that is one, else itself."""
    longest = max(map(len, _SHORT_NAMES))
    starts = [
        F.when(F.length(name) > n, F.concat(F.try_element_at(_table(_SHORT_NAMES), F.left(name, F.lit(n))), F.substr(name, F.lit(n + 1))))
        for n in range(longest, 1, -1)
    ]
    # The usual one is told apart first; the table is searched name by name.
    whole = F.when(name == "amp;", F.lit("&")).otherwise(F.try_element_at(_table(html5), name))
    return F.coalesce(whole, *starts, F.concat(F.lit("&"), name))


def _decode_one(ref: Column) -> Column:
    hexadecimal = F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+)", 1)
    decimal = F.regexp_extract(ref, r"^&#([0-9]+)", 1)
    return (
        F.when(hexadecimal != "", _character(hexadecimal, 16))
        .when(decimal != "", _character(decimal, 10))
        .otherwise(_named(F.substr(ref, F.lit(2))))
    )


def decode_references(text: Column) -> Column:
    """Replace character references by their characters, as a browser reads text."""

    def decode(t: Column) -> Column:
        gaps = F.split(t, REFERENCE, -1)
        refs = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        pairs = F.zip_with(gaps, refs, lambda g, r: F.concat(g, F.coalesce(_decode_one(r), F.lit(""))))
        return F.array_join(pairs, "")

    return F.when(text.contains("&"), decode(text)).otherwise(text)


def encode_value(text: Column) -> Column:
    """Text as the body of a double-quoted attribute value."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def _written_name(piece: Column) -> Column:
    return F.rtrim(F.substring_index(piece, "=", 1), F.lit(WHITE_SPACE))


def _piece_name(piece: Column) -> Column:
    """White space and the end of a tag, which are most pieces, are told apart before anything is cut off."""
    return F.when(piece == " ", F.lit("")).when(piece == ">", piece).otherwise(F.lower(_written_name(piece)))


def _piece_value(piece: Column) -> Column:
    written = F.ltrim(
        F.substring(piece, F.length(F.substring_index(piece, "=", 1)) + 2, F.length(piece)),
        F.lit(WHITE_SPACE),
    )
    bare = let(
        written,
        lambda w: F.when(
            w.startswith('"') | w.startswith("'"), F.substring(w, F.lit(2), F.length(w) - 2)
        ).otherwise(w),
    )
    return let(bare, decode_references)


def attributes(tag: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of an opening tag; an attribute without value has an empty one."""
    pieces = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(_piece_name(p).alias("name"), _piece_value(p).alias("value")),
    )


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute, NULL if absent. Of a repeated attribute the last one counts."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def attribute_pattern(name: str) -> str:
    """Pattern of an opening tag whose group 1 is the last attribute called ``name``, as it is written. One match
    runs over all attributes, so that no lambda goes through them."""
    value = rf"""(?:[{SPACE}]*=[{SPACE}]*(?:"[^"]*"|'[^']*'|[^{SPACE}"'>][^{SPACE}>]*)?+)?+"""
    return rf"^{ATTRIBUTE}(?:((?i:{re.escape(name)})(?![^{SPACE}/>=]){value})|{ATTRIBUTE}|[{SPACE}/=>])*+"


def written_attribute(tag: Column, name: str) -> Column:
    """The last attribute called ``name`` as it is written, empty if absent. A tag without the letters of the name is
    not matched."""
    return F.when(F.lower(tag).contains(name), F.regexp_extract(tag, attribute_pattern(name), 1)).otherwise("")


def value_of_written(piece: Column, name: Column) -> Column:
    """Value of an attribute called ``name`` as it is written, its character references as they are. ``piece`` should
    be a column, as it is read several times. What begins with name, sign and quote also ends in the quote."""
    start = F.length(name) + 2
    quoted = F.substring(piece, start + 1, F.length(piece) - start - 1)
    return F.when(piece.startswith(F.concat(name, F.lit('="'))), quoted).otherwise(
        F.regexp_replace(piece, PIECE_VALUE, "$1$2$3")
    )


def written_value(tag: Column, name: str) -> Column:
    """Value of one attribute straight from the tag with its character references as they are, NULL if absent.
    Of a repeated attribute the last one counts."""
    piece = F.regexp_extract(tag, attribute_pattern(name), 1)
    return let(piece, lambda p: F.when(p != "", F.regexp_replace(p, PIECE_VALUE, "$1$2$3")))


def written_text(tag: Column, name: str) -> Column:
    """The same, but an absent attribute is empty. A tag without the letters of the name is not matched."""
    piece = F.regexp_extract(tag, attribute_pattern(name), 1)
    return F.when(F.lower(tag).contains(name), F.regexp_replace(piece, PIECE_VALUE, "$1$2$3")).otherwise("")


def attribute_of(tag: Column, name: str) -> Column:
    """Same as ``attribute`` straight from the tag, without decoding its other attributes."""
    return let(written_value(tag, name), decode_references)


def set_attributes(token: Column, edits: Column) -> Column:
    """Token with attributes replaced, or added if absent. ``edits``: ARRAY<STRUCT<name, value>>."""

    def written(name: Column, value: Column) -> Column:
        return F.concat(name, F.lit('="'), encode_value(value), F.lit('"'))

    def replaced(names: Column) -> Callable[[Column, Column], Column]:
        def piece_again(piece: Column, i: Column) -> Column:
            name = F.get(names, i)
            edit = F.try_element_at(F.filter(edits, lambda e: e["name"] == name), F.lit(-1))
            new = let(edit, lambda e: written(_written_name(piece), e["value"]))
            return F.when((i == 0) | ~F.array_contains(edits["name"], name), piece).otherwise(F.coalesce(new, piece))

        return piece_again

    def with_added(head: Column, names: Column) -> Column:
        absent = F.array_except(edits["name"], names)
        added = F.transform(
            F.filter(edits, lambda e: F.array_contains(absent, e["name"])),
            lambda e: F.concat(F.lit(" "), written(e["name"], e["value"])),
        )
        ending = F.regexp_extract(head, r"\s*/?>$", 0)
        body = F.substring(head, F.lit(1), F.length(head) - F.length(ending))
        return F.when(F.size(absent) == 0, head).otherwise(
            F.concat(body, F.array_join(added, ""), ending)
        )

    def new_head(given: Column) -> Column:
        # The names are taken from the pieces once, not for every edit.
        pieces, names = given["pieces"], given["names"]
        return let(F.array_join(F.transform(pieces, replaced(names)), ""), lambda h: with_added(h, names))

    def edited(head: Column) -> Column:
        rest = F.substring(token, F.length(head) + 1, F.length(token))
        pieces = F.regexp_extract_all(head, F.lit(TAG_PIECE), F.lit(0))
        named = let(pieces, lambda p: F.struct(p.alias("pieces"), F.transform(p, _piece_name).alias("names")))
        return F.concat(let(named, new_head), rest)

    return let(F.when(has_body(token), head_of(token)).otherwise(token), edited)


def splice(toks: Column, edits: Column, apply) -> Column:
    """Join tokens again with some of them changed.

    ``edits`` is an array of structs sorted by their field ``pos``; ``apply(token, edit)`` is the new
    text. The unchanged stretches between edits are joined as slices, so the work is linear in the
    number of tokens however many edits there are.
    """

    def joined(given: Column) -> Column:
        toks, edits = given["toks"], given["edits"]
        count = F.size(edits)

        def stretch(i: Column) -> Column:
            # Unchanged tokens before edit i (or up to the end), then the edited token.
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1)["pos"] + 1)
            stop = F.when(i == count, F.size(toks)).otherwise(F.get(edits, i)["pos"])
            kept = F.array_join(F.slice(toks, (start + 1).cast("int"), (stop - start).cast("int")), "")
            changed = F.when(i == count, F.lit("")).otherwise(
                let(F.get(edits, i), lambda e: apply(F.get(toks, e["pos"].cast("int")), e))
            )
            return F.concat(kept, changed)

        return F.array_join(F.transform(F.sequence(F.lit(0), count), stretch), "")

    return let(F.struct(toks.alias("toks"), edits.alias("edits")), joined)
