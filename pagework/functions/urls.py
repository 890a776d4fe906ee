"""URL functions. Every function takes and returns Columns, so all of it runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# scheme, netloc, path, query, fragment; a missing part is the empty string.
URL_PARTS = (
    r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
)

MARK = "\x01"
MARKED_PARTS = MARK.join(f"${i}" for i in range(1, 6))
BLANKS = "".join(chr(c) for c in range(0x21))

# Schemes whose references may be relative to a base of the same scheme.
HIERARCHICAL_SCHEMES = ["", "file", "ftp", "http", "https", "sftp", "ws", "wss"]

# References that need no parsing: whole web addresses, and paths from the root without dot segments.
# Both without blanks, control characters, parameters, and without an empty query or fragment.
# Blanks and control characters one by one, which is a table of the class; a range would be a predicate of its own.
NO_BLANK = "".join(rf"\x{c:02x}" for c in range(0x21))
WEB_ADDRESS = rf"^https?://[^/?#{NO_BLANK}]+(?:/[^?#{NO_BLANK}]*)?(?:\?[^#{NO_BLANK}]+)?(?:#[^{NO_BLANK}]+)?$"
HOST_ADDRESS = rf"^//[^/?#{NO_BLANK}]+(?:/[^?#{NO_BLANK}]*)?(?:\?[^#{NO_BLANK}]+)?(?:#[^{NO_BLANK}]+)?$"
ROOT_PATH = rf"^/(?!/)[^?#;{NO_BLANK}]*(?:\?[^#;{NO_BLANK}]+)?(?:#[^{NO_BLANK}]+)?$"
WEB_ORIGIN = rf"^https?://[^/?#{NO_BLANK}]+"
# A host that ends where the pattern does, so it is the host whatever follows.
WHOLE_ORIGIN = rf"^https?://[^/?#{NO_BLANK}]+(?=[/?#]|\z)"

# A reference of a scheme that is not the web's, which no web address changes, and one that a normal form is equal to.
FOREIGN = r"^(?!(?i:https?):)[a-zA-Z][a-zA-Z0-9+.\-]*:"
PLAIN_SCHEME = rf"^[a-z][a-z0-9+.\-]*:[^/?#{NO_BLANK}]+\z"

DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A filter on a projected column is pushed below the projection and computes the column a second
    time. A generator stops that, which pays where the column is costly. The columns are made below it, because
    a generator over expressions that hold a lambda is interpreted as a whole.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select(*kept, made.alias("_made")).select(*kept, F.inline_outer("_made"))


def tidy(url: Column) -> Column:
    """Drop what a URL parser ignores: leading blanks and any tab or line break."""
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(BLANKS))


def is_tidy(url: Column) -> Column:
    """Is a URL that begins with a letter as ``tidy`` would leave it?"""
    return ~(url.contains("\t") | url.contains("\r") | url.contains("\n"))


def split_url(url: Column) -> Column:
    """STRUCT<scheme, netloc, path, query, fragment>. Never fails, whatever the text is."""

    def named(part: Callable[[int], Column]) -> Column:
        return F.struct(
            F.lower(part(1)).alias("scheme"),
            part(2).alias("netloc"),
            part(3).alias("path"),
            part(4).alias("query"),
            part(5).alias("fragment"),
        )

    def parts(text: Column) -> Column:
        # One match marks all parts; text that holds the mark itself is matched part by part.
        marked = F.split(F.regexp_replace(text, URL_PARTS, MARKED_PARTS), MARK, -1)
        return F.when(
            text.contains(MARK), named(lambda i: F.regexp_extract(text, URL_PARTS, i))
        ).otherwise(let(marked, lambda m: named(lambda i: F.get(m, F.lit(i - 1)))))

    return let(tidy(url), parts)


def join_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """Put the parts of a URL together again; empty parts leave no separator behind."""
    none = F.lit("")

    def rooted(p: Column) -> Column:
        lacks_slash = (netloc != "") & (p != "") & ~p.startswith("/")
        return F.when(lacks_slash, F.concat(F.lit("/"), p)).otherwise(p)

    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(none),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(none),
        let(path, rooted),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(none),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(none),
    )


def remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` away; ``..`` above the root is ignored."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, seg: F.when(
            seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(seg == ".", done)
        .otherwise(F.concat(done, F.array(seg))),
    )
    ends_open = F.element_at(segments, -1).isin(".", "..")
    whole = F.concat(kept, F.when(ends_open, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    joined = F.array_join(whole, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge(base_path: Column, ref_path: Column) -> Column:
    last = F.substring_index(base_path, "/", -1)
    folder = F.substring(base_path, F.lit(1), F.length(base_path) - F.length(last))

    def fold(path: Column) -> Column:
        dotted = (path.contains("/.") | path.startswith(".")) & path.rlike(DOT_SEGMENT)
        return F.when(dotted, remove_dot_segments(path)).otherwise(path)

    def on_base(path: Column) -> Column:
        return let(
            F.concat(folder, path),
            lambda p: F.when(p.contains("//"), F.regexp_replace(p, "/{2,}", "/")).otherwise(p),
        )

    def merged(path: Column) -> Column:
        return let(F.when(path.startswith("/"), path).otherwise(on_base(path)), fold)

    # The ;parameters of the last segment take no part in folding.
    parameters = F.regexp_extract(ref_path, r";[^/]*$", 0)
    plain = F.substring(ref_path, F.lit(1), F.length(ref_path) - F.length(parameters))
    return F.when(ref_path.contains(";"), F.concat(merged(plain), parameters)).otherwise(
        merged(ref_path)
    )


def resolve_parts(base: Column, base_parts: Column, ref: Column) -> Column:
    """``resolve`` for a base that was split before, e.g. once per page."""
    b = base_parts

    def absolute(r: Column) -> Column:
        foreign = ((r["scheme"] != "") & (r["scheme"] != b["scheme"])) | ~b["scheme"].isin(
            HIERARCHICAL_SCHEMES
        )
        query = F.when(r["query"] != "", r["query"]).otherwise(b["query"])
        return (
            F.when(foreign, ref)
            .when(
                r["netloc"] != "",
                join_url(b["scheme"], r["netloc"], r["path"], r["query"], r["fragment"]),
            )
            .when(r["path"] == "", join_url(b["scheme"], b["netloc"], b["path"], query, r["fragment"]))
            .otherwise(
                join_url(
                    b["scheme"], b["netloc"], _merge(b["path"], r["path"]), r["query"], r["fragment"]
                )
            )
        )

    rooted = b["scheme"].isin("http", "https") & (b["netloc"] != "")
    return (
        F.when(base == "", ref)
        .when(ref == "", base)
        .when(base.isNotNull() & ref.rlike(WEB_ADDRESS), ref)
        .when(
            b["scheme"].isin("http", "https") & ref.startswith("//") & ref.rlike(HOST_ADDRESS),
            F.concat(b["scheme"], F.lit(":"), ref),
        )
        .when(
            rooted & ref.rlike(ROOT_PATH) & ~ref.contains("/."),
            F.concat(b["scheme"], F.lit("://"), b["netloc"], ref),
        )
        .otherwise(let(split_url(ref), absolute))
    )


def web_origin(url: Column) -> Column:
    """Scheme and host of a web address, without a final slash; empty for any other URL."""
    return F.regexp_extract(url, WHOLE_ORIGIN, 0)


def resolve_from(base: Column, origin: Column, ref: Column) -> Column:
    """``resolve`` for a base whose ``web_origin`` was read before, e.g. once per page."""
    is_web = origin != ""
    return (
        F.when(base == "", ref)
        .when(ref == "", base)
        .when(base.isNotNull() & ref.startswith("http") & ref.rlike(WEB_ADDRESS), ref)
        .when(
            is_web & ref.startswith("//") & ref.rlike(HOST_ADDRESS),
            F.concat(F.substring_index(origin, "/", 1), ref),
        )
        .when(is_web & ref.startswith("/") & ~ref.contains("/.") & ref.rlike(ROOT_PATH), F.concat(origin, ref))
        .when(
            ref.startswith("#") & (ref != "#") & is_tidy(ref) & base.rlike(WEB_ADDRESS) & is_tidy(base),
            F.concat(F.substring_index(base, "#", 1), ref),
        )
        .when(is_web & ref.rlike(FOREIGN), ref)
        .otherwise(let(split_url(base), lambda b: resolve_parts(base, b, ref)))
    )


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen from ``base``; NULL if either is NULL.

    The frequent cases are decided before any lambda, which would be interpreted.
    """
    origin = F.regexp_extract(base, WEB_ORIGIN, 0)
    return (
        F.when(base.isNotNull() & ref.rlike(WEB_ADDRESS), ref)
        .when((origin != "") & ref.rlike(ROOT_PATH) & ~ref.contains("/."), F.concat(origin, ref))
        .otherwise(let(split_url(base), lambda b: resolve_parts(base, b, ref)))
    )


def is_remote(ref: Column) -> Column:
    return ref.startswith("http://") | ref.startswith("https://") | ref.startswith("//")


def is_resolvable(ref: Column, base: Column) -> Column:
    """A reference can be followed if it names a host, or if a base is known."""
    return is_remote(ref) | base.isNotNull()


def resolve_saved(base: Column, ref: Column) -> Column:
    """Resolution for a page read from disk, whose base may be NULL.

    ``//host/x`` is taken as https, ``/x`` hangs on the origin of the base as it is.
    """
    web = web_origin(base)
    parsed = let(split_url(base), lambda b: F.concat(b["scheme"], F.lit("://"), b["netloc"]))
    origin = F.when(web != "", web).otherwise(parsed)
    return (
        F.when(ref.startswith("//"), F.concat(F.lit("https:"), ref))
        .when(is_remote(ref), ref)
        .when(ref.startswith("/"), F.concat(origin, ref))
        .otherwise(resolve(base, ref))
    )


def origin_of(url: Column) -> Column:
    """Scheme and host of a URL, closed by a slash. Web addresses are decided before any lambda."""
    web = web_origin(url)
    parsed = let(split_url(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/")))
    return F.when(web != "", F.concat(web, F.lit("/"))).otherwise(parsed)


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(tidy(url), URL_PARTS, 2)


def normalize(url: Column, site_root: Column) -> Column:
    """Identity of a page: no fragment, no final slash unless it is the site root."""

    def plain(u: Column) -> Column:
        is_plain = (
            (u.startswith("http://") | u.startswith("https://"))
            & is_tidy(u)
            & ~(u.contains("#") | u.endswith("?") | u.contains(":///"))
        )
        parsed = let(
            split_url(u),
            lambda p: join_url(p["scheme"], p["netloc"], p["path"], p["query"], F.lit("")),
        )
        return F.when(is_plain, u).otherwise(parsed)

    def strip(n: Column) -> Column:
        return F.when(
            n.endswith("/") & (n != site_root), F.substring(n, F.lit(1), F.length(n) - 1)
        ).otherwise(n)

    # Most addresses are web addresses without a final slash, decided before any lambda.
    page = F.substring_index(url, "#", 1)
    frequent = (
        (url.startswith("http://") | url.startswith("https://"))
        & is_tidy(url)
        & ~(page.endswith("/") | page.endswith("?") | page.contains(":///") | page.contains("://?"))
    )
    return F.when(frequent, page).when(url.rlike(PLAIN_SCHEME), url).otherwise(let(let(url, plain), strip))


def is_same_site(url: Column, site: Column, strict_reference: bool = False) -> Column:
    """``site`` is a host with its port. ``strict_reference`` also accepts URLs without a host."""
    if strict_reference:
        return let(netloc_of(url), lambda host: (host == site) | (host == ""))
    address = F.when(url.startswith("http") & is_tidy(url), url).otherwise(tidy(url))
    host = F.regexp_extract(address, r"^(?i:https?)://([^/?#]*)", 1)
    return (host != "") & (host == site)


def short_hash(url: Column) -> Column:
    """First eight hex digits of the MD5 of the URL."""
    return F.left(F.md5(url), F.lit(8))


def language_url(base: Column, lang: Column) -> Column:
    mark = F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(base, mark, F.lit("lang="), lang)
