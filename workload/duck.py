"""Pieces of DuckDB SQL for the expected results. Written apart from the Spark functions on purpose."""

from __future__ import annotations


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"


def _rest(u: str) -> str:
    return f"regexp_replace({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:', '')"


def netloc(u: str) -> str:
    return f"regexp_extract({_rest(u)}, '^//([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract(regexp_replace({_rest(u)}, '^//[^/?#]*', ''), '^[^?#]*', 0)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '#(.*)$', 1)"


def fold(p: str) -> str:
    """Path without dot segments."""
    kept = (
        f"list_reduce(string_split({p}, '/'), lambda acc, x: case when x = '..' then "
        f"list_slice(acc, 1, len(acc) - 1) when x = '.' then acc else list_append(acc, x) end, []::varchar[])"
    )
    last = f"string_split({p}, '/')[-1]"
    return (
        f"case when regexp_matches({p}, '(^|/)\\.\\.?(/|$)') then array_to_string({kept}, '/') "
        f"|| case when {last} in ('.', '..') then '/' else '' end else {p} end"
    )


def resolve_steps(source: str, base: str, ref: str) -> list[tuple[str, str]]:
    """Steps r1..r3 that add ``abs_url`` to ``source``."""
    return [
        (
            "r1",
            f"select *, {scheme(ref)} as rs, {netloc(ref)} as ra, {path(ref)} as rp, {query(ref)} as rq, "
            f"{fragment(ref)} as rf, {scheme(base)} as bs, {netloc(base)} as ba, {path(base)} as bp, "
            f"{query(base)} as bq from {source}",
        ),
        (
            "r2",
            "select *, case when rp like '/%' then rp else regexp_replace(regexp_extract(bp, '^.*/', 0) "
            "|| rp, '/{2,}', '/', 'g') end as mp from r1",
        ),
        (
            "r3",
            f"select *, case when {ref} = '' then {base} when rs <> '' and rs <> bs then {ref} "
            f"when ra <> '' then bs || '://' || ra || rp || case when rq <> '' then '?' || rq else '' end "
            f"|| case when rf <> '' then '#' || rf else '' end "
            f"else bs || '://' || ba || case when rp = '' then bp else ({fold('mp')}) end "
            f"|| case when rq <> '' then '?' || rq when rp = '' and bq <> '' then '?' || bq else '' end "
            f"|| case when rf <> '' then '#' || rf else '' end end as abs_url from r2",
        ),
    ]


def normalize(u: str, root: str) -> str:
    plain = f"regexp_replace({u}, '\\??(#.*)?$', '')"
    return (
        f"case when {plain} like '%/' and {plain} <> {root} then left({plain}, len({plain}) - 1) "
        f"else {plain} end"
    )


def base_name(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$', 0)"


def suffix(name: str) -> str:
    return f"regexp_extract({name}, '^\\.*[^.].*(\\.[^.]*)$', 1)"


def stem(name: str) -> str:
    return f"left({name}, len({name}) - len({suffix(name)}))"


# Fixed values, here and below: the version hash of a name, the suffixes of each folder, the characters
# of flat names.
def clean(name: str) -> str:
    return f"regexp_replace({stem(name)}, '[_-][a-f0-9]{{6,}}$', '') || {suffix(name)}"


def hash8(u: str) -> str:
    return f"left(md5({u}), 8)"


def folder(suffix_sql: str, kind: str, prefix: str = "") -> str:
    return (
        f"case when {kind} = 'css' or lower({suffix_sql}) = '.css' then '{prefix}css' "
        f"when {kind} = 'js' or lower({suffix_sql}) = '.js' then '{prefix}js' "
        f"when lower({suffix_sql}) in ('.jpg', '.jpeg', '.png', '.gif', '.svg', '.webp', '.ico') then '{prefix}images' "
        f"when lower({suffix_sql}) in ('.woff', '.woff2', '.ttf', '.eot', '.otf') then '{prefix}fonts' "
        f"else '{prefix}other' end"
    )


def tree_path(u: str) -> str:
    p = f"trim({path(u)}, '/')"
    name = base_name(p)
    placed = (
        f"case when {p} = '' then 'index.html' when {suffix(name)} = '' then {p} || '/index.html' "
        f"when {p} like '%.html' or {p} like '%.htm' then {p} else {p} || '.html' end"
    )
    return (
        f"case when {query(u)} = '' then {placed} else "
        f"regexp_replace({placed}, '\\.[^./]*$', '') || '_' || {hash8(u)} || '.html' end"
    )


def flat_path(u: str) -> str:
    p = f"trim({path(u)}, '/')"
    return (
        f"case when {p} = '' then 'index.html' else "
        f"regexp_replace({stem(base_name(p))}, '[^a-zA-Z0-9_-]', '-', 'g') || '.html' end"
    )


def folder_of(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/', 1)"


def relative(target: str, holder: str) -> str:
    a = f"(case when {holder} = '' then []::varchar[] else string_split({holder}, '/') end)"
    b = f"string_split({target}, '/')"
    common = f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[1:i] = {b}[1:i]))"
    return f"repeat('../', len({a}) - {common}) || array_to_string({b}[{common} + 1:], '/')"
