"""Expected results as DuckDB SQL, one statement per query."""

from __future__ import annotations

from workload import duck as d
from workload.views import with_views

REPLACEMENT = "https://home.example/start"
LANGUAGE_ROWS = "(values ('en', 0), ('fr', 1), ('de', 2))"

ORACLES: dict[str, str] = {}

SITE = d.netloc("url")

# --- the given pages

ORACLES["page_scan"] = (
    f"select {SITE} as site, url, page_id as page_order, cast(len(html) as bigint) as n_chars from pages"
)

ORACLES["element_counts"] = """
with plain as (
  select url, regexp_replace(html, '<!--.*?-->|(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>', '\\1\\2', 'gs') as html
  from pages),
tags as (select url, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from plain)
select url, lower(tag) as tag, count(*) as n from tags group by all"""

# One row per link of a given page.
GIVEN_LINKS = f"""
given as (
  select {SITE} as site, page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
targets as (
  select *, {d.scheme('url')} || '://' || site || href as abs_url,
         {d.scheme('url')} || '://' || site || '/' as root from given),
given_links as (
  select *, {d.normalize('abs_url', 'root')} as dst, {d.normalize('url', 'root')} as page_norm from targets)"""

ORACLES["link_extract"] = (
    f"with {GIVEN_LINKS} select url, href, count(*) as n from given_links group by all"
)
ORACLES["link_targets"] = f"with {GIVEN_LINKS} select url, href, abs_url, dst, page_norm from given_links"
ORACLES["link_summary"] = f"""with {GIVEN_LINKS}
select site, url, cast(count(*) as bigint) as n_links, count(distinct dst) as n_targets,
       cast(count(*) filter ({d.netloc('dst')} = site) as bigint) as n_same_site
from given_links group by site, url"""

# The references that the given pages have; what is decoded first is not decoded again.
ORACLES["decoded_pages"] = """
select url, cast(len(text) as bigint) as n_chars, md5(text) as digest
from (select url, regexp_replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;?', '&', 'g') as text
      from pages) p"""

ORACLES["url_parts"] = f"""
select url, {d.scheme('url')} as scheme, {SITE} as netloc, {d.path('url')} as path,
       {d.query('url')} as query, {d.fragment('url')} as fragment from pages"""

# --- URL and path functions

FX_RESOLVED = d.resolve_steps("fx_links", "url", "href")


def _fx(names: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    return with_views(names, body, extra)


ORACLES["url_resolve"] = _fx(["fx_links"], "select page_id, pos, abs_url from r3", FX_RESOLVED)

ORACLES["url_resolve_local"] = _fx(
    ["fx_links", "fx_refs"],
    """select page_id, pos, remote or page_id % 4 <> 0 as resolvable,
       case when not (remote or page_id % 4 <> 0) then null
            when href like '//%' then 'https:' || href when remote then href
            when href like '/%' then regexp_extract(url, '^https://[^/]*', 0) || href
            else abs_url end as abs_url from (
       select *, regexp_matches(href, '^(https?:)?//') as remote from r3) t""",
    [
        (
            "both_kinds",
            "select page_id, url, pos, href from fx_links union all "
            "select r.page_id, p.url, r.pos + 100, r.raw_ref from fx_refs r join fx_pages p on p.page_id = r.page_id",
        ),
        *d.resolve_steps("both_kinds", "url", "href"),
    ],
)

ROOT = "'https://' || site || '/'"
ORACLES["url_normalize"] = _fx(
    ["fx_links"], f"select page_id, pos, {d.normalize('abs_url', ROOT)} as dst from r3", FX_RESOLVED
)
ORACLES["same_site_links"] = _fx(
    ["fx_links"],
    f"""select page_id, pos, {d.scheme('abs_url')} in ('http', 'https') and {d.netloc('abs_url')} = site as same_site,
        {d.netloc('abs_url')} in (site, '') as same_site_strict from r3""",
    FX_RESOLVED,
)
CRAWLABLE = (
    f"{d.scheme('abs_url')} in ('http', 'https') and {d.netloc('abs_url')} = site "
    "and not regexp_matches(href, '^(#|javascript:|mailto:)')"
)
ORACLES["crawlable_links"] = _fx(
    ["fx_links"],
    f"select distinct site, url, {d.normalize('abs_url', ROOT)} as dst from r3 where {CRAWLABLE}",
    FX_RESOLVED,
)
ORACLES["url_hash"] = _fx(
    ["fx_assets"],
    f"""select url, {d.hash8('url')} as hash8 from pages
        union all select url, {d.hash8('url')} as hash8 from fx_assets""",
)
ORACLES["lang_url"] = f"""
select url as base_url, l.lang, cast(l.no as bigint) as lang_no,
       url || case when contains(url, '?') then '&' else '?' end || 'lang=' || l.lang as url
from pages cross join {LANGUAGE_ROWS} l(lang, no)"""

ORACLES["clean_filename"] = _fx(
    ["fx_assets"],
    f"select url, {d.clean('name')} as clean from (select url, {d.base_name(d.path('url'))} as name from fx_assets) t",
)


def _filled(default: str) -> str:
    own = d.suffix("name")
    return (
        f"case when {own} <> '' then {own} when kind = 'css' then '.css' when kind = 'js' then '.js' "
        f"else '{default}' end"
    )


ORACLES["asset_folder"] = _fx(
    ["fx_assets"],
    f"""select url, flat_suffix, {d.folder('flat_suffix', 'kind')} as flat_folder,
        tree_suffix, {d.folder('tree_suffix', 'kind', 'assets/')} as tree_folder
        from (select *, {_filled('.html')} as flat_suffix, {_filled('')} as tree_suffix
              from (select url, kind, {d.base_name(d.path('url'))} as name from fx_assets) n) s""",
)
ORACLES["page_path_tree"] = _fx(
    ["fx_pages"],
    f"""select url, {d.tree_path('url')} as path
        from (select url from pages union all select url from fx_pages) t""",
)
ORACLES["page_path_flat"] = f"""
with named as (select {SITE} as site, page_id, url, {d.flat_path('url')} as name from pages),
ranked as (select *, row_number() over (partition by site, name order by page_id, url) as n from named)
select site, url, case when n = 1 then name else regexp_replace(name, '\\.html$', '') || '_' || {d.hash8('url')} || '.html' end as path
from ranked"""

ORACLES["relative_path"] = _fx(
    ["fx_links"],
    f"""select page_id, pos, {d.relative('target', 'folder')} as to_page,
        {d.relative("'assets/css/all-styles.css'", 'folder')} as to_css
        from (select *, {d.folder_of('own')} as folder
              from (select page_id, pos, {d.tree_path('dst')} as target, {d.tree_path('url')} as own
                    from (select *, {d.normalize('abs_url', ROOT)} as dst from r3
                          where {d.scheme('abs_url')} in ('http', 'https') and {d.netloc('abs_url')} = site) a) b) c""",
    FX_RESOLVED,
)

# --- references of the made pages

ASSET_REFS = [
    (
        "page_refs",
        """
select t.page_id, p.site, p.url, t.pos, t.slot, t.ref_kind as kind, t.ref_rank as rnk, c.cand,
       case when c.cand = 1 then '/missing/s.png' else t.raw_ref end as raw_ref,
       case when t.slot <> 'srcset' then '' when c.cand = 1 then '2x' else '1x' end as descriptor
from fx_tags t join fx_frames p on p.page_id = t.page_id
cross join (select 0 as cand union all select 1) c
where p.status < 400 and t.ref_kind <> 'link' and (c.cand = 0 or t.slot = 'srcset')""",
    ),
    (
        "refs",
        """
select *, case when raw_ref like '//%' then 'https:' || raw_ref
               when raw_ref like '/%' then 'https://' || site || raw_ref else raw_ref end as abs_url
from page_refs""",
    ),
]


def _refs(where: str) -> str:
    # The position of an inline reference counts the pieces of the style, of which it is the second.
    return _fx(
        ["fx_tags", "fx_frames"],
        f"""select url, slot, raw_ref, descriptor, abs_url, count(*) as n from refs
            where {where} group by all""",
        ASSET_REFS,
    )


ORACLES["stylesheet_refs"] = _refs("kind = 'css'")
ORACLES["script_refs"] = _refs("kind = 'js'")
ORACLES["image_refs"] = _refs("kind = 'image'")
ORACLES["image_refs_basic"] = _refs("kind = 'image' and rnk in (2, 9)")
ORACLES["icon_refs"] = _refs("kind = 'icon'")
ORACLES["inline_style_refs"] = _refs("kind = 'style'")

ORACLES["css_refs"] = _fx(
    ["fx_assets"],
    """select url as sheet_url, regexp_extract(content, 'url\\(([^)]*bg\\.png)\\)', 1) as raw_ref,
       regexp_extract(url, '^https://[^/]*/a/', 0) || regexp_extract(content, '([0-9]+/bg\\.png)', 1) as abs_url
       from fx_assets where contains(content, 'bg.png')""",
)
ORACLES["srcset_candidates"] = _fx(
    ["fx_refs"],
    """select page_id, row_number() over (partition by page_id order by pos) - 1 as cand_pos, raw_ref as ref,
       case when pos % 2 = 0 then pos || 'w' else '' end as descriptor
       from fx_refs where kind = 'image'""",
)
ORACLES["base_detect"] = _fx(
    ["fx_tags", "fx_frames"],
    """select site, url, case when page_id % 10 = 3 then 'https://base.example/x/' else
              regexp_extract(first, '^https?://[^/]*', 0) || '/' end as base
       from (select p.page_id, p.site, p.url, min_by(t.raw_ref, (t.g, t.pos)) as first
             from fx_frames p join fx_tags h on h.page_id = p.page_id
             left join (select page_id, pos, raw_ref,
                               case when ref_kind in ('css', 'icon') then 1 when ref_kind = 'js' then 2 else 3 end as g
                        from fx_tags where raw_ref like 'http%' and (ref_kind in ('css', 'icon', 'js') or ref_rank in (2, 3))) t
               on t.page_id = p.page_id
             where p.status < 400 group by all) s
       where page_id % 10 = 3 or first is not null""",
)
ORACLES["ref_asset_join"] = _fx(
    ["fx_tags", "fx_frames", "fx_assets"],
    """select r.url, r.kind, r.abs_url, coalesce(a.status < 400, false) as ok, count(*) as n
       from refs r left join fx_assets a on a.url = r.abs_url group by all""",
    ASSET_REFS,
)

# --- the catalogue of assets


def catalogue(prefix: str = "", default_name: str = "index.html", keep_failed: bool = True,
              where: str = "true", refs: list[tuple[str, str]] = ASSET_REFS) -> list[tuple[str, str]]:
    """Steps up to ``named``: one row per site and asset, with its outcome and local path."""
    suffix = "case when own <> '' then own when kind = 'css' then '.css' when kind = 'js' then '.js' else '.html' end"
    kept = "true" if keep_failed else "ok"
    return [
        *refs,
        (
            "direct",
            f"""
select site, abs_url, count(*) as n_refs, min({{'p': page_id, 'r': rnk, 'q': pos, 'c': cand, 's': 0, 'k': kind}}) as f
from refs where {where} group by site, abs_url""",
        ),
        (
            "inner_refs",
            """
select d.site, a.url as sheet_url,
       regexp_extract(a.url, '^https://[^/]*/a/', 0) || regexp_extract(a.content, '([0-9]+/bg\\.png)', 1) as abs_url,
       {'p': d.f.p, 'r': d.f.r, 'q': d.f.q, 'c': d.f.c, 's': 2, 'k': 'other'} as f
from direct d join fx_assets a on a.url = d.abs_url
where d.f.k = 'css' and a.status < 400 and contains(a.content, 'bg.png')""",
        ),
        (
            "found",
            """
select u.site, u.abs_url, min(u.f) as f, cast(sum(u.n) as bigint) as n_refs, coalesce(any_value(a.status) < 400, false) as ok
from (select site, abs_url, f, n_refs as n from direct
      union all select site, abs_url, f, 1 as n from inner_refs) u
left join fx_assets a on a.url = u.abs_url group by u.site, u.abs_url""",
        ),
        (
            "foldered",
            f"""
select *, {d.folder('suffix', 'kind', prefix)} as folder from (
  select *, {suffix} as suffix from (
    select *, {d.suffix('name')} as own from (
      select *, f.k as kind, case when base = '' then '{default_name}' else base end as name from (
        select *, {d.base_name(d.path('abs_url'))} as base from found) a) b) c) e""",
        ),
        (
            "plain_named",
            f"""
select *, case when folder = '{prefix}images' then {d.clean('name')}
               else {d.stem('name')} || '_' || {d.hash8('abs_url')} || suffix end as plain from foldered""",
        ),
        (
            "numbered",
            f"""
select *, row_number() over (partition by site, folder, plain order by f) - 1 as number
from plain_named where {kept}""",
        ),
        (
            "candidates",
            f"""
select *, case when number = 0 then plain else {d.stem('plain')} || '_' || number || {d.suffix('plain')} end as candidate
from numbered""",
        ),
        (
            "named",
            f"""
select n.site, n.abs_url, n.kind, n.folder, n.ok, n.n_refs, n.f,
       n.folder || '/' || case when n.number > 0 and u.plain is not null
         then {d.stem('n.plain')} || '_' || {d.hash8('n.abs_url')} || {d.suffix('n.plain')} else n.candidate end as local_path
from candidates n left join (select distinct site, folder, plain from plain_named) u
  on u.site = n.site and u.folder = n.folder and u.plain = n.candidate""",
        ),
    ]


FX_ALL = ["fx_tags", "fx_frames", "fx_assets"]
CATALOGUE = catalogue()

ORACLES["asset_path"] = _fx(
    FX_ALL, "select site, abs_url as url, kind, folder, local_path, ok, n_refs from named", CATALOGUE
)

MATCHED = [
    (
        "matched",
        """select r.*, n.ok, n.local_path from refs r join named n on n.site = r.site and n.abs_url = r.abs_url""",
    )
]
ORACLES["first_of_kind"] = _fx(
    FX_ALL,
    """select site, url, kind, min_by(abs_url, pos) as abs_url, count(*) as n_merged
       from matched where ok and kind in ('css', 'js') group by site, url, kind""",
    CATALOGUE + MATCHED,
)
ORACLES["srcset_rewrite"] = _fx(
    FX_ALL,
    """select site, url, local_path || ' 1x' as value, count(*) as n from matched
       where slot = 'srcset' and cand = 0 and ok group by all""",
    CATALOGUE + MATCHED,
)
BODIES = [
    (
        "bodies",
        """
select n.site, n.abs_url as url, n.kind, n.f,
       case when i.local_path is null then a.content else
         regexp_replace(a.content, 'url\\([^)]*bg\\.png\\)', 'url(../' || i.local_path || ')') end as content
from named n join fx_assets a on a.url = n.abs_url
left join (select r.site, r.sheet_url, m.local_path from inner_refs r
           join named m on m.site = r.site and m.abs_url = r.abs_url and m.ok) i
  on i.site = n.site and i.sheet_url = n.abs_url
where n.ok and n.kind in ('css', 'js')""",
    ),
    (
        "chunks",
        """
select site, kind, row_number() over (partition by site, kind order by f) - 1 as chunk_order, url as source_url,
       chr(10) || '/* Source: ' || url || ' */' || chr(10) || content as chunk from bodies""",
    ),
]
ORACLES["css_rewrite"] = _fx(
    FX_ALL, "select site, url, content from bodies where kind = 'css'", CATALOGUE + BODIES
)
ORACLES["css_bundle"] = _fx(FX_ALL, "select * from chunks", CATALOGUE + BODIES)
ORACLES["bundle_text"] = _fx(
    FX_ALL,
    """select site, kind, cast(0 as bigint) as part, md5(string_agg(chunk, chr(10) order by chunk_order)) as digest
       from chunks group by site, kind""",
    CATALOGUE + BODIES,
)


def _new_tag(css: str, js: str) -> str:
    return f"""case when not t.ok then t.tag when t.ref_kind = 'css' then {css} when t.ref_kind = 'js' then {js}
     when t.slot = 'style' then '<div style="color:red;background:url(' || t.local_path || ')"></div>'
     when t.slot = 'srcset' then '<img srcset="' || t.local_path || ' 1x">'
     else replace(t.tag, t.raw_ref, t.local_path) end"""


NEW_TAG = _new_tag(
    "case when t.pos = t.first_css then '<link rel=\"stylesheet\" href=\"css/all-styles.css\">' else '' end",
    "case when t.pos = t.first_js then '<script src=\"js/all-scripts.js\"></script>' else '' end",
)
LOCAL_TAG = "replace(t.tag, t.raw_ref, t.local_path)"


def new_tags(consolidate: bool) -> list[tuple[str, str]]:
    """Steps up to ``rewritten``: the made pages with local addresses."""
    new_tag = NEW_TAG if consolidate else _new_tag(LOCAL_TAG, LOCAL_TAG)
    return [
        *CATALOGUE,
        *MATCHED,
        (
            "tag_rows",
            """
select g.page_id, p.site, p.url, p.head, p.tail, g.pos, g.tag, g.raw_ref, g.ref_kind, g.slot, coalesce(m.ok, false) as ok, m.local_path,
       min(case when g.ref_kind = 'css' and m.ok then g.pos end) over (partition by g.page_id) as first_css,
       min(case when g.ref_kind = 'js' and m.ok then g.pos end) over (partition by g.page_id) as first_js
from fx_tags g join fx_frames p on p.page_id = g.page_id and p.status < 400
left join matched m on m.page_id = g.page_id and m.pos = g.pos and m.cand = 0""",
        ),
        (
            "rewritten",
            f"""
select page_id, site, url, head || string_agg(new_tag, '' order by pos) || tail as html from (
  select t.*, {new_tag} as new_tag from tag_rows t) u
group by page_id, site, url, head, tail""",
        ),
    ]


ORACLES["asset_rewrite"] = _fx(FX_ALL, "select site, url, html from rewritten", new_tags(True))
ORACLES["asset_rewrite_single"] = _fx(FX_ALL, "select site, url, html from rewritten", new_tags(False))
ORACLES["mirror_pages"] = _fx(
    FX_ALL,
    f"""select site, case when n = 1 then name else regexp_replace(name, '\\.html$', '') || '_' || {d.hash8('url')} || '.html' end as path, html
        from (select *, row_number() over (partition by site, name order by page_id) as n
              from (select *, {d.flat_path('url')} as name from rewritten) a) b""",
    new_tags(True),
)
# Saved pages: files in the order of their paths, references resolved against a given address.
SAVED_REFS = [
    (
        "files",
        f"""
select page_id, site, path, row_number() over (order by path, site) - 1 as number
from (select page_id, site, {d.tree_path('url')} as path from fx_frames
      where status < 400 and page_id in (select page_id from fx_tags)) s""",
    ),
    ASSET_REFS[0],
    (
        "refs",
        """
select r.* replace (f.number as page_id),
       case when raw_ref like '//%' then 'https:' || raw_ref
            when raw_ref like '/%' then 'https://home.example' || raw_ref else raw_ref end as abs_url
from page_refs r join files f on f.page_id = r.page_id""",
    ),
]


def saved_tags() -> list[tuple[str, str]]:
    rows, rewritten = new_tags(True)[-2:]
    placed = rows[1].replace("g.page_id, p.site, p.url", "f.number as page_id, p.site, f.path as url")
    placed = placed.replace("left join matched m on m.page_id = g.page_id", "join files f on f.page_id = g.page_id left join matched m on m.page_id = f.number")
    return [*catalogue(refs=SAVED_REFS), *MATCHED, ("tag_rows", placed), rewritten]


# A reference that is resolved by a base found in the page is to a missing picture, so both give one copy.
ORACLES["mirror_saved"] = ORACLES["mirror_saved_detected"] = _fx(
    FX_ALL, "select site, url as path, html from rewritten", saved_tags()
)
ORACLES["run_totals"] = _fx(
    FX_ALL + ["fx_pages"],
    """select p.site, p.pages_asked, p.pages_done, r.* exclude (site) from
       (select site, count(*) as pages_asked, count(*) filter (status < 400) as pages_done from fx_pages group by site) p
       full join (select site, count(*) as attempted, count(*) filter (ok) as succeeded,
                  count(*) filter (ok and folder = 'css') as css_files, count(*) filter (ok and folder = 'js') as js_files,
                  count(*) filter (ok and folder = 'images') as images_files,
                  count(*) filter (ok and folder = 'fonts') as fonts_files,
                  count(*) filter (ok and folder = 'other') as other_files from named group by site) r on r.site = p.site""",
    CATALOGUE,
)

# --- copies as files

GIVEN_ASSETS = [
    ("sheets", f"select *, 'css/' || n || '_' || {d.hash8('url')} || '.css' as path from fx_given_assets where kind = 'css' and status < 400"),
    ("scripts", f"select *, 'js/' || n || '_' || {d.hash8('url')} || '.js' as path from fx_given_assets where kind = 'js'"),
    ("pictures", "select *, 'images/' || n || '.png' as path from fx_given_assets where kind = 'image' and status < 400"),
    ("seen", "select site, 'https://' || site || '/img/' || (page_id % 11) || '.png' as url from fx_given union select site, 'https://' || site || '/img/' || (n + 3) || '.png' from sheets"),
    (
        "sheet_text",
        """
select s.site, s.url, s.n, s.path,
       case when p.path is null then s.content else '.p{background:url(../' || p.path || ')}' end as body
from sheets s left join pictures p on p.site = s.site and p.n = s.n + 3""",
    ),
    (
        "chunks",
        """
select g.site, 'css' as kind, min(g.page_id) as first, t.url, t.body
from fx_given g join sheet_text t on t.site = g.site and t.n = g.page_id % 7 group by g.site, t.url, t.body
union all
select g.site, 'js' as kind, min(g.page_id) as first, j.url, j.content as body
from fx_given g join scripts j on j.n = g.page_id % 5 group by g.site, j.url, j.content""",
    ),
    (
        "copied_pages",
        f"""
select g.site, g.url, g.page_id,
       case when s.n is null then css_tag else '<link rel="stylesheet" href="css/all-styles.css">' end
         || '<script src="js/all-scripts.js"></script>'
         || case when p.n is null then img_tag else '<img src="' || p.path || '">' end || html as html,
       {d.flat_path('g.url')} as name, case when s.n is null then 0 else 1 end + 1 + case when p.n is null then 0 else 1 end as n_refs
from fx_given g left join sheets s on s.site = g.site and s.n = g.page_id % 7
left join pictures p on p.site = g.site and p.n = g.page_id % 11""",
    ),
    (
        "file_texts",
        f"""
select site, case when row_number() over (partition by site, name order by page_id, url) = 1 then name
         else regexp_replace(name, '\\.html$', '') || '_' || {d.hash8('url')} || '.html' end as path, html as body from copied_pages
union all select site, path, body from sheet_text
union all select distinct g.site, j.path, j.content from fx_given g join scripts j on j.n = g.page_id % 5
union all
select site, kind || case kind when 'css' then '/all-styles.css' else '/all-scripts.js' end,
       string_agg(chr(10) || '/* Source: ' || url || ' */' || chr(10) || body, chr(10) order by first)
from chunks group by site, kind""",
    ),
]
ORACLES["saved_copy"] = _fx(
    ["fx_given", "fx_given_assets"],
    """
select site, path, cast(octet_length(encode(body)) as bigint) as length, md5(body) as digest from file_texts
union all
select p.site, p.path, cast(16 as bigint), md5(unhex(md5(p.url))) from pictures p join seen s on s.site = p.site and s.url = p.url""",
    GIVEN_ASSETS,
)
ORACLES["saved_copy_references"] = _fx(
    ["fx_given", "fx_given_assets"],
    "select site, cast(sum(n_refs) as bigint) as n_refs, cast(0 as bigint) as n_missing from copied_pages group by site",
    GIVEN_ASSETS,
)
# Every page is reached, so a copy has one file for each normal URL and the assets of the pages that count.
ORACLES["saved_crawl"] = _fx(
    ["fx_given_firsts", "fx_given_assets"],
    """
select p.site, p.n_pages, 1 + case when c.n is null then 0 else 1 end as n_bundles, coalesce(c.n, 0) as n_css, p.n_js,
       coalesce(i.n, 0) as n_images, p.n_refs, cast(0 as bigint) as n_missing
from (select f.site, count(*) as n_pages, count(distinct f.page_id % 5) as n_js,
             cast(sum(1 + case when f.page_id % 7 = 6 then 0 else 1 end + case when f.page_id % 11 % 4 = 3 then 0 else 1 end) as bigint) as n_refs
      from fx_given_firsts f group by f.site) p
left join (select site, count(*) as n from used_sheets group by site) c on c.site = p.site
left join (select site, count(*) as n from used_pictures where n % 4 <> 3 group by site) i on i.site = p.site""",
    [
        ("used_sheets", "select distinct site, page_id % 7 as n from fx_given_firsts where page_id % 7 <> 6"),
        ("used_pictures", "select site, page_id % 11 as n from fx_given_firsts union select site, n + 3 from used_sheets"),
    ],
)
_TREE = d.tree_path("url")
ORACLES["page_export"] = f"""
select distinct site, case k when 1 then '../' || place when 2 then repeat('x', 300) || place when 3 then null else page_id || '/' || place end as path,
       case k when 1 then 'not a path inside the site' when 2 then 'a name that is too long' when 3 then 'no path' end as reason,
       case when k not in (1, 2, 3) then cast(len(html) + 1 as bigint) end as n_chars,
       case when k not in (1, 2, 3) then md5(chr(65533) || html) end as digest
from (select {SITE} as site, {_TREE} as place, page_id % 10 as k, page_id, html from pages) p"""

# --- crawl over the made links

PLAIN_URL = "'https://' || site || '/p/' || page_id"
WALK = [
    ("plain", f"select page_id, site, {PLAIN_URL} as url, status from fx_pages"),
    ("plain_links", "select l.page_id, l.site, p.url, l.pos, l.href, p.status from fx_links l join plain p on p.page_id = l.page_id"),
    *d.resolve_steps("plain_links", "url", "href"),
    ("targets", f"select *, {d.normalize('abs_url', ROOT)} as dst, {CRAWLABLE} as crawlable from r3 where status < 400"),
    ("edges", "select distinct site, url, dst from targets where crawlable"),
    ("stored", "select site, url from plain where status < 400"),
    ("starts", "select site, min_by(url, page_id) as url from plain group by site"),
]


def walk() -> list[tuple[str, str]]:
    """The walk ends by itself: a step reaches only what no earlier step has."""
    return [
        *WALK,
        (
            "walked",
            """
select site, url, cast(0 as bigint) as depth from starts union
select w.site, e.dst, w.depth + 1 from walked w join edges e on e.site = w.site and e.url = w.url
left join recurring.walked v on v.site = w.site and v.url = e.dst where v.url is null""",
        ),
        (
            "visited",
            """
select w.site, w.url, min(w.depth) as depth, bool_or(s.url is not null) as fetched
from walked w left join stored s on s.site = w.site and s.url = w.url group by w.site, w.url""",
        ),
        (
            "ranked",
            "select *, row_number() over (partition by site order by depth, url) as n from visited",
        ),
    ]


def _recursive(names: list[str], body: str, extra: list[tuple[str, str]]) -> str:
    sql = _fx(names, body, extra).replace("with ", "with recursive ", 1)
    return sql.replace("walked as (", "walked (site, url, depth) using key (site, url) as (", 1)


FX_CRAWL = ["fx_links", "fx_pages"]
ORACLES["crawl_bfs"] = _recursive(
    FX_CRAWL, "select site, url, fetched, depth from visited", walk()
)
ORACLES["crawl_limited"] = _recursive(
    FX_CRAWL, "select site, url, fetched, depth from ranked where n <= 12", walk()
)
ORACLES["sitemap"] = _recursive(
    FX_CRAWL,
    f"""select v.site, v.url, {d.tree_path('v.url')} as path,
        case when replace(v.url, s.url, '') = '' then '/ (Home)' else replace(v.url, s.url, '') end as label
        from visited v join starts s on s.site = v.site where v.fetched""",
    walk(),
)
ORACLES["sitemap_stats"] = _recursive(
    FX_CRAWL + FX_ALL,
    """select site, cast(sum(page) as bigint) as pages, count(*) filter (saved) as resources,
       count(*) filter (saved and url like '%css') as css_files, count(*) filter (saved and url like '%js') as js_files
       from (select site, url, 1 as page, fetched as saved from visited
             union all select site, abs_url, 0, ok from found) t group by site""",
    [*walk(), *[s for s in catalogue(where="rnk in (0, 1, 2, 9, 10)")]],
)


def rewritten_links(saved: str, page_path: str = "url") -> list[tuple[str, str]]:
    return [
        (
            "link_rows",
            f"""
select t.site, t.url, t.page_id, t.pos, case when not t.crawlable then t.href
       when s.url is null then t.abs_url
       else {d.relative(d.tree_path('t.dst'), d.folder_of(d.tree_path('t.url')))} || regexp_extract(t.abs_url, '#.*$', 0) end as value
from targets t left join {saved} s on s.site = t.site and s.url = t.dst""",
        ),
        (
            "linked",
            """
select site, url, string_agg('<a class="l" href="' || value || '">t</a>', '' order by pos) as html
from link_rows group by site, url""",
        ),
    ]


ORACLES["link_rewrite"] = _fx(
    FX_CRAWL, "select site, url, html from linked", [*WALK, *rewritten_links("stored")]
)


def copied(kept: str) -> str:
    return _recursive(
        FX_CRAWL,
        f"select l.site, {d.tree_path('l.url')} as path, l.html from linked l join kept k on k.site = l.site and k.url = l.url",
        [*walk(), ("kept", f"select site, url from ranked where {kept} and fetched"), *rewritten_links("kept")],
    )


ORACLES["crawl_copy"] = copied("n <= 40")
ORACLES["crawl_copy_all"] = copied("true")

# --- languages

LANGUAGE_BASE = [
    (
        "bases",
        "select 'p' || page_id || '.' || site as site, url as base_url, page_id from fx_pages where status < 400",
    ),
    (
        "language_pages",
        f"""
select b.site, b.base_url, b.page_id, l.lang, l.no from bases b cross join {LANGUAGE_ROWS} l(lang, no)
where b.page_id in (select page_id from fx_tags) and (b.page_id % 8 <> 0 or l.lang <> 'de')""",
    ),
]
ORACLES["lang_fanout"] = _fx(
    ["fx_pages", "fx_tags"],
    """select site, 'index-' || lang || '.html' as path from language_pages
       union all select site, 'index.html' from language_pages where no = 0""",
    LANGUAGE_BASE,
)
ORACLES["lang_selector"] = _fx(
    ["fx_frames", "fx_tags"],
    f"""select p.site, p.url || case when contains(p.url, '?') then '&' else '?' end || 'lang=' || l.lang as url, c.name,
        case c.name when 'style' then 'cursor: pointer;' else 'window.location.href=''index-' || k.lang || '.html''' end as value,
        cast(case c.name when 'style' then 3 else 1 end as bigint) as n
        from fx_frames p cross join {LANGUAGE_ROWS} l(lang, no) cross join (values ('onclick'), ('style')) c(name)
        cross join {LANGUAGE_ROWS} k(lang, no)
        where p.status < 400 and p.page_id in (select page_id from fx_tags) and (p.page_id % 8 <> 0 or l.lang <> 'de')
          and (c.name = 'onclick' or k.no = 0)""",
)

# The first language of a base page is rewritten with the assets of base pages alone; the others get
# the bundles only. The selector items are edited in both, the script is added to both.
LANGUAGE_REFS = [
    ASSET_REFS[0],
    (
        "refs",
        ASSET_REFS[1][1].replace("select *,", "select * replace ('p' || page_id || '.' || site as site),")
        + " where page_id in (select page_id from language_pages)",
    ),
]

# What the copies of a page in several languages hold at the end of their body.
SCRIPT = (
    """<style>#language_selector_trigger{cursor:pointer}</style>"""
    """<script>(function(){var known=["en", "fr", "de"];document.addEventListener('click',function(e){"""
    """var item=e.target.closest('.language_selector');if(!item)return;var lang=item.getAttribute('data-language');"""
    """if(known.indexOf(lang)>=0){e.preventDefault();location.href='index-'+lang+'.html';}});})();</script>"""
)


def _language_html(head: str, tags: str) -> str:
    items = "".join(
        f'<li class="item language_selector" data-language="{x}"'
        + f' onclick="window.location.href=\'\'index-{x}.html\'\'" style="cursor: pointer;">{x}</li>'
        for x in ("en", "fr", "de")
    )
    items += '<li class="item language_selector" data-language="xx">xx</li>'
    script = SCRIPT.replace("'", "''")
    return (
        f"{head} || {tags} || replace(tail, '</body>', '<ul>{items}</ul>{script}</body>')"
    )


ORACLES["mirror_languages"] = _fx(
    [*FX_ALL, "fx_pages"],
    f"""select site, path, html from (
          select l.site, 'index-' || l.lang || '.html' as path, case when l.no = 0 then m.html else o.html end as html, l.no
          from language_pages l left join main_html m on m.page_id = l.page_id left join other_html o on o.page_id = l.page_id) t
        union all
        select l.site, 'index.html' as path, m.html from language_pages l join main_html m on m.page_id = l.page_id where l.no = 0""",
    [
        *LANGUAGE_BASE,
        *catalogue(refs=LANGUAGE_REFS),
        *MATCHED,
        *new_tags(True)[len(CATALOGUE) + len(MATCHED) : -1],
        (
            "own_rows",
            """
select * replace ('p' || page_id || '.' || site as site) from tag_rows
where page_id in (select page_id from language_pages)""",
        ),
        (
            "main_html",
            f"""select page_id, {_language_html('head', "string_agg(new_tag, '' order by pos)")} as html from (
                  select *, {NEW_TAG} as new_tag from own_rows t) u group by page_id, head, tail""",
        ),
        ("bundled", "select distinct site, kind from named where ok and kind in ('css', 'js')"),
        (
            "other_html",
            f"""select page_id, {_language_html('head', "string_agg(new_tag, '' order by pos)")} as html from (
                  select r.*, case when b.kind is null then r.tag
                    when r.pos <> min(r.pos) over (partition by r.page_id, r.ref_kind) then ''
                    when r.ref_kind = 'css' then '<link rel="stylesheet" href="css/all-styles.css">'
                    else '<script src="js/all-scripts.js"></script>' end as new_tag
                  from own_rows r left join bundled b on b.site = r.site and b.kind = r.ref_kind) u
                group by page_id, head, tail""",
        ),
    ],
)

# --- repair

ORACLES["broken_links"] = _fx(
    ["fx_links", "fx_site_files"],
    """select page_id, pos, href from asked l where href like 'javascript:%' or (
         href <> '' and not regexp_matches(href, '^(https?://|mailto:|tel:|#)')
         and not exists (select 1 from entries e where e.site = l.site and e.entry = l.target)
         and not exists (select 1 from entries e where e.site = l.site and e.entry = l.target || '.html')
         and not (regexp_matches(href, '^(/|\\./|\\.\\./)')
                  and exists (select 1 from entries e where e.site = l.site and e.entry = l.target || '/index.html')))""",
    [
        ("asked", "select *, ltrim(href, '/') as target from fx_links"),
        (
            "entries",
            """select site, path as entry from fx_site_files
               union select site, regexp_replace(path, '/[^/]*$', '') from fx_site_files where contains(path, '/')
               union select site, 'p' from fx_site_files union select site, '' from fx_site_files""",
        ),
    ],
)

SAVED = f"""
located as (select {SITE} as site, page_id, {d.tree_path('url')} as path, html from pages),
saved as (select site, path, html from located qualify row_number() over (partition by site, path order by page_id desc) = 1),
parts as (select site, path, string_split(path, '/') as p from saved),
entries as (
  select site, path as entry from saved
  union select site, array_to_string(p[1:i], '/') from (select site, p, unnest(range(0, len(p))) as i from parts) x),
pieces as (
  select site, path, unnest(string_split(html, '<a href="')) as piece,
         generate_subscripts(string_split(html, '<a href="'), 1) as n from saved),
hrefs as (select *, case when n > 1 then regexp_extract(piece, '^[^"]*', 0) end as href from pieces),
tested as (
  select h.*, n > 1 and not exists (
    select 1 from entries e where e.site = h.site and e.entry in
      (ltrim(h.href, '/'), ltrim(h.href, '/') || '.html', ltrim(h.href, '/') || '/index.html')) as broken
  from hrefs h)"""

FIXED = f"""with {SAVED},
fixed as (
  select site, path, string_agg(case when n = 1 then piece when broken then '<a href="{REPLACEMENT}' || substr(piece, len(href) + 1)
    else '<a href="' || piece end, '' order by n) as html, count(*) filter (broken) as links
  from tested group by site, path)"""

ORACLES["fix_links"] = f"{FIXED} select site, path, html from fixed"
ORACLES["fix_links_local"] = f"""{FIXED}
select site, path, href as original, repeat('../', len(string_split(path, '/')) - 1) || 'index.html' as replaced, count(*) as n
from tested where broken group by all"""
ORACLES["fix_report"] = f"""{FIXED}
select site, count(*) as files_processed, count(*) filter (links > 0) as files_changed,
       cast(sum(links) as bigint) as links_fixed from fixed group by site"""
ORACLES["restore_pages"] = f"""{FIXED}
select f.site, f.path, s.html, f.links > 0 as restored from fixed f join saved s on s.site = f.site and s.path = f.path"""
# A file that both repairs change comes back as it was before the first.
ORACLES["restore_generations"] = ORACLES["restore_pages"]

# --- totals of the jobs

RESOURCE_TOTALS = """(select site, count(*) as attempted, count(*) filter (ok) as succeeded,
                  count(*) filter (ok and folder = 'css') as css_files, count(*) filter (ok and folder = 'js') as js_files,
                  count(*) filter (ok and folder = 'images') as images_files,
                  count(*) filter (ok and folder = 'fonts') as fonts_files,
                  count(*) filter (ok and folder = 'other') as other_files from named group by site)"""
ORACLES["totals_of_list"] = ORACLES["run_totals"]
ORACLES["totals_of_saved"] = _fx(
    FX_ALL + ["fx_pages"],
    f"""select p.site, p.pages_asked, p.pages_done, r.* exclude (site) from
       (select site, count(*) as pages_asked, count(*) filter (status < 400) as pages_done from fx_pages group by site) p
       full join {RESOURCE_TOTALS} r on r.site = p.site""",
    catalogue(refs=SAVED_REFS),
)
ORACLES["totals_of_languages"] = _fx(
    [*FX_ALL, "fx_pages"],
    """select site, cast(sum(a) as bigint) as pages_asked, cast(sum(b) as bigint) as pages_done,
              cast(sum(c) as bigint) as attempted, cast(sum(e) as bigint) as succeeded
       from (select site, 3 as a, 0 as b, 0 as c, 0 as e from fx_pages
             union all select regexp_extract(site, '^p[0-9]+\\.(.*)$', 1), 0, 1, 0, 0 from language_pages
             union all select regexp_extract(site, '^p[0-9]+\\.(.*)$', 1), 0, 0, 1, case when ok then 1 else 0 end from named) t
       group by site""",
    [*LANGUAGE_BASE, *catalogue(refs=LANGUAGE_REFS)],
)
ORACLES["totals_of_crawl"] = _recursive(
    FX_CRAWL,
    "select site, count(*) as pages_asked, count(*) filter (fetched) as pages_done from visited group by site",
    walk(),
)
ORACLES["sitemap_lines"] = _recursive(
    FX_CRAWL,
    f"""select '<li><a href="' || {d.tree_path('v.url')} || '">'
         || case when replace(v.url, s.url, '') = '' then '/ (Home)' else replace(v.url, s.url, '') end
         || '</a> <span>' || v.url || '</span></li>' as line
        from visited v join starts s on s.site = v.site where v.fetched""",
    walk(),
)
