"""Views derived from the given tables, in SQL that Spark and DuckDB both run.

The given pages hold only plain links, so orders, lineitems and parts are read as pages, references
and assets of 20 made-up sites. Each view works on the whole of its tables.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view(
    "fx_pages",
    [],
    """
select o_orderkey as page_id,
       's' || cast(o_orderkey % 20 as string) || '.example' as site,
       'https://s' || cast(o_orderkey % 20 as string) || '.example/p/' || cast(o_orderkey as string)
         || case o_orderkey % 5 when 1 then '.html' when 2 then '/' when 3 then '?page=2' else '' end as url,
       case o_orderkey % 3 when 0 then 'en' when 1 then 'fr' else 'de' end as lang,
       case when o_orderkey % 23 = 22 then 404 else 200 end as status
from orders""",
)

_view(
    "fx_files",
    [],
    """
select p_partkey as asset_id,
       case p_partkey % 8 when 0 then 'css' when 1 then 'js' when 5 then 'font' when 6 then 'other' else 'image' end as kind,
       'https://cdn' || cast(p_partkey % 3 as string) || '.example/a/' || cast(p_partkey as string) || '/'
         || replace(p_name, ' ', '-')
         || case when p_partkey % 2 = 0 then '_' || left(md5(cast(p_partkey as string)), 8) else '' end
         || case p_partkey % 8 when 0 then '.css' when 1 then '.js' when 2 then '.png' when 3 then '.jpg'
              when 4 then '.svg' when 5 then '.woff2' when 6 then '' else '.png?v=1' end as url,
       case when p_partkey % 17 = 0 then 404 else 200 end as status,
       case p_partkey % 8
         when 0 then '.c{background:url(../' || cast(p_partkey + 2 as string) || '/bg.png)}@font-face{src:url(f.woff2)}'
         when 1 then 'f(' || cast(p_partkey as string) || ');' else '' end as content
from part""",
)

# The pictures that the style sheets of fx_files refer to, 1 in 5 failed.
_view(
    "fx_assets",
    ["fx_files"],
    """
select asset_id, kind, url, status, content from fx_files
union all
select -asset_id as asset_id, 'image' as kind,
       'https://cdn' || cast(asset_id % 3 as string) || '.example/a/' || cast(asset_id + 2 as string) || '/bg.png' as url,
       case when asset_id % 5 = 0 then 404 else 200 end as status, '' as content
from fx_files where kind = 'css'""",
)

_view(
    "fx_refs",
    ["fx_files"],
    """
select r.page_id, cast(r.pos as bigint) as pos, a.kind, a.asset_id,
       case when r.n = 7 then '/missing/' || cast(r.pos as string) || '.png'
            when r.n % 3 = 0 then replace(a.url, 'https:', '') else a.url end as raw_ref
from (select l_orderkey as page_id, l_partkey, l_linenumber as n,
             row_number() over (partition by l_orderkey
               order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as pos
      from lineitem) r
join fx_files a on a.asset_id = r.l_partkey""",
)

# One element per reference: where it stands (slot), what it is, how it is written.
_view(
    "fx_tags",
    ["fx_refs"],
    """
select page_id, pos, raw_ref, slot, ref_kind, ref_rank,
       case slot_no when 10 then '<link rel="stylesheet" href="' || raw_ref || '">'
                    when 11 then '<script src="' || raw_ref || '"></script>'
                    when 12 then '<a href="' || raw_ref || '">x</a>'
                    when 0 then '<img src="' || raw_ref || '">'
                    when 1 then '<img data-src="' || raw_ref || '">'
                    when 2 then '<amp-img src="' || raw_ref || '"></amp-img>'
                    when 3 then '<link rel="shortcut icon" href="' || raw_ref || '">'
                    when 4 then '<div style="color:red;background:url(''' || raw_ref || ''')"></div>'
                    else '<img srcset="' || raw_ref || ' 1x, /missing/s.png 2x">' end as tag
from (select page_id, pos, raw_ref, slot_no,
             case slot_no when 11 then 'src' when 0 then 'src' when 1 then 'data-src' when 2 then 'src'
                          when 4 then 'style' when 5 then 'srcset' else 'href' end as slot,
             case slot_no when 10 then 'css' when 11 then 'js' when 12 then 'link' when 3 then 'icon'
                          when 4 then 'style' else 'image' end as ref_kind,
             cast(case slot_no when 10 then 0 when 11 then 1 when 0 then 2 when 1 then 7 when 2 then 3
                          when 3 then 10 when 4 then 11 when 5 then 9 else 99 end as bigint) as ref_rank
      from (select page_id, pos, raw_ref,
                   case kind when 'css' then 10 when 'js' then 11 when 'image' then pos % 6 else 12 end as slot_no
            from fx_refs) t) u""",
)

# Text before and after the elements of a page. Markup inside comments and scripts is no markup.
_view(
    "fx_frames",
    ["fx_pages"],
    """
select page_id, site, url, status,
       '<html><head><!-- <img src="/hidden.png"> -->'
         || case when page_id % 10 = 3 then '<base href="https://base.example/x/">' else '' end
         || '</head><body>' as head,
       '<script>var t="<img src=/no.png>";</script></body></html>' as tail
from fx_pages""",
)

# The first two links of a page lead to two others of its site, as in a binary tree whose last level
# leads back to its first ones, so every page is a few steps from the start of its site.
_view(
    "fx_links",
    ["fx_pages"],
    """
select p.page_id, p.site, p.url, cast(j.j as bigint) as pos,
       case j.j when 0 then '/p/' || cast((2 * p.page_id - p.page_id % 20 + 20) % c.n as string)
                when 1 then 'https://' || p.site || '/p/' || cast((2 * p.page_id - p.page_id % 20 + 40) % c.n as string) || '#s'
                when 2 then 'https://s' || cast((p.page_id + 1) % 20 as string) || '.example/p/' || cast((p.page_id + 1) % c.n as string)
                when 3 then '/gone/' || cast(p.page_id as string)
                when 4 then '../p/./' || cast((p.page_id + 20) % c.n as string) || '.html'
                else case p.page_id % 5 when 0 then 'mailto:a@b.example' when 1 then 'javascript:void(0)'
                       when 2 then '#top' when 3 then 'tel:+1' else '' end end as href
from fx_pages p
cross join (select count(*) as n from orders) c
cross join (select 0 as j union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) j""",
)

_view(
    "fx_site_files",
    ["fx_pages"],
    """
select site, 'p/' || cast(page_id as string) || case page_id % 5 when 1 then '.html' else '/index.html' end as path
from fx_pages where page_id % 9 <> 0""",
)

# The given pages with a style sheet, a script and two pictures each, and the assets behind them: those of a
# site are its own, scripts are shared by all. 1 sheet in 7 and 1 picture in 4 failed.
_view(
    "fx_given",
    [],
    """
select page_id, url, site,
       '<link rel="stylesheet" href="https://' || site || '/css/' || cast(page_id % 7 as string) || '.css">' as css_tag,
       '<script src="https://cdn.example/js/' || cast(page_id % 5 as string) || '.js"></script>' as js_tag,
       '<img src="https://' || site || '/img/' || cast(page_id % 11 as string) || '.png">' as img_tag,
       html
from (select page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as site from pages) p""",
)

_view(
    "fx_given_assets",
    ["fx_given"],
    """
select site, 'css' as kind, n, 'https://' || site || '/css/' || cast(n as string) || '.css' as url,
       case when n = 6 then 404 else 200 end as status,
       '.p{background:url(/img/' || cast(n + 3 as string) || '.png)}' as content
from (select distinct site, page_id % 7 as n from fx_given) c
union all
select site, 'image' as kind, n, 'https://' || site || '/img/' || cast(n as string) || '.png' as url,
       case when n % 4 = 3 then 404 else 200 end as status, '' as content
from (select site, page_id % 11 as n from fx_given union select site, page_id % 7 + 3 as n from fx_given) i
union all
select 'cdn.example' as site, 'js' as kind, n, 'https://cdn.example/js/' || cast(n as string) || '.js' as url,
       200 as status, 'f(' || cast(n as string) || ');' as content
from (select distinct page_id % 5 as n from fx_given) j""",
)

# The given pages by their normal URL, numbered in their site, and linked as a binary tree from the first one.
_view(
    "fx_given_firsts",
    ["fx_given"],
    """
select site, normal, page_id, row_number() over (partition by site order by page_id) - 1 as k
from (select site, normal, min(page_id) as page_id
      from (select site, page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as normal from fx_given) a
      group by site, normal) b""",
)

_view(
    "fx_given_tree",
    ["fx_given_firsts"],
    """
select f.site, f.url, f.page_id, f.css_tag, f.js_tag, f.img_tag, f.html,
       coalesce('<a href="' || replace(a.normal, '&', '&amp;') || '">a</a>', '')
         || coalesce('<a href="' || replace(b.normal, '&', '&amp;') || '#b">b</a>', '') as child_tags
from (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as normal from fx_given) f
join fx_given_firsts g on g.site = f.site and g.normal = f.normal
left join fx_given_firsts a on a.site = g.site and a.k = 2 * g.k + 1
left join fx_given_firsts b on b.site = g.site and b.k = 2 * g.k + 2""",
)


def _ordered(names: list[str]) -> list[str]:
    done: list[str] = []
    for name in names:
        for inner in [*_ordered(VIEWS[name][0]), name]:
            if inner not in done:
                done.append(inner)
    return done


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``body`` with the named views, and ``extra`` steps after them, as common table expressions."""
    steps = [(n, VIEWS[n][1].strip()) for n in _ordered(names)] + list(extra)
    return "with " + ",\n".join(f"{n} as ({sql})" for n, sql in steps) + "\n" + body
