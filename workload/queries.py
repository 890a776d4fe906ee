"""The queries: one per operator, over the whole of the given tables or of views derived from them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.functions import markup, paths, urls
from pagework.functions.paths import FLAT, TREE
from pagework.operators import (
    bundles,
    crawl,
    elements,
    linkfix,
    links,
    report,
    resources,
    rewrite,
    sitemap,
    variants,
)
from pagework.operators.joins import lookup
from pagework.plans.crawl_site import copy_sites
from pagework.plans.mirror import collect_assets, flat_names, mirror_languages, mirror_pages, mirror_saved
from pagework.plans.repair import repair_sites
from pagework.plans.save import save_copy, saved_references
from pagework.session import tune
from pagework.sources.backups import BackupStore
from pagework.sources.scan import decode_text, scan_pages
from pagework.sources.scratch import Scratch
from pagework.sources.sinks import write_sitemap
from pagework.sources.site_files import read_files, save_files
from workload.views import with_views

BASE_TABLES = ["orders", "lineitem", "part", "pages"]
REPLACEMENT = "https://home.example/start"
LANGUAGES = ["en", "fr", "de"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, body: str = "select * from {}") -> DataFrame:
    sql = with_views([name], body.format(name))
    for base in BASE_TABLES:
        if re.search(rf"\bfrom {base}\b", sql):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(table(spark, sf_dir, "pages"))


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with markup, one element per reference; failed pages are left out."""
    tags = view(spark, sf_dir, "fx_tags", "select page_id, pos, tag from {}")
    bodies = tags.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("t"))
    frames = view(spark, sf_dir, "fx_frames").filter("status < 400")
    body = F.array_join("t.tag", "")
    return frames.join(bodies, "page_id").select(
        "page_id", "url", F.concat("head", body, "tail").alias("html")
    )


def made_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(made_pages(spark, sf_dir))


def kept_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written once, for jobs that read their pages several times."""
    return Scratch(spark).keep(made_site_pages(spark, sf_dir), "pages")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_assets", "select url, status, content from {}")


def fx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links")


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_links(spark, sf_dir).withColumn("abs_url", urls.resolve(F.col("url"), F.col("href")))


# --- scans and elements


def page_scan(spark, sf_dir):
    return given_pages(spark, sf_dir).select(
        "site", "url", "page_order", F.length("html").cast("long").alias("n_chars")
    )


def element_counts(spark, sf_dir):
    return elements.elements(given_pages(spark, sf_dir)).groupBy("url", "tag").agg(F.count(F.lit(1)).alias("n"))


def link_extract(spark, sf_dir):
    return elements.anchors(given_pages(spark, sf_dir)).groupBy("url", "href").agg(
        F.count(F.lit(1)).alias("n")
    )


def link_targets(spark, sf_dir):
    return links.site_links(links.page_links(given_pages(spark, sf_dir))).select(
        "url", "href", "abs_url", "dst", "page_norm"
    )


def link_summary(spark, sf_dir):
    return links.link_summary(links.site_links(links.page_links(given_pages(spark, sf_dir))))


def decoded_pages(spark, sf_dir):
    text = markup.decode_references(F.col("html"))
    pages = given_pages(spark, sf_dir).select("url", text.alias("text"))
    return pages.select("url", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


# --- URL and path functions


def url_parts(spark, sf_dir):
    parts = urls.split_url(F.col("url"))
    return given_pages(spark, sf_dir).select("url", parts.alias("p")).select("url", "p.*")


def url_resolve(spark, sf_dir):
    return resolved_links(spark, sf_dir).select("page_id", "pos", "abs_url")


def url_resolve_local(spark, sf_dir):
    base = F.when(F.col("page_id") % 4 != 0, F.col("url"))
    refs = view(spark, sf_dir, "fx_refs", "select page_id, pos, raw_ref as href from {}")
    pages = view(spark, sf_dir, "fx_pages").select("page_id", "url")
    rows = fx_links(spark, sf_dir).select("page_id", "url", "pos", "href")
    rows = rows.unionByName(refs.join(pages, "page_id").withColumn("pos", F.col("pos") + 100))
    resolvable = urls.is_resolvable(F.col("href"), F.col("base"))
    return rows.withColumn("base", base).select(
        "page_id",
        "pos",
        resolvable.alias("resolvable"),
        F.when(resolvable, urls.resolve_saved(F.col("base"), F.col("href"))).alias("abs_url"),
    )


def url_normalize(spark, sf_dir):
    root = F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    return resolved_links(spark, sf_dir).select(
        "page_id", "pos", urls.normalize(F.col("abs_url"), root).alias("dst")
    )


def same_site_links(spark, sf_dir):
    same = urls.is_same_site(F.col("abs_url"), F.col("site"))
    strict = urls.is_same_site(F.col("abs_url"), F.col("site"), strict_reference=True)
    return resolved_links(spark, sf_dir).select(
        "page_id", "pos", same.alias("same_site"), strict.alias("same_site_strict")
    )


def crawlable_links(spark, sf_dir):
    return links.distinct_links(links.site_links(resolved_links(spark, sf_dir)))


def url_hash(spark, sf_dir):
    pages = given_pages(spark, sf_dir).select("url")
    return pages.unionByName(assets(spark, sf_dir).select("url")).select(
        "url", urls.short_hash(F.col("url")).alias("hash8")
    )


def lang_url(spark, sf_dir):
    seeds = given_pages(spark, sf_dir).select("site", F.col("url").alias("base_url"))
    return variants.language_targets(seeds, LANGUAGES).select("base_url", "lang", "lang_no", "url")


def clean_filename(spark, sf_dir):
    name = paths.base_name(paths.url_path(F.col("url")))
    return assets(spark, sf_dir).select("url", paths.clean_name(name).alias("clean"))


def asset_folder(spark, sf_dir):
    kind = F.when(F.col("kind").isin("css", "js"), F.col("kind")).otherwise(F.lit("other"))
    columns = []
    for layout in (FLAT, TREE):
        suffix = paths.asset_suffix(paths.asset_name(F.col("url"), layout), kind, layout)
        columns += [
            suffix.alias(f"{layout.name}_suffix"),
            paths.asset_folder(suffix, kind, layout).alias(f"{layout.name}_folder"),
        ]
    return view(spark, sf_dir, "fx_assets").select("url", *columns)


def page_path_tree(spark, sf_dir):
    both = given_pages(spark, sf_dir).select("url").unionByName(
        view(spark, sf_dir, "fx_pages").select("url")
    )
    return both.select("url", paths.page_path_tree(F.col("url")).alias("path"))


def page_path_flat(spark, sf_dir):
    return flat_names(given_pages(spark, sf_dir))


def relative_path(spark, sf_dir):
    seen = links.site_links(resolved_links(spark, sf_dir)).filter("same_site")
    folder = paths.folder_of(paths.page_path_tree(F.col("url")))
    return seen.select(
        "page_id",
        "pos",
        paths.relative_path(paths.page_path_tree(F.col("dst")), folder).alias("to_page"),
        paths.relative_path(F.lit(TREE.css_bundle), folder).alias("to_css"),
    )


# --- references


def css_refs(spark, sf_dir):
    return resources.css_refs(assets(spark, sf_dir).filter("content <> ''")).select(
        "sheet_url", "raw_ref", "abs_url"
    )


def srcset_candidates(spark, sf_dir):
    images = view(
        spark, sf_dir, "fx_refs", "select page_id, pos, raw_ref from {} where kind = 'image'"
    )
    written = F.when(F.col("pos") % 2 == 0, F.concat("raw_ref", F.lit(" "), "pos", F.lit("w"))).otherwise(
        F.col("raw_ref")
    )
    values = images.groupBy("page_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", written.alias("w")))), lambda s: s["w"]
            ),
            " ,, ",
        ).alias("value")
    )
    return values.select("page_id", F.inline(elements.srcset_candidates(F.col("value"))))


def _refs_of(kind: str, profile: str = "full") -> Callable:
    def run(spark, sf_dir):
        return (
            elements.page_refs(made_site_pages(spark, sf_dir), profile)
            .filter(F.col("kind") == kind)
            .select("url", "slot", "cand_pos", "raw_ref", "descriptor", "abs_url")
            .groupBy("url", "slot", "raw_ref", "descriptor", "abs_url")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    return run


def base_detect(spark, sf_dir):
    return elements.detect_base(made_site_pages(spark, sf_dir), ["site", "url"])


def ref_asset_join(spark, sf_dir):
    refs = elements.page_refs(made_site_pages(spark, sf_dir))
    refs = Scratch(spark).keep(refs.select("url", "pos", "cand_pos", "kind", "abs_url"), "refs")
    status = assets(spark, sf_dir).select(F.col("url").alias("abs_url"), "status")
    return (
        lookup(refs, status, ["abs_url"])
        .withColumn("ok", resources.is_fetched(F.col("status")))
        .groupBy("url", "kind", "abs_url", "ok")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- assets of made pages


def _collected(spark, sf_dir, layout=FLAT, profile="full", pages=None):
    refs = elements.page_refs(made_site_pages(spark, sf_dir) if pages is None else pages, profile)
    return collect_assets(refs, assets(spark, sf_dir), layout, Scratch(spark))


def asset_path(spark, sf_dir):
    return _collected(spark, sf_dir).resources.select(
        "site", "url", "kind", "folder", "local_path", "ok", "n_refs"
    )


def first_of_kind(spark, sf_dir):
    return bundles.first_of_kind(_collected(spark, sf_dir).matched).select(
        "site", "url", "kind", "abs_url", "n_merged"
    )


def srcset_rewrite(spark, sf_dir):
    edits = rewrite.asset_edits(_collected(spark, sf_dir).matched, FLAT)
    return edits.filter("name = 'srcset'").groupBy("site", "url", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def css_rewrite(spark, sf_dir):
    bodies = _collected(spark, sf_dir).bodies
    return bodies.filter("kind = 'css'").select("site", "url", "content")


def css_bundle(spark, sf_dir):
    found = _collected(spark, sf_dir)
    return bundles.bundle_chunks(found.bodies, found.resources)


def bundle_text(spark, sf_dir):
    found = _collected(spark, sf_dir)
    chunks = Scratch(spark).keep(bundles.bundle_chunks(found.bodies, found.resources), "chunks")
    parts = bundles.bundle_parts(chunks)
    return parts.select("site", "kind", "part", F.md5("text").alias("digest"))


def asset_rewrite(spark, sf_dir):
    pages = kept_site_pages(spark, sf_dir)
    edits = rewrite.asset_edits(_collected(spark, sf_dir, pages=pages).matched, FLAT)
    return rewrite.apply_edits(pages, edits).select("site", "url", "html")


def asset_rewrite_single(spark, sf_dir):
    pages = kept_site_pages(spark, sf_dir)
    edits = rewrite.asset_edits(_collected(spark, sf_dir, pages=pages).matched, FLAT, consolidate=False)
    return rewrite.apply_edits(pages, edits).select("site", "url", "html")


def mirror_page_list(spark, sf_dir):
    return mirror_pages(kept_site_pages(spark, sf_dir), assets(spark, sf_dir), Scratch(spark)).files


def _saved_files(spark, sf_dir):
    pages = kept_site_pages(spark, sf_dir)
    return pages.select("site", paths.page_path_tree(F.col("url")).alias("path"), "html")


def mirror_saved_pages(spark, sf_dir):
    base = "https://home.example/x/page.html"
    return mirror_saved(_saved_files(spark, sf_dir), assets(spark, sf_dir), Scratch(spark), base_url=base).files


def mirror_saved_detected(spark, sf_dir):
    return mirror_saved(_saved_files(spark, sf_dir), assets(spark, sf_dir), Scratch(spark)).files


def run_totals(spark, sf_dir):
    asked = view(spark, sf_dir, "fx_pages").select("site", (F.col("status") < 400).alias("ok"))
    return report.run_totals(asked, _collected(spark, sf_dir).resources)


# --- crawl


def made_link_pages(spark, sf_dir):
    """Pages at the plain address that the made links carry, with the links as their markup."""
    rows = view(
        spark,
        sf_dir,
        "fx_links",
        "select l.page_id, l.site, l.pos, l.href, p.status from {} l join fx_pages p on p.page_id = l.page_id",
    )
    tag = F.concat(F.lit('<a class="l" href="'), "href", F.lit('">t</a>'))
    html = F.array_join(
        F.array_sort(F.collect_list(F.struct("pos", tag.alias("tag"))))["tag"],
        "",
    )
    url = F.concat(F.lit("https://"), "site", F.lit("/p/"), F.col("page_id").cast("string"))
    return (
        rows.filter("status < 400")
        .groupBy("page_id", "site")
        .agg(html.alias("html"))
        .select("site", url.alias("url"), F.col("page_id").alias("page_order"), "html")
    )


def kept_link_pages(spark, sf_dir):
    """The same written once: a crawl reads its pages for their links, their addresses and their text."""
    return Scratch(spark).keep(made_link_pages(spark, sf_dir), "pages")


def seeds(spark, sf_dir):
    """The first page of every site."""
    first = view(spark, sf_dir, "fx_pages").groupBy("site").agg(F.min("page_id").alias("id"))
    base = F.concat(F.lit("https://"), "site", F.lit("/p/"), F.col("id").cast("string"))
    return first.select("site", base.alias("base_url"))


def _crawled(spark, sf_dir, scratch, **options):
    return crawl.crawl(kept_link_pages(spark, sf_dir), seeds(spark, sf_dir), scratch, **options)


def crawl_bfs(spark, sf_dir):
    found = _crawled(spark, sf_dir, Scratch(spark))
    return found.select("site", "url", "fetched", F.col("depth").cast("long").alias("depth"))


def crawl_limited(spark, sf_dir):
    found = _crawled(spark, sf_dir, Scratch(spark), max_pages=12)
    return found.select("site", "url", "fetched", F.col("depth").cast("long").alias("depth"))


def site_map(spark, sf_dir):
    found = _crawled(spark, sf_dir, Scratch(spark))
    return sitemap.sitemap(found, seeds(spark, sf_dir))


def sitemap_stats(spark, sf_dir):
    found = _crawled(spark, sf_dir, Scratch(spark))
    catalogue = _collected(spark, sf_dir, TREE, "basic").resources
    return sitemap.sitemap_stats(found, catalogue)


def link_rewrite(spark, sf_dir):
    pages = kept_link_pages(spark, sf_dir)
    scratch = Scratch(spark)
    found = scratch.keep(links.site_links(links.page_links(pages)), "links")
    edits = rewrite.link_edits(found, pages.select("site", "url"), TREE)
    return rewrite.apply_edits(pages, edits).select("site", "url", "html")


def _copied(spark, sf_dir, max_pages=None):
    pages = kept_link_pages(spark, sf_dir)
    return copy_sites(pages, seeds(spark, sf_dir), assets(spark, sf_dir), Scratch(spark), max_pages)


def crawl_copy(spark, sf_dir):
    return _copied(spark, sf_dir, 40).files


def crawl_copy_all(spark, sf_dir):
    return _copied(spark, sf_dir).files


# --- copies as files


def _saved_copy(spark, sf_dir):
    """A copy of the given pages with elements, written as files: the folder it is in."""
    rows = view(spark, sf_dir, "fx_given", "select page_id, url, concat(css_tag, js_tag, img_tag, html) as html from {}")
    kept = _given_assets(spark, sf_dir)
    scratch = Scratch(spark)
    copy = mirror_pages(scan_pages(rows), kept, scratch)
    root = scratch.place("copy")
    save_copy(copy, kept, root, FLAT, scratch)
    return root


def saved_copy(spark, sf_dir):
    found = read_files(spark, _saved_copy(spark, sf_dir))
    return found.select("site", "path", "length", F.md5("content").alias("digest"))


def saved_copy_references(spark, sf_dir):
    files = Scratch(spark).keep(read_files(spark, _saved_copy(spark, sf_dir)), "files")
    return saved_references(files)


def _given_assets(spark, sf_dir):
    kept = view(spark, sf_dir, "fx_given_assets")
    body = F.when(F.col("kind") == "image", F.unhex(F.md5("url"))).otherwise(F.col("content").cast("binary"))
    return kept.select("url", "status", body.alias("content"))


def saved_crawl(spark, sf_dir):
    """Sites walked from their first page, copied with their assets, and written as files: what is there of each
    kind, and the references that lead to no file."""
    scratch = Scratch(spark)
    html = "concat(css_tag, js_tag, img_tag, child_tags, html) as html"
    pages = scratch.keep(scan_pages(view(spark, sf_dir, "fx_given_tree", f"select page_id, url, {html} from {{}}")), "pages")
    starts = view(spark, sf_dir, "fx_given_firsts", "select site, normal as base_url from {} where k = 0")
    kept = _given_assets(spark, sf_dir)
    copy = copy_sites(pages, starts, kept, scratch)
    root = scratch.place("copy")
    save_copy(copy, kept, root, TREE, scratch)
    files = scratch.keep(read_files(spark, root), "files")
    inside = F.regexp_extract("path", "^assets/([a-z]+)/", 1)
    bundle = F.col("path").isin(TREE.css_bundle, TREE.js_bundle)
    counts = files.groupBy("site").agg(
        F.count_if(inside == "").alias("n_pages"),
        F.count_if(bundle).alias("n_bundles"),
        *(F.count_if((inside == kind) & ~bundle).alias(f"n_{kind}") for kind in ("css", "js", "images")),
    )
    return counts.join(saved_references(files), "site")


def page_export(spark, sf_dir):
    """The given pages as files, some of them under paths that cannot be: what is found again, and what was refused."""
    path, id_ = paths.page_path_tree(F.col("url")), F.col("page_order")
    odd = (
        F.when(id_ % 10 == 1, F.concat(F.lit("../"), path))
        .when(id_ % 10 == 2, F.concat(F.repeat(F.lit("x"), 300), path))
        .when(id_ % 10 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(id_.cast("string"), F.lit("/"), path))
    )
    html = F.concat(F.lit("\ufffd"), "html")
    rows = given_pages(spark, sf_dir).select("site", odd.alias("path"), F.concat(html.cast("binary"), F.unhex(F.lit("FF"))).alias("body"))
    root = Scratch(spark).place("export")
    refused = save_files(rows, root)
    found = read_files(spark, root, suffixes=(".html", ".htm"))
    text = decode_text(F.col("content"))
    return found.select("site", "path", F.lit(None).cast("string").alias("reason"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest")).unionByName(
        refused.groupBy("site", "path", "reason").agg(F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("digest"))
    )


# --- languages


def page_site(page, site):
    """Every page is copied by itself, as a site of its own."""
    return F.concat(F.lit("p"), page.cast("string"), F.lit("."), site)


def language_table(spark, sf_dir, made=made_site_pages):
    """Every made page answers under the URL of each language, with a selector in its body."""
    items = "".join(
        f'<li class="item language_selector" data-language="{x}">{x}</li>' for x in [*LANGUAGES, "xx"]
    )
    pages = made(spark, sf_dir)
    lang = F.explode(F.array(*[F.lit(x) for x in LANGUAGES]))
    html = F.replace("html", F.lit("</body>"), F.concat(F.lit(f"<ul>{items}</ul>"), F.lit("</body>")))
    return pages.select("site", F.col("url").alias("base_url"), "page_order", html.alias("html"), lang.alias("lang"))


def _language_input(spark, sf_dir, made=made_site_pages):
    rows = language_table(spark, sf_dir, made)
    url = urls.language_url(F.col("base_url"), F.col("lang"))
    # Seven in eight pages exist in every language, the rest only in the first two.
    kept = rows.filter((F.col("page_order") % 8 != 0) | (F.col("lang") != "de"))
    return kept.select("site", url.alias("url"), "page_order", "html")


def _own_sites(spark, sf_dir):
    """The pages are written once, because their addresses are read before their text."""
    pages = _language_input(spark, sf_dir, kept_site_pages)
    return pages.withColumn("site", page_site(F.col("page_order"), F.col("site")))


def _language_seeds(spark, sf_dir):
    pages = view(spark, sf_dir, "fx_pages").filter("status < 400")
    return pages.select(page_site(F.col("page_id"), F.col("site")).alias("site"), F.col("url").alias("base_url"))


def lang_fanout(spark, sf_dir):
    found = variants.language_pages(_own_sites(spark, sf_dir), _language_seeds(spark, sf_dir), LANGUAGES)
    return variants.language_files(found).select("site", "path")


def lang_selector(spark, sf_dir):
    edits = variants.selector_edits(_language_input(spark, sf_dir), LANGUAGES)
    return edits.groupBy("site", "url", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def mirror_in_languages(spark, sf_dir):
    done = mirror_languages(
        _own_sites(spark, sf_dir),
        _language_seeds(spark, sf_dir),
        assets(spark, sf_dir),
        LANGUAGES,
        Scratch(spark),
    )
    return done.files


def totals_of_languages(spark, sf_dir):
    """Of every page three languages are asked for; pages that failed are there in none of them."""
    seeds_ = view(spark, sf_dir, "fx_pages")
    seeds_ = seeds_.select(page_site(F.col("page_id"), F.col("site")).alias("site"), F.col("url").alias("base_url"))
    done = mirror_languages(_own_sites(spark, sf_dir), seeds_, assets(spark, sf_dir), LANGUAGES, Scratch(spark))
    site = F.regexp_extract("site", r"^p\d+\.(.*)$", 1)
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("pages_asked", "pages_done", "attempted", "succeeded")]
    return done.totals.groupBy(site.alias("site")).agg(*sums)


def totals_of_list(spark, sf_dir):
    asked = view(spark, sf_dir, "fx_pages").select("site", (F.col("status") < 400).alias("ok"))
    return mirror_pages(made_site_pages(spark, sf_dir), assets(spark, sf_dir), Scratch(spark), asked=asked).totals


def totals_of_saved(spark, sf_dir):
    asked = view(spark, sf_dir, "fx_pages").select("site", (F.col("status") < 400).alias("ok"))
    files, scratch = _saved_files(spark, sf_dir), Scratch(spark)
    return mirror_saved(files, assets(spark, sf_dir), scratch, base_url="https://home.example/x/page.html", asked=asked).totals


def totals_of_crawl(spark, sf_dir):
    totals = _copied(spark, sf_dir).totals
    return totals.select("site", "pages_asked", "pages_done")


def sitemap_lines(spark, sf_dir):
    """The site map as a file of lines, read again."""
    path = Scratch(spark).place("sitemap")
    write_sitemap(site_map(spark, sf_dir), path, lines=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- repair


def saved_site(spark, sf_dir):
    """The given pages as the files of saved sites. Of pages with the same path the last one stays."""
    pages = given_pages(spark, sf_dir).withColumn("path", paths.page_path_tree(F.col("url")))
    last = (
        pages.groupBy("site", "path")
        .agg(F.max("page_order").alias("page_order"))
        .select("site", "path", "page_order")
    )
    return pages.join(last, ["site", "path", "page_order"], "left_semi").select("site", "path", "html")


def broken_links(spark, sf_dir):
    rows = fx_links(spark, sf_dir).withColumn("path", paths.page_path_tree(F.col("url")))
    rows = Scratch(spark).keep(rows, "links")
    files = view(spark, sf_dir, "fx_site_files")
    return linkfix.broken_links(rows, files).select("page_id", "pos", "href")


def _repaired(spark, sf_dir, **options):
    return repair_sites(
        saved_site(spark, sf_dir), Scratch(spark), replacement_url=REPLACEMENT, **options
    )


def fix_links(spark, sf_dir):
    return _repaired(spark, sf_dir).files


def fix_links_local(spark, sf_dir):
    fixes = _repaired(spark, sf_dir, use_local_fallback=True).fixes
    return fixes.groupBy("site", "path", "original", "replaced").agg(F.count(F.lit(1)).alias("n"))


def fix_report(spark, sf_dir):
    return _repaired(spark, sf_dir).report


def restore_pages(spark, sf_dir):
    done = _repaired(spark, sf_dir)
    return linkfix.restore(done.files, done.backups)


def restore_generations(spark, sf_dir):
    """Two repairs, the second of which undoes the local links of the first, and one restore from the store."""
    scratch = Scratch(spark)
    store = BackupStore(spark, scratch.place("backups"))
    first = repair_sites(saved_site(spark, sf_dir), scratch, use_local_fallback=True, store=store)
    once = scratch.keep(first.files, "repaired")
    second = repair_sites(once, scratch, replacement_url=REPLACEMENT, store=store)
    back = scratch.keep(store.restore(second.files), "restored")
    store.clear()
    return back


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "page_scan": page_scan,
    "element_counts": element_counts,
    "link_extract": link_extract,
    "link_targets": link_targets,
    "link_summary": link_summary,
    "decoded_pages": decoded_pages,
    "url_parts": url_parts,
    "url_resolve": url_resolve,
    "url_resolve_local": url_resolve_local,
    "url_normalize": url_normalize,
    "same_site_links": same_site_links,
    "crawlable_links": crawlable_links,
    "url_hash": url_hash,
    "lang_url": lang_url,
    "clean_filename": clean_filename,
    "asset_folder": asset_folder,
    "asset_path": asset_path,
    "page_path_tree": page_path_tree,
    "page_path_flat": page_path_flat,
    "relative_path": relative_path,
    "css_refs": css_refs,
    "srcset_candidates": srcset_candidates,
    "stylesheet_refs": _refs_of("css"),
    "script_refs": _refs_of("js"),
    "image_refs": _refs_of("image"),
    "image_refs_basic": _refs_of("image", "basic"),
    "icon_refs": _refs_of("icon"),
    "inline_style_refs": _refs_of("style"),
    "base_detect": base_detect,
    "ref_asset_join": ref_asset_join,
    "broken_links": broken_links,
    "fix_links": fix_links,
    "fix_links_local": fix_links_local,
    "fix_report": fix_report,
    "restore_pages": restore_pages,
    "restore_generations": restore_generations,
    "totals_of_languages": totals_of_languages,
    "totals_of_list": totals_of_list,
    "totals_of_saved": totals_of_saved,
    "totals_of_crawl": totals_of_crawl,
    "sitemap_lines": sitemap_lines,
    "css_bundle": css_bundle,
    "bundle_text": bundle_text,
    "first_of_kind": first_of_kind,
    "srcset_rewrite": srcset_rewrite,
    "css_rewrite": css_rewrite,
    "asset_rewrite": asset_rewrite,
    "asset_rewrite_single": asset_rewrite_single,
    "link_rewrite": link_rewrite,
    "crawl_bfs": crawl_bfs,
    "crawl_limited": crawl_limited,
    "sitemap": site_map,
    "sitemap_stats": sitemap_stats,
    "run_totals": run_totals,
    "saved_copy": saved_copy,
    "saved_copy_references": saved_copy_references,
    "saved_crawl": saved_crawl,
    "page_export": page_export,
    "lang_fanout": lang_fanout,
    "lang_selector": lang_selector,
    "mirror_languages": mirror_in_languages,
    "mirror_pages": mirror_page_list,
    "mirror_saved": mirror_saved_pages,
    "mirror_saved_detected": mirror_saved_detected,
    "crawl_copy": crawl_copy,
    "crawl_copy_all": crawl_copy_all,
}


def tuned(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    return run
