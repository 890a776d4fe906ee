import pytest
from pyspark.sql import functions as F

from pagework.operators import linkfix
from pagework.plans.crawl_site import copy_sites
from pagework.plans.mirror import flat_names, mirror_languages, mirror_pages, mirror_saved
from pagework.plans.repair import repair_sites
from pagework.sources import scan, sinks
from pagework.sources.scratch import Scratch, scratch_root

PAGES = "site string, url string, page_order long, html string"
ASSETS = "url string, status int, content string"
FILES = "site string, path string, html string"


@pytest.fixture(scope="module")
def assets(spark):
    rows = [
        ("https://c/a.css", 200, "a{background:url(../c/bg.png)}b{src:url(f.woff)}"),
        ("https://c/b.css", 200, "b{}"),
        ("https://c/x.css", 404, ""),
        ("https://c/a.js", 200, "a();"),
        ("https://c/c/bg.png", 200, ""),
        ("https://c/bg_3154c924.png", 200, ""),
    ]
    return spark.createDataFrame(rows, ASSETS)


HEAD = (
    '<link rel="stylesheet" href="//c/a.css"><link rel=stylesheet href="https://c/x.css">'
    '<link rel="stylesheet" href="https://c/b.css"><script src="https://c/a.js"></script>'
)
BODY = '<body><img src="https://c/bg_3154c924.png" alt=x><img src=/gone.png></body>'


def test_page_list(spark, assets):
    pages = spark.createDataFrame(
        [("e", "https://e/a/x", 0, HEAD + BODY), ("e", "https://e/b/x", 1, HEAD), ("e", "https://e/", 2, "plain")], PAGES
    )
    done = mirror_pages(pages, assets, Scratch(spark))
    html = {r.path: r.html for r in done.files.collect()}
    links = (
        '<link rel="stylesheet" href="css/all-styles.css"><link rel=stylesheet href="https://c/x.css">'
        '<script src="js/all-scripts.js"></script>'
    )
    assert html["x.html"] == links + BODY.replace("https://c/bg_3154c924.png", "images/bg_1.png")
    assert html["index.html"] == "plain" and len(html) == 3
    chunks = {(r.kind, r.chunk_order): r.chunk for r in done.chunks.collect()}
    assert chunks[("css", 0)] == "\n/* Source: https://c/a.css */\na{background:url(../images/bg.png)}b{src:url(f.woff)}"
    assert chunks[("css", 1)] == "\n/* Source: https://c/b.css */\nb{}"
    assert chunks[("js", 0)] == "\n/* Source: https://c/a.js */\na();" and len(chunks) == 3
    totals = done.totals.first()
    assert (totals.pages_done, totals.attempted, totals.succeeded, totals.images_files) == (3, 7, 5, 2)


def test_single_files_without_consolidation(spark, assets):
    pages = spark.createDataFrame([("e", "https://e/a/x", 0, HEAD)], PAGES)
    done = mirror_pages(pages, assets, Scratch(spark), consolidate=False)
    html = done.files.first().html
    assert html.count("css/a_") == 1 and html.count("css/b_") == 1 and "js/a_" in html
    assert {r.path.split("_")[0] for r in done.chunks.collect()} == {"css/a", "css/b", "js/a"}


def test_flat_names_keep_the_last_page_on_demand(spark):
    pages = spark.createDataFrame([("e", "https://e/a/x", 0, ""), ("e", "https://e/b/x", 1, "")], PAGES)
    assert [(r.url, r.path) for r in flat_names(pages, "last").collect()] == [("https://e/b/x", "x.html")]


def test_saved_page(spark, assets):
    files = spark.createDataFrame(
        [("e", "index.html", '<link rel=stylesheet href="/a.css"><img src="https://c/c/bg.png">'), ("e", "no.html", "<img src=x.png>")], FILES
    )
    done = {r.path: r.html for r in mirror_saved(files, assets, Scratch(spark), base_url="https://c/q/").files.collect()}
    assert done["index.html"] == '<link rel=stylesheet href="css/all-styles.css"><img src="images/bg.png">'
    found = {r.path: r.html for r in mirror_saved(files, assets, Scratch(spark)).files.collect()}
    assert found["index.html"] == done["index.html"] and found["no.html"] == "<img src=x.png>"


def test_languages(spark, assets):
    items = '<li class="language_selector" data-language="fr">f</li><li class="language_selector" data-language="xx">x</li>'
    page = HEAD + BODY.replace("</body>", items + "</body>")
    rows = [("e", f"https://e/?lang={x}", i, page) for i, x in enumerate(["en", "fr"])]
    seeds = spark.createDataFrame([("e", "https://e/"), ("none", "https://none/")], "site string, base_url string")
    done = mirror_languages(spark.createDataFrame(rows, PAGES), seeds, assets, ["en", "fr", "de"], Scratch(spark))
    html = {r.path: r.html for r in done.files.collect()}
    assert sorted(html) == ["index-en.html", "index-fr.html", "index.html"]
    assert html["index.html"] == html["index-en.html"]
    assert "images/bg_1.png" in html["index-en.html"] and "https://c/bg_3154c924.png" in html["index-fr.html"]
    for text in html.values():
        assert text.count("all-styles.css") == 1 and text.count("all-scripts.js") == 1
        assert "onclick=\"window.location.href='index-fr.html'\" style=\"cursor: pointer;\"" in text
        assert text.count("onclick") == 1 and text.endswith("</script></body>")
    assert "https://c/x.css" in html["index-en.html"] and "https://c/x.css" not in html["index-fr.html"]


def test_crawled_site(spark, assets):
    home = HEAD + '<a href="/about#t">a</a><a href="/lost">l</a><a href="mailto:x">m</a><a href="https://o/">o</a>'
    about = '<a href="/">h</a><img src="https://c/c/bg.png" srcset="https://c/c/bg.png 1x, /gone.png 2x">'
    pages = spark.createDataFrame([("e", "https://e/", 5, home), ("e", "https://e/about/", 9, about), ("e", "https://e/alone", 1, "")], PAGES)
    seeds = spark.createDataFrame([("e", "https://e/")], "site string, base_url string")
    done = copy_sites(pages, seeds, assets, Scratch(spark))
    html = {r.path: r.html for r in done.files.collect()}
    assert sorted(html) == ["about/index.html", "index.html"]
    assert '<a href="about/index.html#t">a</a><a href="https://e/lost">l</a><a href="mailto:x">m</a><a href="https://o/">' in html["index.html"]
    assert html["index.html"].count("assets/css/all-styles.css") == 2
    assert html["about/index.html"] == (
        '<a href="../index.html">h</a><img src="../assets/images/bg.png" srcset="../assets/images/bg.png 1x, /gone.png 2x">'
    )
    assert [(r.url, r.path, r.label) for r in done.sitemap.collect()] == [
        ("https://e/", "index.html", "/ (Home)"), ("https://e/about", "about/index.html", "about"),
    ]
    stats = done.stats.first()
    assert (stats.pages, stats.resources, stats.css_files, stats.js_files) == (3, 6, 2, 1)


def test_repair_backup_and_restore(spark):
    rows = [("s", "index.html", '<a href="/docs">d</a><a class=k href=/no >n</a>'), ("s", "docs/index.html", "<a href='javascript:x'>j</a>"), ("s", "ok.html", "<a href='ok'>")]
    files = spark.createDataFrame(rows, FILES)
    done = repair_sites(files, Scratch(spark), replacement_url="https://h/?a&b")
    html = {r.path: r.html for r in done.files.collect()}
    assert html["index.html"] == '<a href="/docs">d</a><a class=k href="https://h/?a&amp;b" >n</a>'
    assert html["ok.html"] == rows[2][2]
    assert tuple(done.report.first()) == ("s", 3, 2, 2)
    again = repair_sites(done.files, Scratch(spark), replacement_url="https://h/?a&b")
    assert again.fixes.count() == 0
    back = linkfix.restore(done.files, done.backups).collect()
    assert sorted((r.site, r.path, r.html) for r in back) == sorted(rows)
    assert sum(r.restored for r in back) == 2
    local = repair_sites(files, Scratch(spark), use_local_fallback=True, backup=False)
    assert {(r.path, r.replaced) for r in local.fixes.collect()} == {("index.html", "index.html"), ("docs/index.html", "../index.html")}
    assert local.backups is None


def test_results_do_not_depend_on_partitions(spark, assets):
    rows = [("e", f"https://e/{i}", i, HEAD + f'<img src="https://c/{i % 7}/bg.png">') for i in range(30)]
    many = spark.createDataFrame([(f"https://c/{i}/bg.png", 200, "") for i in range(7)], ASSETS).unionByName(assets)
    results = []
    for n in (1, 9):
        pages = spark.createDataFrame(rows, PAGES).repartition(n, F.rand(n))
        done = mirror_pages(pages, many, Scratch(spark))
        results.append((sorted(done.files.collect()), sorted(done.chunks.collect())))
    assert results[0] == results[1]


def test_files_in_and_out(spark, tmp_path):
    root = str(tmp_path / "site")
    pages = spark.createDataFrame([("", "index.html", "<p>é</p>"), ("", "a/b.htm", "x"), ("", "a/c.txt", "y")], FILES)
    assert sinks.export_files(pages, root).count() == 0
    (tmp_path / "site" / "a" / "bad.html").write_bytes(b"a\xffb")
    found = {r.path: r.html for r in scan.scan_html_files(spark, root, "s").collect()}
    assert found == {"index.html": "<p>é</p>", "a/b.htm": "x", "a/bad.html": "ab"}
    assert {r.path for r in scan.list_files(spark, root).collect()} == {*found, "a/c.txt"}
    assert {(r.path, r.length) for r in scan.list_html_files(spark, root).collect()} == {("index.html", 9), ("a/b.htm", 1), ("a/bad.html", 3)}
    odd = spark.createDataFrame([("", "../x.html", ""), ("", "d/e.html", "e")], FILES)
    assert [tuple(r) for r in sinks.export_files(odd, root).collect()] == [("", "../x.html", "not a path inside the site")]
    assert (tmp_path / "site" / "d" / "e.html").read_text() == "e"


def test_table_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("s", "css", i, f"u{i}", f"\nc{i}") for i in range(20)], "site string, kind string, chunk_order long, source_url string, chunk string")
    out = tmp_path / "bundles"
    sinks.write_bundles(chunks.repartition(5), str(out))
    parts = sorted((out / "site=s" / "kind=css").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"\nc{i}\n" for i in range(20))
    pages = spark.createDataFrame([("s", "p", "h")], FILES)
    for by_site in (False, True):
        sinks.write_pages(pages, str(tmp_path / f"pages{by_site}"), by_site)
        assert spark.read.parquet(str(tmp_path / f"pages{by_site}")).select("site", "path", "html").collect() == pages.collect()
    fixes = spark.createDataFrame([("s", "p", 1, "a", "b")], "site string, path string, pos long, original string, replaced string")
    sinks.write_backups(pages, fixes, str(tmp_path / "backups"))
    assert spark.read.parquet(str(tmp_path / "backups")).count() == 1
    rows = spark.createDataFrame([("s", "u", "p", "l")], "site string, url string, path string, label string")
    sinks.write_sitemap(rows, str(tmp_path / "map"), lines=True)
    assert spark.read.text(str(tmp_path / "map")).first()[0] == '<li><a href="p">l</a> <span>u</span></li>'


def test_scratch_uses_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_root(spark) == (named or spark.sparkContext.getCheckpointDir())
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5), "numbers")
    assert kept.count() == 5
    scratch.drop()
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.folder}/numbers").count()
