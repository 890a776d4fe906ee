"""Paths, assets, backups, scratch tables and totals that two rows may claim."""

from pyspark.sql import functions as F

from pagework.functions.paths import page_path_tree
from pagework.operators.linkfix import backups_of
from pagework.operators.resources import best_status, body_of
from pagework.plans.crawl_site import copy_sites
from pagework.plans.mirror import mirror_pages, mirror_saved
from pagework.sources.scratch import Scratch
from pagework.sources.sinks import write_backups

PAGES = "site string, url string, page_order long, html string"
ASSETS = "url string, status int, content string"


def test_two_pages_of_one_path_keep_both(spark):
    root = "https://e.example"
    pages = [
        ("e.example", f"{root}/", 0, '<a href="/about">1</a><a href="/about/index.html">2</a>'),
        ("e.example", f"{root}/about", 1, "first"),
        ("e.example", f"{root}/about/index.html", 2, "second"),
    ]
    seeds = spark.createDataFrame([("e.example", f"{root}/")], "site string, base_url string")
    copy = copy_sites(spark.createDataFrame(pages, PAGES), seeds, spark.createDataFrame([], ASSETS), Scratch(spark))
    files = {r.path: r.html for r in copy.files.collect()}
    assert len(files) == 3 and {"first", "second"} <= set(files.values())
    assert files["about/index.html"] == "first"
    other = next(p for p, html in files.items() if html == "second")
    assert f'href="{other}"' in files["index.html"] and 'href="about/index.html"' in files["index.html"]
    assert {r.path for r in copy.sitemap.collect()} == set(files)


def test_repeated_assets_count_once(spark):
    rows = [("u", 404, None), ("u", 200, "b"), ("u", 200, "a"), ("v", None, None), ("w", 200, "x")]
    assets = spark.createDataFrame(rows, ASSETS)
    assert sorted((r.url, r.status) for r in best_status(assets).collect()) == [("u", 200), ("v", None), ("w", 200)]
    wanted = spark.createDataFrame([("u",), ("v",), ("w",), ("w",)], "url string")
    assert sorted(map(tuple, body_of(assets, wanted).collect())) == [("u", "a"), ("w", "x")]
    page = [("e", "https://e/", 0, '<img src="https://c/a.png">')]
    twice = spark.createDataFrame([("https://c/a.png", 404, ""), ("https://c/a.png", 200, "")], ASSETS)
    done = mirror_pages(spark.createDataFrame(page, PAGES), twice, Scratch(spark))
    assert [r.local_path for r in done.resources.collect()] == ["images/a.png"]
    assert 'src="images/a.png"' in done.files.first().html


def test_backups_of_earlier_runs_stay(spark, tmp_path):
    files = spark.createDataFrame([("s", "a.html", "A"), ("s", "b.html", "B")], "site string, path string, html string")

    def fixes(path):
        return spark.createDataFrame([("s", path, 0, "x", "y")], "site string, path string, pos long, original string, replaced string")

    write_backups(files, fixes("a.html"), f"{tmp_path}/1")
    write_backups(files, fixes("b.html"), f"{tmp_path}/2", earlier=f"{tmp_path}/1")
    assert sorted(r.path for r in spark.read.parquet(f"{tmp_path}/2").collect()) == ["a.html", "b.html"]
    assert backups_of(files, fixes("a.html")).count() == 1


def test_jobs_share_a_scratch(spark):
    scratch = Scratch(spark)
    first = scratch.keep(spark.range(3), "same")
    scratch.keep(spark.range(5), "same")
    assert first.count() == 3
    bucketed = scratch.keep_bucketed(spark.range(50).withColumn("k", F.col("id") % 7), "b", ["k"])
    assert bucketed.count() == 50
    scratch.drop()


def test_failed_pages_count_as_asked(spark):
    pages = spark.createDataFrame([("e", "https://e/", 0, "x")], PAGES)
    asked = spark.createDataFrame([("e", True), ("e", False)], "site string, ok boolean")
    done = mirror_pages(pages, spark.createDataFrame([], ASSETS), Scratch(spark), asked=asked)
    total = done.totals.first()
    assert (total.pages_asked, total.pages_done) == (2, 1)


def test_paths_fold_double_slashes(spark):
    row = spark.createDataFrame([("https://e.example/a//b",)], "u string").select(page_path_tree(F.col("u"))).first()
    assert row[0] == "a/b/index.html"


def test_saved_pages_do_not_depend_on_partitions(spark):
    html = "<link rel=stylesheet href=https://c/{0}.css><img src=https://c/{0}/logo.png><img src=https://d/{0}/logo.png>"
    rows = [("s", f"p{i:02d}.html", html.format(i % 7)) for i in range(20)]
    files = spark.createDataFrame(rows, "site string, path string, html string")
    assets = [(f"https://{h}/{i}/logo.png", 200, "") for h in "cd" for i in range(7)]
    assets += [(f"https://c/{i}.css", 200, f".c{i}{{}}") for i in range(7)]
    assets = spark.createDataFrame(assets, ASSETS)
    seen = []
    for n in (1, 3, 7):
        done = mirror_saved(files.repartition(n, F.xxhash64("path")), assets, Scratch(spark), base_url="https://c/")
        seen.append(
            (
                sorted(map(tuple, done.files.collect())),
                sorted(map(tuple, done.chunks.select("site", "kind", "chunk_order", "source_url", "chunk").collect())),
                sorted((r.url, r.local_path) for r in done.resources.collect()),
            )
        )
    assert seen[0] == seen[1] == seen[2]
    assert len({p for _, p in seen[0][2]}) == 21


def test_frequent_references_resolve_like_any_other(apply):
    from urllib.parse import urljoin

    from pagework.functions.urls import resolve, resolve_parts, split_url

    refs = [
        "https://a.b", "https://a.b?x", "http://A.b/C d", "HTTP://X/y", "https://x/y?", "https://x/y#", "https://x/a/../b",
        "https://x/y?q#f", "/x", "/x?", "/x#", "/x?a=1#b", "/.hidden", "/a/./b", "/a/../b", "/a;p", "/a?x;y", "//h/x", "/", "/a.b/c.",
        "x", "", "https:///x", "http:x", "/a b", " /x", "https://u:p@h:1/x", "/für",
    ]
    bases = ["https://e.example/p/1?q", "http://e.example", "https://e.example/a/b/", "ftp://e.example/x"]
    pairs = [(b, r) for b in bases for r in refs]
    wanted = [urljoin(b, r) for b, r in pairs]
    assert apply(resolve, pairs) == wanted
    assert apply(lambda b, r: resolve_parts(b, split_url(b), r), pairs) == wanted
