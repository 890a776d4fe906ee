"""Fast ways beside the general ones: the same results, and no lambda where a filter would repeat it."""

import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagework.functions import markup, paths, urls
from pagework.functions.paths import TREE
from pagework.operators import elements, links, rewrite

BASES = ["https://a.b/c/d?q=1#f", "http://a.b", "https://a.b/", "https://a.b/c#x#y", "ftp://h/x", "", "https://a b/c?", None]
REFS = ["#t", "#", "#a b", "#a\tb", "mailto:x@y", "javascript:void(0)", "tel:+1", "HTTP:x", "https:y", "ab\tc:d", "java\tscript:x", "x:", " #t", "", None]


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"^[\s:+|-]*Filter ", line)]


def test_marks_and_foreign_schemes_resolve_as_by_parsing(spark):
    rows = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    parsed = urls.let(urls.split_url(F.col("b")), lambda p: urls.resolve_parts(F.col("b"), p, F.col("r")))
    found = rows.select("b", "r", urls.resolve_from(F.col("b"), urls.web_origin(F.col("b")), F.col("r")), parsed).collect()
    assert [(b, r, x) for b, r, x, _ in found] == [(b, r, x) for b, r, _, x in found]
    plain = [(b, r, x) for b, r, x, _ in found if b and r and b.startswith("http") and " " not in b and r in ("#t", "tel:+1")]
    assert plain and all(x == urljoin(b, r) for b, r, x in plain)


def test_normal_form_of_other_schemes(apply):
    given = ["mailto:x@y", "javascript:void(0)", "tel:+1", "x:", "MAILTO:x", "x:y#z", "x:y?z", "x: y", "x:y/", None, "https://a/b\t", "https://a/b/"]
    wanted = ["mailto:x@y", "javascript:void(0)", "tel:+1", "x:", "mailto:x", "x:y", "x:y?z", "x: y", "x:y", None, "https://a/b", "https://a/b"]
    assert apply(lambda u: urls.normalize(u, F.lit("https://a/")), given) == wanted


def test_plain_pages_have_the_paths_of_the_others(apply):
    given = ["https://a/b/c", "https://a/b/c.html", "https://a/b/.html", "https://a/b.c/d", "https://a/b/x.y.htm", "https://a/b//c", "https://a/b/c/", "https://a/b/c.d", "https://a", "https://a/b/c\n", None]
    wanted = ["b/c/index.html", "b/c.html", "b/.html/index.html", "b.c/d/index.html", "b/x.y.htm", "b/c/index.html", "b/c/index.html", "b/c.d.html", "index.html", "b/c/index.html", None]
    assert apply(paths.page_path_tree, given) == wanted
    deep = "https://a" + "/b" * 20_000
    assert apply(paths.page_path_tree, [deep]) == ["b/" * 20_000 + "index.html"]


def test_values_are_those_of_the_attributes(apply):
    rng = random.Random(6)
    parts = [" ", "href", "src", "=", '"', "'", "x", "&amp;", "/", "HREF=", '="y"', "\n", "<"]
    tags = ["<a " + "".join(rng.choices(parts, k=rng.randrange(12))) + ">" for _ in range(400)]
    whole = apply(lambda t: markup.attribute(markup.attributes(t), "href"), tags)
    assert apply(lambda t: markup.attribute_of(t, "href"), tags) == whole

    def staged(t):
        piece = markup.written_attribute(t, "href")
        value = urls.let(piece, lambda p: markup.value_of_written(p, F.lit("href")))
        return F.when(piece != "", markup.decode_references(value))

    assert apply(staged, tags) == whole


def test_addresses_of_links_are_made_once(spark):
    html = '<a href="/c">1</a><a href="../x/./y">2</a><a href="#t">3</a><a href="mailto:m">4</a>'
    pages = spark.createDataFrame([("a.b", "https://a.b/c/d", html)], "site string, url string, html string")
    found = links.site_links(links.page_links(pages))
    saved = spark.createDataFrame([("a.b", "https://a.b/c"), ("a.b", "https://a.b/c/d")], "site string, url string")
    edits = rewrite.link_edits(found, saved, TREE)
    # Neither the tests on a link nor that on its new address repeat what a lambda makes.
    assert not [line for line in _filters(edits) if "lambda" in line]
    assert {(r.pos, r.value) for r in edits.collect()} == {(0, "../index.html"), (3, "https://a.b/x/y")}


def test_relations_of_links(spark):
    rels = ["stylesheet", "alternate stylesheet", "icon", "shortcut icon", "shortcut  icon", "preload", "sty&#108;esheet", "", "icons", "apple-touch-icon"]
    tags = "".join(f'<link rel="{r}" href="/{i}">' for i, r in enumerate(rels))
    pages = spark.createDataFrame([("a.b", "https://a.b/", tags)], "site string, url string, html string")
    found = {r.abs_url.rsplit("/", 1)[1]: r.kind for r in elements.page_refs(pages).collect()}
    assert found == {"0": "css", "1": "css", "2": "icon", "3": "icon", "4": "icon", "6": "css"}
