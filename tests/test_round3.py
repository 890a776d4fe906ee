import random

from pyspark.sql import functions as F

from pagework.functions import markup, urls
from pagework.operators import crawl, elements, variants
from pagework.sources.scratch import Scratch

PIECES = [
    "href", "HREF", "href=", "href=a", "href = 'b&amp;c'", 'href="d"', "href='", 'href="', "href==x", "xhref=1", "href-x=2", "hrefé=3",
    "href='&#1;'", "href=a=b", "href=\n\"e\nf\"", "title='href=no'", "=", "/", "style=s", "href=&lt", "href=x'y", "href= ", "é=1",
]


def test_an_attribute_is_the_last_of_its_name(apply):
    rng = random.Random(3)
    tags = ["<a" + "".join(rng.choice([" ", "\n", "/", ""]) + rng.choice(PIECES) for _ in range(rng.randrange(6))) + ">" for _ in range(400)]
    slow = apply(lambda t: markup.attribute(markup.attributes(t), "href"), tags)
    assert apply(lambda t: markup.attribute_of(t, "href"), tags) == slow
    assert len(set(slow)) > 10


def test_frequent_addresses_are_normalized_like_any_other(apply):
    texts = [
        "https://a.b", "https://a.b/", "https://a.b/x/", "https://a.b/x#f", "https://a.b/x/#f", "https://a.b?q#f", "https://a.b/x?#f",
        "https://?q#f", "http://#x", "https:///x#y", "HTTP://a.b/x#y", "https://a.b/x #f", "https://a.b/x\t#f", "https://a.b/x#\t", "x#y", "", None,
    ]

    def parsed(url):
        parts = urls.split_url(url)
        whole = urls.let(parts, lambda p: urls.join_url(p["scheme"], p["netloc"], p["path"], p["query"], F.lit("")))
        plain = (url == urls.tidy(url)) & url.rlike("^https?://") & ~(url.contains("#") | url.endswith("?") | url.contains(":///"))
        kept = F.when(plain, url).otherwise(whole)
        return F.when(kept.endswith("/") & (kept != "https://a.b/"), F.substring(kept, F.lit(1), F.length(kept) - 1)).otherwise(kept)

    assert apply(lambda u: urls.normalize(u, F.lit("https://a.b/")), texts) == apply(parsed, texts)
    hosts = ["https://a.b", "https://a.b/x", "http://a b/x", "https://a\tb/x", "https://a.b?q", "HTTP://A.b/x", "x", "http:///x", "", None]
    origin = urls.let
    slow = lambda u: origin(urls.split_url(u), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], F.lit("/")))
    assert apply(urls.origin_of, hosts) == apply(slow, hosts)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_read_once(spark):
    pages = spark.createDataFrame([("s", "https://s/", 1, "<li>")], "site string, url string, page_order long, html string")
    assert _plan(variants.selector_edits(pages, ["en"])).count("zip_with") <= 2
    assert _plan(elements.detect_base(pages, ["site", "url"])).count("zip_with") <= 1


def test_a_few_seeds_do_not_move_the_links(spark):
    seeds = spark.createDataFrame([("s", "https://s/"), ("s", "https://s/")], "site string, base_url string").groupBy("site").agg(F.min("base_url").alias("base_url"))
    rows = [("s", f"https://s/{i}", i, f'<a href="/{i + 1}">x</a>') for i in range(5)]
    pages = spark.createDataFrame(rows, "site string, url string, page_order long, html string")
    made = []

    class Kept(Scratch):
        def keep(self, df, name):
            made.append(name)
            return super().keep(df, name)

    found = crawl.crawl(pages, seeds.withColumn("base_url", F.lit("https://s/0")), Kept(spark))
    assert sorted((r.url, r.fetched, r.depth) for r in found.collect()) == [(f"https://s/{i}", i < 5, i) for i in range(6)]
    assert made[0] == "seeds"
