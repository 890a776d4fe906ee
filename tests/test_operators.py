import random
from collections import defaultdict

from pyspark.sql import functions as F

from pagework.operators import bundles, crawl, elements, linkfix, resources
from pagework.operators.joins import heavy_keys, lookup, salted_join
from pagework.operators.ordering import running_total
from pagework.sources.scratch import Scratch


def test_lookup_with_hot_keys_equals_a_left_join(spark):
    random.seed(1)
    left = [(i, "s", random.choice(["hot"] * 5 + ["gone"] * 5 + [f"k{j}" for j in range(9)])) for i in range(600)]
    right = [("s", f"k{j}", j) for j in range(7)] + [("s", "hot", 99), ("t", "hot", 1)]
    a = spark.createDataFrame(left, "id long, site string, url string")
    b = spark.createDataFrame(right, "site string, url string, v long")
    want = {(s, k): v for s, k, v in right}
    for hot_rows, hot_keys in ((10, 1000), (10, 1), (10**6, 1000)):
        got = lookup(a, b, ["site", "url"], hot_rows, hot_keys).collect()
        assert sorted((r.id, r.v) for r in got) == [(i, want.get((s, k))) for i, s, k in left]


def test_keys_are_split_by_their_bytes(spark):
    uses = [("often", i) for i in range(900)] + [("few", i) for i in range(3)] + [("once", 0), ("gone", 1)]
    bodies = [("often", "x" * 300, 1), ("few", "y" * 50_000, 1), ("once", "z" * 90_000, None), ("unused", "u" * 10**6, 1), ("often", None, 2)]
    a = spark.createDataFrame(uses, "url string, id int")
    b = spark.createDataFrame(bodies, "url string, content string, n int")
    assert dict(heavy_keys(a, b, ["url"], 100_000).collect()) == {"often": 3, "few": 2}
    assert dict(heavy_keys(a, b, ["url"], 10_000).collect()) == {"often": 29, "few": 3, "once": 1}
    assert dict(heavy_keys(a, b, ["url"], 10_000, 1).collect()) == {"often": 29}
    joined = salted_join(a, b, ["url"], 10_000)
    # The 900 uses of one body leave by many keys of the shuffle.
    salts = joined.filter("url = 'often'").count()
    assert salts == 1800 and joined.count() == 1800 + 3 + 1


def test_salted_join_equals_an_inner_join(spark):
    random.seed(4)
    left = [(i, random.choice(["hot"] * 5 + ["gone"] + [f"k{j}" for j in range(5)])) for i in range(400)]
    right = [("hot", 1), ("hot", 2), ("k1", 3), ("other", 4)]
    a = spark.createDataFrame(left, "id long, url string")
    b = spark.createDataFrame(right, "url string, v long")
    want = sorted((i, v) for i, k in left for u, v in right if u == k)
    for split_bytes, split_keys in ((10, 1000), (10, 1), (1, 1000), (10**9, 1000)):
        assert sorted((r.id, r.v) for r in salted_join(a, b, ["url"], split_bytes, split_keys).collect()) == want


def test_running_total_over_slices_equals_brute_force(spark):
    random.seed(2)
    rows = [(random.choice("aab"), i, random.randint(0, 5)) for i in range(500)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n long, v long").repartition(7)
    got = running_total(df, ["g"], F.floor(F.col("n") / 16), ["n"], F.col("v"), "before").collect()
    seen = defaultdict(int)
    for r in sorted(got, key=lambda r: r.n):
        assert r.before == seen[r.g]
        seen[r.g] += r.v


PAGE = """<head><link rel="alternate stylesheet" href="a.css"><link rel=stylesheet href="">
<link rel="icon" href=i.ico><link rel="apple-touch-icon" href=t.png><base href="https://b.e/x/"></head>
<script src=s.js></script><script>inline()</script><img src="1.png" srcset="2.png 1x,, 3.png  2x, data:x"
data-src='4.png'><amp-img src=5.png></amp-img><amp-anim src=6.gif></amp-anim><source src=7.mp4 srcset="8.png">
<img data-lazy-src=9.png src="data:image/png;base64,AA"><div style="background:url('10.png') url(f.woff) url(data:q)">"""


def _refs(spark, **options):
    df = spark.createDataFrame([("e", "https://e/a/b", 0, PAGE)], "site string, url string, page_order long, html string")
    if options.get("saved"):
        df = df.withColumn("base", F.lit(None).cast("string"))
    return [(r.kind, r.raw_ref, r.descriptor) for r in elements.page_refs(df, **options).orderBy("rank", "pos", "cand_pos").collect()]


def test_references_of_a_page(spark):
    assert _refs(spark) == [
        ("css", "a.css", ""), ("js", "s.js", ""), ("image", "1.png", ""), ("image", "5.png", ""),
        ("image", "6.gif", ""), ("image", "7.mp4", ""), ("image", "8.png", ""), ("image", "4.png", ""),
        ("image", "9.png", ""), ("image", "2.png", "1x"), ("image", "3.png ", "2x"),
        ("icon", "i.ico", ""), ("style", "10.png", ""),
    ]
    assert [r[1] for r in _refs(spark, profile="basic")] == ["a.css", "s.js", "1.png", "2.png", "3.png ", "i.ico"]
    assert _refs(spark, saved=True) == []


def test_base_detection(spark):
    pages = [
        ("a", '<script src="https://s/1"></script><img src="http://i/2"><link href="https://l:8/x/y">'),
        ("b", '<link href="/rel"><base href="/as/written">'),
        ("c", "<img src=x><a href=https://n/>"),
        ("d", "<amp-img src=https://m/x>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.url: r.base for r in elements.detect_base(df, ["url"]).collect()}
    assert got == {"a": "https://l:8/", "b": "/as/written", "d": "https://m/"}


def test_language_selectors(spark):
    html = '<li class="x language_selector" data-language=th><li class="language_selector2" data-language=en><li class=language_selector>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert [r.data_language for r in elements.language_selectors(df).collect()] == ["th"]


def test_image_names(spark):
    from pagework.functions.paths import FLAT, TREE

    urls = [
        ("https://c/logo_3154c924.png", 200), ("https://c/1/logo.png", 404), ("https://c/2/logo.png", 200),
        ("https://c/logo_1.png", 200), ("https://c/x/style", 200), ("https://c/3/logo.png", 200),
    ]
    refs = [("s", n, 2, 0, 0, "css" if "style" in u else "image", u) for n, (u, _) in enumerate(urls)]
    refs += [("s", 9, 2, 0, 0, "image", urls[0][0])]
    df = spark.createDataFrame(refs, "site string, page_order long, rank int, pos long, cand_pos long, kind string, abs_url string")
    assets = spark.createDataFrame(urls, "url string, status int")

    def names(layout):
        got = resources.name_resources(resources.first_seen(df), assets, layout, Scratch(spark)).collect()
        by_url = {r.url: r.local_path for r in got}
        assert {r.url: r.n_refs for r in got}[urls[0][0]] == 2
        return [by_url[u] for u, _ in urls]

    mark = lambda u: __import__("hashlib").md5(u.encode()).hexdigest()[:8]
    third, style = urls[2][0], urls[4][0]
    # The first number meets a name in use and gives way to the hash.
    assert names(FLAT) == [
        "images/logo.png", f"images/logo_{mark(urls[1][0])}.png", "images/logo_2.png", "images/logo_1.png",
        f"css/style_{mark(style)}.css", "images/logo_3.png",
    ]
    assert names(TREE) == [
        "assets/images/logo.png", None, f"assets/images/logo_{mark(third)}.png", "assets/images/logo_1.png",
        f"assets/css/style_{mark(style)}.css", "assets/images/logo_2.png",
    ]


def test_bundle_parts_join_to_the_bundle(spark):
    rows = [("s", "css", i, f"u{i}", "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "site string, kind string, chunk_order long, source_url string, chunk string")
    whole = "\n".join(r[4] for r in rows)
    for size in (50, 10**6):
        parts = sorted(bundles.bundle_parts(df, size).collect(), key=lambda r: r.part)
        assert "\n".join(p.text for p in parts) == whole
        assert (len(parts) == 1) == (size > len(whole))


BROKEN = {
    "": False, "javascript:void(0)": True, "https://x.com": False, "mailto:a@b": False, "tel:+1": False,
    "#top": False, "/": False, "/about": False, "about": False, "about.html": False, "/docs": False,
    "docs": False, "./docs": False, "/missing-page": True, "about.html#team": True, "?page=2": True,
    "//cdn.x/y.js": True, "JavaScript:void(0)": True, "../about.html": True, "docs/../about": False,
    "docs/": False, "about.html/": True, "/img/a.png": False, "img/./a.png": False, "/docs//index.html": False,
}


def test_broken_links(spark):
    files = spark.createDataFrame([("s", p) for p in ("index.html", "about.html", "docs/index.html", "img/a.png")], "site string, path string")
    links = spark.createDataFrame([("s", "docs/index.html", i, h) for i, h in enumerate(BROKEN)], "site string, path string, pos long, href string")
    got = {r.href for r in linkfix.broken_links(links, files).collect()}
    assert got == {h for h, b in BROKEN.items() if b}
    page = {r.href for r in linkfix.broken_links(links, files, resolve="page").collect()}
    assert "../about.html" not in page and "about.html" in page and "about.html#team" in page
    assert "?page=2" not in page and "/about" not in page


def _graph(spark, edges, missing=()):
    nodes = sorted({n for e in edges for n in e})
    html = {n: "".join(f'<a href="/{b}">' for a, b in edges if a == n) for n in nodes}
    rows = [("e", f"https://e/{n}", i, html[n]) for i, n in enumerate(nodes) if n not in missing]
    return spark.createDataFrame(rows, "site string, url string, page_order long, html string")


def test_crawl_equals_a_queue(spark):
    random.seed(3)
    edges = [(f"n{random.randint(0, 25)}", f"n{random.randint(0, 25)}") for _ in range(45)] + [("n0", "n1")]
    missing = {"n3", "n7"}
    pages = _graph(spark, edges, missing).repartition(5)
    seeds = spark.createDataFrame([("e", "https://e/n0#top")], "site string, base_url string")

    def expected(limit):
        seen, level, depth = {}, ["n0"], 0
        while level:
            for n in level:
                if limit is None or len(seen) < limit:
                    seen[n] = depth
            level = sorted({b for a, b in edges if a in level and a not in missing and a in seen} - set(seen))
            depth += 1
            if limit is not None and len(seen) >= limit:
                break
        return {(f"https://e/{n}", d, n not in missing) for n, d in seen.items()}

    for limit in (None, 1, 5):
        got = crawl.crawl(pages, seeds, Scratch(spark), limit)
        assert {(r.url, r.depth, r.fetched) for r in got.collect()} == expected(limit)


def test_visited_pages_stay_where_they_lie(spark):
    scratch = Scratch(spark)
    seen = scratch.bucketed("seen")
    for depth in range(3):
        rows = [(f"s{i % 3}", f"u{depth * 40 + i}", depth) for i in range(40)]
        visited = seen.append(spark.createDataFrame(rows, "site string, url string, depth int"), ["site", "url"])
    assert visited.count() == 120 and visited.filter("depth = 1").count() == 40
    reached = spark.createDataFrame([("s0", "u0"), ("s0", "u0"), ("s2", "u100"), ("s1", "new"), ("s2", "u0")], "site string, url string").distinct()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(crawl.unvisited(reached, visited).collect()) == [("s1", "new"), ("s2", "u0")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = crawl.unvisited(reached, visited)
    assert sorted(left.collect()) == [("s1", "new"), ("s2", "u0")]
    plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    scratch.drop()


def test_a_limit_is_cut_by_ranges(spark):
    rng = random.Random(3)
    rows = [("big", f"u{rng.randrange(10**6):06d}") for _ in range(3000)] + [(f"s{i % 7}", f"v{i}") for i in range(50)]
    rows = sorted(set(rows))
    taken = [("big", "x0"), ("big", "x1"), ("s1", "x"), *(("s2", f"x{i}") for i in range(9))]
    reached = spark.createDataFrame(rows, "site string, url string").repartition(6)
    visited = spark.createDataFrame(taken, "site string, url string")
    for limit in (0, 1, 5, 9, 1200, 10**6):
        got = sorted(tuple(r) for r in crawl.within_limit(reached, visited, limit, Scratch(spark)).collect())
        want = []
        for site in {s for s, _ in rows}:
            left = max(0, limit - sum(s == site for s, _ in taken))
            want += sorted(r for r in rows if r[0] == site)[:left]
        assert got == sorted(want), limit
