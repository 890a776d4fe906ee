import glob
import random
import re
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from pagework.functions import paths
from pagework.functions.paths import FLAT, TREE
from pagework.operators import resources, variants
from pagework.operators.joins import hot_keys_of
from pagework.operators.ordering import SLICE_PAGES
from pagework.sources.scratch import Scratch
from tests.test_round5 import made_tables, plan_of
from workload import queries


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_steps_are_packed(spark):
    scratch = Scratch(spark)
    scratch.keep(spark.range(9), "rows")
    assert glob.glob(f"{scratch.folder.removeprefix('file:')}/*-rows/*.zstd.parquet")


def test_hot_keys_are_counted_in_hot_groups(spark):
    random.seed(7)
    rows = [(random.choice("ab"), random.choice([None, "x", "x", *map(str, range(40))])) for _ in range(900)]
    df = spark.createDataFrame(rows, "site string, url string")
    counts = Counter(rows)
    for hot_rows in (0, 20, 40, 10**6):
        got = {tuple(r) for r in hot_keys_of(df, ["site", "url"], hot_rows, 1000).collect()}
        assert got == {k for k, n in counts.items() if n > hot_rows}
    # The keys are not moved unless their group is hot.
    assert "hashpartitioning(_group" in executed(hot_keys_of(df, ["site", "url"], 10**6, 1000))


def test_numbered_names_equal_brute_force_and_are_moved_once(spark):
    random.seed(8)
    names = ["a.png", "a_1.png", "a_2.png", "a_1_1.png", "b.png", "c.css"]
    urls = sorted({f"https://h/{random.randint(0, 60)}/{random.choice(names)}" for _ in range(300)})
    status = {u: random.choice([200, 200, 404, None]) for u in urls}
    # Pages of several slices, and sites that share addresses.
    seen = {(s, u): random.choice([3, 5, SLICE_PAGES + 2, 3 * SLICE_PAGES]) for s in "st" for u in urls if random.random() < 0.8}
    rows = [(s, n, 0, i, 0, "css" if u.endswith("css") else "image", u) for i, ((s, u), n) in enumerate(seen.items())]
    refs = spark.createDataFrame(rows, "site string, page_order long, rank int, pos long, cand_pos long, kind string, abs_url string")
    assets = spark.createDataFrame(list(status.items()), "url string, status int")

    def expected(layout):
        ok = {u: status[u] is not None and status[u] < 400 for u in urls}
        plain, number, want = {}, Counter(), {}
        for s, n, _, i, _, kind, u in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
            name = u.rsplit("/", 1)[1]
            folder = layout.prefix + ("images" if kind == "image" else "css")
            mark = f"_{md5(u.encode()).hexdigest()[:8]}"
            stem, suffix = name.rsplit(".", 1)
            if not ok[u] and not layout.keep_failed_names:
                want[s, u] = None
                continue
            if kind == "css":
                want[s, u] = f"{folder}/{stem}{mark}.{suffix}"
                continue
            plain.setdefault(s, set()).add(name)
            want[s, u] = (folder, stem, suffix, mark, number[s, name])
            number[s, name] += 1
        for (s, u), w in want.items():
            if isinstance(w, tuple):
                folder, stem, suffix, mark, n = w
                numbered = f"{stem}_{n}.{suffix}"
                given = f"{stem}.{suffix}" if n == 0 else f"{stem}{mark}.{suffix}" if numbered in plain[s] else numbered
                want[s, u] = f"{folder}/{given}"
        return want

    for layout in (FLAT, TREE):
        named = resources.name_resources(resources.first_seen(refs), assets, layout, Scratch(spark))
        got = {(r.site, r.url): r.local_path for r in named.collect()}
        assert got == expected(layout)
        assert "Exchange hashpartitioning" not in executed(named)


def test_the_place_of_first_sight_holds_no_address(spark):
    row = ("s", 1, 0, 2, 0, "css", "https://h/a.css")
    refs = spark.createDataFrame([row], "site string, page_order long, rank int, pos long, cand_pos long, kind string, abs_url string")
    first = resources.first_seen(refs).select("first.*")
    assert first.columns == ["page_order", "rank", "pos", "cand_pos", "sub_pos", "kind"]
    assert resources.first_order("url") == [*(f"first.{c}" for c in first.columns[:-1]), "url", "first.kind"]


def test_parts_of_names_need_no_pattern(spark):
    names = ["a.b", "a", "", ".a", "..a", "..a.b", "...", "a.", "a..", ".a.b.c", "a\n.b\n", "é.ü", "a/b.c/d", "/", "/a", "a/", "a.b/c", "\U0001f600.x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    of = df.select("n", paths.stem_of(F.col("n")), paths.suffix_of(F.col("n")), paths.folder_of(F.col("n")))
    assert "regexp" not in executed(of)

    def want(n):
        if n is None:
            return None, None, None, None
        found = re.search(r"\A(\.*[^.].*)(\.[^.]*)\Z", n, re.S)
        return n, found[1] if found else n, found[2] if found else "", n.rsplit("/", 1)[0] if "/" in n else ""

    assert [tuple(r) for r in of.collect()] == [want(n) for n in names]


def test_text_of_languages_meets_its_addresses_once(spark):
    pages = [("s", "https://h/a?lang=en", 0, "A"), ("s", "https://h/a?lang=fr", 0, "B"), ("s", "https://h/b?lang=fr", 1, "C"), ("t", "https://h/a?lang=en", 2, "D")]
    pages = spark.createDataFrame(pages, "site string, url string, page_order long, html string")
    seeds = spark.createDataFrame([("s", "https://h/a"), ("s", "https://h/b"), ("t", "https://h/a"), (None, "https://h/a")], "site string, base_url string")
    found = variants.language_pages(pages, seeds, ["en", "fr"])
    joins = re.findall(r"Join (\w+)", plan_of(found))
    assert joins[0] == "Inner"
    assert sorted((r.site, r.base_url, r.lang, r.lang_no, r.html) for r in found.collect()) == [
        ("s", "https://h/a", "en", 0, "A"), ("s", "https://h/a", "fr", 1, "B"), ("t", "https://h/a", "en", 0, "D")
    ]


def test_language_pages_are_made_once(spark, tmp_path):
    assert "l_orderkey" not in plan_of(queries._own_sites(spark, made_tables(spark, tmp_path)))
