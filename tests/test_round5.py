"""Work that references and made pages need, by their plans, and the cases that are decided without parsing."""

from pyspark.sql import functions as F

from pagework.functions import paths, urls
from pagework.operators import elements
from pagework.sources.scratch import Scratch
from workload import queries


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def written_plans(monkeypatch):
    """Plans of the tables that are written, by their names."""
    plans = []
    keep = Scratch.keep

    def kept(self, df, name):
        plans.append((name, plan_of(df)))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", kept)
    return plans


def made_tables(spark, folder):
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"))
    keys = {"l_suppkey": 1, "l_extendedprice": 2.0, "l_quantity": 1.0, "l_shipdate": "1995-01-01"}
    lines = spark.range(160).select(
        (F.col("id") % 40).alias("l_orderkey"),
        (F.col("id") % 16).alias("l_partkey"),
        F.floor(F.col("id") / 40).cast("int").alias("l_linenumber"),
        *[F.lit(v).alias(k) for k, v in keys.items()],
    )
    parts = spark.range(16).select(F.col("id").alias("p_partkey"), F.lit("blue ink").alias("p_name"))
    for name, df in {"orders": orders, "lineitem": lines, "part": parts}.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_made_pages_are_made_once(spark, tmp_path, monkeypatch):
    folder = made_tables(spark, tmp_path)
    plans = written_plans(monkeypatch)
    copied = queries.asset_rewrite(spark, folder)
    assert sum("l_orderkey" in plan for _, plan in plans) == 1
    assert "l_orderkey" not in plan_of(copied)
    assert copied.count() == queries.made_site_pages(spark, folder).count()


def test_made_link_pages_are_made_once(spark, tmp_path, monkeypatch):
    folder = made_tables(spark, tmp_path)
    plans = written_plans(monkeypatch)
    linked = queries.link_rewrite(spark, folder)
    assert sum("o_orderkey" in plan for _, plan in plans) == 1
    assert "o_orderkey" not in plan_of(linked)


def test_references_pass_three_generators(spark):
    row = ("s", "https://h.example/a/b?q=1", 0, '<link rel="x Stylesheet stylesheet" href="c.css"><img SRC="" src=\'//i/&#1;p.png\'>')
    refs = elements.page_refs(spark.createDataFrame([row], "site string, url string, page_order long, html string"))
    assert plan_of(refs).count("Generate") == 3
    found = {(r.slot, r.kind, r.rank, r.raw_ref, r.abs_url) for r in refs.collect()}
    assert found == {
        ("href", "css", 0, "c.css", "https://h.example/a/c.css"),
        ("src", "image", 2, "//i/p.png", "https://i/p.png"),
    }


def test_references_by_an_origin_are_those_by_a_parsed_base(apply):
    bases = ["https://h.example/a/b;x?q#f", "http://h.example", "HTTPS://H.example/a", "https://a b/c", "https://ho\tst/c", "ftp://h/x", "", None]
    refs = ["", "x", "/x", "//i/x", "//i/x?", "/./x", "http:y", "https://k/l", "?z", "#f", "/a;b", "data:x", "//", " /x", "/\x01"]
    pairs = [(b, r) for b in bases for r in refs]
    want = apply(lambda b, r: urls.resolve_parts(b, urls.split_url(b), r), pairs)
    assert apply(lambda b, r: urls.resolve_from(b, urls.web_origin(b), r), pairs) == want


def test_paths_of_web_addresses(apply):
    cases = {
        "https://h/a/b.css?x=1#f": "/a/b.css",
        "https://h/a/b;p/c;q=1": "/a/b;p/c",
        "https://h": "",
        "https://h?x=/y": "",
        "https://h/\ta": "/a",
        " https://h/a": "/a",
        "a/b.png#c": "a/b.png",
        "https://h/a#/b?c": "/a",
    }
    assert apply(paths.url_path, list(cases)) == list(cases.values())


def test_files_in_the_root_need_no_lambda(spark):
    plan = plan_of(spark.range(1).select(paths.relative_path(F.concat(F.lit("a/"), "id"), F.lit("")).alias("p")))
    assert "lambda" not in plan
