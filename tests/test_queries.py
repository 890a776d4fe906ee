"""Registered queries against their SQL on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = [
    "element_counts", "link_summary", "url_resolve", "crawlable_links", "relative_path", "page_path_flat",
    "image_refs", "inline_style_refs", "base_detect", "asset_path", "css_bundle", "asset_rewrite", "fix_links",
    "broken_links", "link_rewrite", "crawl_bfs", "lang_selector",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_every_sql_text_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 50


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, DATA)
    result = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result.fetchall())
