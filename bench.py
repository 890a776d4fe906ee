"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pagework.session import local_session
from workload import queries
from workload.queries import QUERIES, tuned

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "link_summary",
    "url_resolve",
    "image_refs",
    "ref_asset_join",
    "broken_links",
    "fix_links",
    "asset_path",
    "css_bundle",
    "asset_rewrite",
    "link_rewrite",
    "crawl_bfs",
    "mirror_pages",
    "mirror_languages",
    "crawl_copy",
]


def spread(read, cores: int):
    """The tables of the bench are files of one row group, which one task would read and work on."""
    return lambda spark, sf_dir, name: read(spark, sf_dir, name).repartition(cores)


def main() -> None:
    queries.table = spread(queries.table, int(CPUS))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS, "16g")
    seconds: dict[str, float] = {}
    # One run on the smallest tables loads the classes, so that the figures are those of the work.
    tuned(QUERIES["fix_links"])(spark, "/root/testdata/sf0.001").count()
    for name in names:
        start = time.perf_counter()
        tuned(QUERIES[name])(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
