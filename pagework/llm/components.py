"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagework.sources.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(a, root)`` for each node that is not the smallest of its component, from edges ``(a, b)``.

    Stars are contracted in turn until nothing changes, which takes a number of rounds logarithmic in
    the size of a component. Minima are grouped aggregations with partial sums in the tasks, and what
    meets them is a plain join, so that a node with very many edges can be split at run time. Every
    round is a written table. Repeated edges and edges of a node to itself say nothing.
    """
    clean = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = scratch.keep(clean.distinct(), f"{name}_0")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, round_ = state(current), 0
    while before[0]:
        round_ += 1
        current = scratch.keep(_small_star(_large_star(current)), f"{name}_{round_}")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select("a", F.col("b").alias("root"))
