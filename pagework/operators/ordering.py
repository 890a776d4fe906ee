"""Running totals and numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.sources.scratch import Scratch

# Pages per slice of an order that starts with a page number.
SLICE_PAGES = 1 << 16


def page_slice(page_order: Column) -> Column:
    return F.floor(page_order / F.lit(SLICE_PAGES)).cast("long")


def running_total(
    rows: DataFrame,
    group: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    amount: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the earlier rows of the group (0 for the first).

    ``slice_by`` must not decrease along ``order``. Each slice is summed by itself and only one total
    per slice meets in one place, so a group that holds a third of all rows still runs in parallel.
    """
    group = list(group)
    sliced = rows.withColumn("_slice", slice_by).withColumn("_amount", amount.cast("long"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sliced.groupBy(*group, "_slice")
        .agg(F.sum("_amount").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")))
        .filter(F.col("_before") > 0)
        .drop("_total")
    )
    local = F.coalesce(F.sum("_amount").over(inside), F.lit(0).cast("long"))
    return (
        sliced.withColumn("_local", local)
        .join(totals, [*group, "_slice"], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0).cast("long")))
        .select(*rows.columns, out)
    )


def number_rows(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """Add ``number``: a dense number of the rows in the given order, from 0.

    Rows are range-partitioned once and written, so the slices are fixed; only the number of rows per
    slice is summed in one place.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_n", F.row_number().over(inside) - 1)
        .join(starts, "_part")
        .withColumn("number", (F.col("_start") + F.col("_n")).cast("long"))
        .drop("_part", "_n", "_start")
    )
