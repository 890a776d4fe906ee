"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.session import tune

#: Bytes of text that a Python worker holds in parsed form at once.
SLICE_BYTES = 2 << 20
#: Entries of a worker's memo of words before it starts anew.
MEMO_WORDS = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators. Rows of text are long, so batches have few of them."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and the text as UTF-8 bytes in column ``body`` (null text: null). All other
    columns are left behind, so that none can clash with a column that an operator makes."""
    return docs.select(*columns, F.col(text).cast("binary").alias("body"))


def free_name(names: Iterable[str], wanted: str = "body") -> str:
    """A name for the text that none of the given columns has, whatever the case of their letters."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def crc_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(
    batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "body"
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about ``limit`` bytes in ``body``, or one row that has more."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        if first < len(sizes):
            yield batch.slice(first)


def bodies(batch: pa.RecordBatch, column: str = "body") -> list[bytes]:
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A dictionary that makes what it lacks: looked up at C speed, filled on a miss."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def map_texts(
    rows: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "body",
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply ``work`` to every slice of ``rows``, and call ``done`` at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in slices(batches, column=column):
                yield work(part)
        finally:
            if done:
                done()

    return rows.mapInArrow(run, schema)
