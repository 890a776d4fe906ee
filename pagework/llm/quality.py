"""Quality rules: counts of each text, and robust multivariate outliers among texts of one kind.

The counts of a document become a vector of transformed statistics. For each language and source the
minimum covariance determinant (MCD) gives the centre and scatter of the bulk of the documents, and a
document far from its centre by Mahalanobis distance is rejected. Concentration steps run over all
rows: distances by built-in expressions, the h-quantile of a group from a histogram of distances, sums
and products by grouped aggregation. A group that holds a third of all rows is therefore summed by all
tasks; the tables that meet in one place have a row per group, or per group and histogram bin.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.llm.common import bodies, free_name, map_texts
from pagework.sources.scratch import Scratch

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Share of the rows of a group that the scatter is taken from.
BULK = 0.75
STEPS = 5
#: Groups with fewer rows are pooled, by language and then over all.
LEAST_ROWS = 100
#: A clean document is rejected about this often if the statistics are normal.
REJECT = 1e-6
#: Name and resolution of the statistics: a spread below the resolution counts as the resolution, so
#: that a statistic with one value in the bulk does not make every other value an outlier.
STATS = {
    "log_words": 0.35,
    "word_length": 0.35,
    "symbol_rate": 0.12,
    "dup_line_share": 0.12,
    "repeat_share": 0.05,
    "upper_share": 0.05,
    "log_distinct": 0.12,
}
_BINS = 16  # of the histogram, to a doubling of the squared distance

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")


def count_text(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text; words are separated by ASCII white space, lines by line feeds."""
    words = raw.split()
    chars = sum(len(w) for w in words)
    if not raw.isascii():
        chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    grams = list(zip(*(words[i:] for i in range(GRAM))))
    repeated = 0
    if len(grams) != len(set(grams)):
        seen, end = Counter(grams), 0
        for i, gram in enumerate(grams):
            if seen[gram] > 1:
                repeated += i + GRAM - max(i, end)
                end = i + GRAM
    return (
        len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated, len(lines), len(raw) - len(raw.translate(None, UPPER)), len(set(words)),
    )


def text_counts(docs: DataFrame, *columns: str | Column, text: str = "text") -> DataFrame:
    """The given columns with COUNTS. Null text has no words; repeated rows count one each."""
    kept = docs.select(*columns)
    names = kept.columns
    raw = free_name(names)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_text(b) for b in bodies(part, raw)]
        made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, *COUNTS])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = docs.select(*columns, F.col(text).cast("binary").alias(raw))
    return map_texts(rows, count, fields + ", ".join(f"{c} long" for c in COUNTS), column=raw)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def statistics() -> list[Column]:
    """STATS from COUNTS, each transformed to a scale on which equal steps weigh about the same."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    made = {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbol_rate": F.sqrt(F.col("n_symbols") / words),
        "dup_line_share": F.sqrt(F.col("n_dup_lines") / lines),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
        # Distinct words grow with a power of the words; what a text falls short of counts.
        "log_distinct": F.log1p("n_distinct") - F.lit(0.85) * F.log1p("n_words"),
    }
    return [made[name].cast("double").alias(name) for name in STATS]


def chi_square_quantile(p: int, q: float) -> float:
    """By the cube-root approximation of Wilson and Hilferty."""
    from statistics import NormalDist

    c = 2 / (9 * p)
    return p * (1 - c + NormalDist().inv_cdf(q) * math.sqrt(c)) ** 3


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` with ``whiten``, row by row, as one expression."""
    names = list(STATS)
    total = F.lit(0.0)
    for i in range(len(names)):
        row = F.lit(0.0)
        for j in range(i + 1):
            row += F.col("whiten")[i * len(names) + j] * (F.col(names[j]) - F.col("centre")[j])
        total += row * row
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + F.lit(1e-9)) * _BINS).cast("int")


def _whitening(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the sums of a group, its centre and the inverse of the lower root of its covariance."""
    p, floor = len(STATS), np.diag(np.square(list(STATS.values())))
    for part in groups:
        centres, roots = [], []
        for n, sums, products in zip(part["n"], part["sums"], part["products"]):
            mean = np.asarray(sums, float) / n
            cov = np.zeros((p, p))
            cov[np.tril_indices(p)] = np.asarray(products, float) / n
            cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
            root = np.linalg.inv(np.linalg.cholesky(cov + floor))
            centres.append(mean.tolist())
            roots.append(root.ravel().tolist())
        yield pd.DataFrame({"pool": part["pool"], "centre": centres, "whiten": roots})


_MODEL = "pool string, centre array<double>, whiten array<double>"


def _refit(rows: DataFrame) -> DataFrame:
    names = list(STATS)
    sums = F.array(*(F.sum(c) for c in names))
    products = F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i in range(len(names)) for j in range(i + 1)))
    per_group = rows.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), sums.alias("sums"), products.alias("products")
    )
    return per_group.mapInPandas(_whitening, _MODEL)


def _quantile_bin(binned: DataFrame, share: float, name: str) -> DataFrame:
    """Per pool the first histogram bin up to which the given share of the rows lies."""
    counts = binned.groupBy("pool", "bin").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("pool").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("pool")
    return (
        counts.withColumn("below", F.sum("n").over(up_to))
        .withColumn("rows", F.sum("n").over(whole))
        .filter(F.col("below") >= F.lit(share) * F.col("rows"))
        .groupBy("pool")
        .agg(F.min("bin").alias(name))
    )


def with_pools(rows: DataFrame, group: tuple[str, str], least: int = LEAST_ROWS) -> DataFrame:
    """Add ``pool``: the group of a row if it has enough rows, else the first part of the group, else
    one pool for the rest. A null is a value of its own."""
    first, second = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in group)
    rows = rows.withColumn("_first", first).withColumn("_second", second)
    sizes = rows.groupBy("_first", "_second").agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= least
    rest = F.sum(F.when(~enough, F.col("n")).otherwise(0)).over(Window.partitionBy("_first"))
    named = sizes.withColumn(
        "pool",
        F.when(enough, F.concat(F.lit("both "), "_first", F.lit("\x01"), "_second"))
        .when(rest >= least, F.concat(F.lit("first "), "_first"))
        .otherwise("rest"),
    ).select("_first", "_second", "pool")
    return rows.join(named, ["_first", "_second"]).drop("_first", "_second")


def mcd_distances(rows: DataFrame, scratch: Scratch, steps: int = STEPS, bulk: float = BULK) -> DataFrame:
    """Add ``distance``: squared robust Mahalanobis distance of STATS inside ``pool``, scaled so that
    half of the bulk lies below the median of chi-square. Starts from medians and quartile ranges."""
    names, p = list(STATS), len(STATS)
    quartiles = rows.groupBy("pool").agg(
        *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in names)
    )
    spread = [
        F.lit(1.0) / F.sqrt(F.pow((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(2)) + F.lit(r * r))
        for c, r in STATS.items()
    ]
    diagonal = [spread[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    model = scratch.keep(
        quartiles.select(
            "pool", F.array(*(F.col(c)[1] for c in names)).alias("centre"), F.array(*diagonal).alias("whiten")
        ),
        "mcd_0",
    )
    for step in range(1, steps + 1):
        binned = rows.join(model, "pool").withColumn("bin", _bin(_distance()))
        most = _quantile_bin(binned, bulk, "most")
        inner = binned.join(most, "pool").filter(F.col("bin") <= F.col("most"))
        model = scratch.keep(_refit(inner), f"mcd_{step}")
    measured = rows.join(model, "pool").withColumn("distance", _distance()).drop("centre", "whiten")
    middle = scratch.keep(_quantile_bin(measured.withColumn("bin", _bin(F.col("distance"))), 0.5, "middle"), "mcd_middle")
    scale = F.pow(F.lit(2.0), (F.col("middle") + 1) / F.lit(float(_BINS))) / F.lit(chi_square_quantile(p, 0.5))
    # The bulk of a tight group has distances below chi-square; its floor is the resolution.
    return measured.join(middle, "pool").withColumn("distance", F.col("distance") / F.greatest(scale, F.lit(1.0))).drop("middle")


def judge_quality(
    docs: DataFrame, scratch: Scratch, *columns: str, text: str = "text", group: tuple[str, str] = ("lang", "source"),
    reject: float = REJECT,
) -> DataFrame:
    """The given columns with COUNTS, ``base_failed``, ``distance`` and ``kept``.

    A document is kept if it passes the base rules and its distance is not above the chi-square
    quantile 1 - ``reject``. Documents that fail the base rules take no part in the estimates, and
    their distance is null. Null text counts as empty and fails; null language or source is a group of
    its own; repeated rows are judged one each; an empty table gives an empty result.
    """
    named = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    counted = text_counts(docs, *named, *groups, text=text).withColumn("base_failed", base_failed())
    counted = scratch.keep(counted.select("*", *statistics()), "quality_counts")
    keys = [f"_c{i}" for i in range(len(columns))]
    passed = scratch.keep(with_pools(counted.filter("not base_failed"), ("_g0", "_g1")), "quality_passed")
    far = mcd_distances(passed, scratch)
    failed = counted.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    limit = chi_square_quantile(len(STATS), 1 - reject)
    out = [*keys, *COUNTS, "base_failed", "distance"]
    judged = far.select(*out).unionByName(failed.select(*out))
    return judged.select(
        *(F.col(k).alias(c) for k, c in zip(keys, columns)), *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).alias("kept"),
    )
