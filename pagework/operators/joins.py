"""Equi-joins whose keys may be very unevenly used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# A key is hot if it has more rows than this ...
HOT_ROWS = 1_000_000
# ... and at most this many keys are broadcast. Every other key then holds less than a thousandth of
# the rows, which a shuffle spreads well.
HOT_KEYS = 1_000
SALTS = 4_096
# Numbers that the hashes of keys are dealt to before keys are counted by themselves.
KEY_GROUPS = 1 << 14

# Bytes that the rows of one key may have after a join before the key is split, and keys that are split.
SPLIT_BYTES = 256 * 1024 * 1024
SPLIT_KEYS = 10_000


def hot_keys_of(rows: DataFrame, on: Sequence[str], hot_rows: int, hot_keys: int) -> DataFrame:
    """The at most ``hot_keys`` most frequent keys with more than ``hot_rows`` rows.

    A hot key makes the group of its hash hot, so groups are counted first, which moves no keys. Keys are counted
    in the hot groups only; usually there are none.
    """
    group = F.pmod(F.xxhash64(*on), F.lit(KEY_GROUPS)).cast("int")
    grouped = rows.select(*on, group.alias("_group"))
    crowded = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    return (
        grouped.join(F.broadcast(crowded.select("_group")), "_group", "left_semi")
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(hot_keys)
        .select(*on)
    )


def heavy_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str], split_bytes: int = SPLIT_BYTES, split_keys: int = SPLIT_KEYS
) -> DataFrame:
    """``(*on, _salts)``: the at most ``split_keys`` heaviest keys whose joined rows have more than ``split_bytes``
    bytes of text, and into how many parts of about that size to split them.

    The weight of a key is its rows on the left times the bytes of its rows on the right. Both are narrow sums;
    of the texts only the lengths are read. A key cannot be split further than into its rows.
    """
    on = list(on)
    texts = [f.name for f in right.schema.fields if isinstance(f.dataType, (StringType, BinaryType)) and f.name not in on]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(8).cast("long"))
    uses = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_uses"))
    sizes = right.select(*on, size.alias("_size")).groupBy(*on).agg(F.sum("_size").alias("_bytes"))
    weight = F.col("_uses").cast("double") * F.col("_bytes")
    salts = F.least(F.ceil(weight / F.lit(float(split_bytes))), F.col("_uses"))
    return (
        uses.join(sizes, on)
        .withColumn("_weight", weight)
        .filter(F.col("_weight") > split_bytes)
        .orderBy(F.desc("_weight"))
        .limit(split_keys)
        .select(*on, salts.cast("int").alias("_salts"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    split_bytes: int = SPLIT_BYTES,
    split_keys: int = SPLIT_KEYS,
) -> DataFrame:
    """Inner join for payloads too big to broadcast, such as the text of a style sheet that a third
    of all sites use: the rows of a heavy key are spread over as many salts as its weight asks for and meet a copy
    of its matches each. Only the heavy keys themselves are broadcast. Both sides are read once more for
    the weights, so tables that are costly to make should be written first."""
    on = list(on)
    heavy = F.broadcast(heavy_keys(left, right, on, split_bytes, split_keys))
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    spread = left.join(heavy, on, "left").withColumn("_salt", salt).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copied = right.join(heavy, on, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return spread.join(copied, [*on, "_salt"]).drop("_salt")


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join to a table that has each key once, whatever the skew of the keys on the left.

    One style sheet or one CDN script may be referenced by a third of all pages. The matches of such
    hot keys are broadcast (at most ``hot_keys`` rows), and their rows are spread over the shuffle by
    a salt that matches nothing. All other rows take the shuffle join.
    """
    on = list(on)
    payload = [c for c in right.columns if c not in on]
    last = on[-1]
    keys = hot_keys_of(left, on, hot_rows, hot_keys)
    # The matches are found where they lie, by the few keys.
    found = right.join(F.broadcast(keys), on).select(*on, F.struct(*payload).alias("_hot_match"))
    hot = keys.join(F.broadcast(found), on, "left").withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(hot), on, "left")
    salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("string"))
    spread = marked.withColumn("_key", F.when(F.col("_hot"), salt).otherwise(F.col(last)))
    cold = right.select(*on[:-1], F.col(last).alias("_key"), F.struct(*payload).alias("_match"))
    joined = spread.join(cold, [*on[:-1], "_key"], "left")
    match = F.coalesce(F.col("_hot_match"), F.col("_match"))
    return joined.select(*left.columns, *[match[c].alias(c) for c in payload])
