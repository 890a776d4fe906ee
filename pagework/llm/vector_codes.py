"""Compression of vectors to short codes, one byte for each of a few equal parts.

Components are scaled and floored to integers, so all arithmetic is exact and no order of summation
matters. The vectors are cut once into blocks of rows, written as dictionaries: for each dimension the
distinct integers of the block, and for each row the place of its integer among them. A round tabulates,
for each dimension of a block, the squared differences of every distinct integer to all entries of the
codebook; the distances of a row to all entries are then rows of these tables, gathered by code and added.
A new entry is the mean of its parts, whose sums are a histogram of codes times the dictionary.

Blocks have a bounded number of components, codebooks a bounded number of entries, and a task hands on one
row of sums for each entry, so nothing grows with the table but the blocks themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.operators.joins import lookup
from pagework.sources.scratch import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of a block; a vector with more is a block of its own.
BLOCK_VALUES = 1 << 19
#: Rows of a table of squares that are gathered at once.
_STEP = 1024
#: Integers beyond this bound (of either sign) could overflow sums of squares.
LIMIT = 1 << 25
#: Distinct labels that may be broadcast with their sums.
LABELS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Components times SCALE, floored, a row for each vector."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (lengths != dims).any():
        raise ValueError(f"vectors of {sorted({dims, *lengths.tolist()})} components in one table")
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT / SCALE:g} are too large for exact sums of squares")
    return scaled.astype(np.int64).reshape(len(vectors), dims)


class Block:
    """Rows of integers as a dictionary for each dimension and codes into it."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        #: Distinct integers of each dimension, ascending; codes[d, i] is the place of row i's integer.
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, rows: np.ndarray) -> Block:
        pairs = [np.unique(column, return_inverse=True) for column in rows.T]
        return cls([v for v, _ in pairs], np.array([c.ravel() for _, c in pairs], np.uint32).reshape(rows.shape[::-1]))

    @property
    def rows(self) -> int:
        return self.codes.shape[1]

    def dump(self) -> tuple[list[int], bytes, bytes]:
        """Sizes of the dictionaries, the dictionaries and the codes; codes take two bytes if they can."""
        sizes = [len(v) for v in self.values]
        kind = np.uint16 if max(sizes, default=0) <= 1 << 16 else np.uint32
        flat = np.concatenate(self.values) if self.values else np.empty(0, np.int64)
        return sizes, flat.astype("<i4").tobytes(), self.codes.astype(kind).tobytes()

    @classmethod
    def load(cls, n: int, sizes: list[int], flat: bytes, codes: bytes) -> Block:
        kind = np.uint16 if max(sizes, default=0) <= 1 << 16 else np.uint32
        values = np.split(np.frombuffer(flat, "<i4").astype(np.int64), np.cumsum(sizes)[:-1])
        return cls(values, np.frombuffer(codes, kind).reshape(len(sizes), n))

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part and row the nearest entry of the part's codebook, ties to the lower index, and the
        squared distance to it. ``books[part, entry, position]``."""
        parts, entries, width = books.shape
        index = np.zeros((parts, self.rows), np.int64)
        error = np.zeros((parts, self.rows), np.int64)
        for part in range(parts if width else 0):
            own = range(part * width, (part + 1) * width)
            least = min(min(int(self.values[d][0]) for d in own), int(books[part].min()))
            most = max(max(int(self.values[d][-1]) for d in own), int(books[part].max()))
            kind = np.int32 if width * (most - least) ** 2 < 1 << 31 else np.int64
            total, gathered = np.zeros((self.rows, entries), kind), np.empty((_STEP, entries), kind)
            for position, d in enumerate(own):
                gap = (self.values[d][:, None] - books[part][None, :, position]).astype(kind)
                squares = gap * gap
                for at in range(0, self.rows, _STEP):
                    part_of = total[at : at + _STEP]
                    codes = self.codes[d, at : at + _STEP]
                    part_of += np.take(squares, codes, axis=0, out=gathered[: len(codes)], mode="clip")
            index[part] = total.argmin(axis=1)
            error[part] = total[np.arange(self.rows), index[part]]
        return index, error

    def add(self, index: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the rows' parts to the counts and sums of the entries that ``index`` gives them."""
        parts, entries, width = sums.shape
        for part in range(parts):
            counts[part] += np.bincount(index[part], minlength=entries)
            for position in range(width):
                d = part * width + position
                size = len(self.values[d])
                seen = np.bincount(index[part] * size + self.codes[d], minlength=entries * size)
                sums[part, :, position] += seen.reshape(entries, size) @ self.values[d]


_BLOCKS = "n int, sizes array<int>, dictionary binary, codes binary"


def to_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """``(kept, n, sizes, dictionary, codes)`` from ``(row, vector)``: blocks of the rows of a task."""
    limit = max(1, BLOCK_VALUES // max(dims, 1))
    kept_type = rows.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            kept = whole.column("row").chunk(0)
            sizes, flat, codes = Block.of(_integers(whole.column("vector").chunk(0), dims)).dump()
            rows_ = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
            made = [rows_, pa.array([len(kept)], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), pa.array([flat]), pa.array([codes])]
            return pa.RecordBatch.from_arrays(made, ["kept", "n", "sizes", "dictionary", "codes"])

        for batch in batches:
            while batch.num_rows:
                waiting.append(batch.slice(0, limit - n))
                n, batch = n + waiting[-1].num_rows, batch.slice(limit - n)
                if n == limit:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    return rows.mapInArrow(cut, f"kept array<{kept_type}>, {_BLOCKS}")


def _loaded(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        yield Block.load(*(batch.column(c)[i].as_py() for c in ("n", "sizes", "dictionary", "codes")))


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floored mean of the parts nearest to it, and an
    entry without parts stays."""
    parts, entries, width = books.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for block in _loaded(batch):
                block.add(block.nearest(books)[0], counts, sums)
        part, entry = np.nonzero(counts)
        vectors = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
        made = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), vectors]
        yield pa.RecordBatch.from_arrays(made, ["part", "entry", "n", "sums"])

    partial = blocks.drop("kept").mapInArrow(total, "part int, entry int, n long, sums array<long>")
    columns = F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))
    # One row for each entry: parts x entries, whatever the table holds.
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), columns.alias("sums")).collect()
    refined = books.copy()
    for r in summed:
        refined[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return refined


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(row, code, error)`` of all rows: entry numbers as two hex digits a part, and squared distances."""
    row_type = blocks.schema["kept"].dataType.elementType.simpleString()
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_loaded(batch)):
                index, error = block.nearest(books)
                code = digits[index[0]]
                for other in index[1:]:
                    code = np.char.add(code, digits[other])
                rows = batch.column("kept").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows, pa.array(code.tolist(), pa.string()), pa.array(error.sum(axis=0))], ["row", "code", "error"])

    return blocks.mapInArrow(run, f"row {row_type}, code string, error long")


def codebooks_text(books: np.ndarray) -> str:
    """All integers of the codebooks by part, entry and position within the part."""
    return ",".join(map(str, books.ravel().tolist()))


def with_label_error(coded: DataFrame, label: Column, scratch: Scratch) -> DataFrame:
    """Add ``label_error``: the errors of all rows with an equal label, nulls together. Sums of few labels are
    broadcast; of many, the frequent ones are and the rest are joined."""
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit("")))
    sums = scratch.keep(keyed.groupBy("_label").agg(F.sum("error").alias("label_error")), "label_sums")
    if sums.count() <= LABELS:
        joined = keyed.join(F.broadcast(sums), "_label")
    else:
        joined = lookup(keyed, sums, ["_label"])
    return joined.drop("_label")


def compress_vectors(
    rows: DataFrame, scratch: Scratch, *columns: str, vec_id: str = "vec_id", vector: str = "embedding",
    label: str = "label", rounds: int = ROUNDS,
) -> DataFrame:
    """The given columns with ``code``, ``error``, ``label_error`` and ``codebooks``.

    Rows are left out if their vector is null or has a null or non-finite component. Codebooks start with
    the rows of the smallest ids, null ids last; of equal ids the one with the smaller vector is first, and
    repeated rows count one each. A table with fewer rows than entries has as many entries. Equal labels are
    equal as text, nulls are one label. An empty table gives an empty result. Vectors of different lengths,
    lengths that the parts do not divide, and components beyond 32,768 raise a ValueError.
    """
    named = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    kept = rows.filter(usable(F.col(vector))).select(
        F.struct(*named, F.col(label).alias("_l")).alias("row"),
        F.col(vec_id).alias("_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    starts = kept.orderBy(F.asc_nulls_last("_id"), "vector").limit(ENTRIES).select("vector").collect()
    dims = len(starts[0]["vector"]) if starts else 0
    if dims % PARTS:
        raise ValueError(f"{dims} components cannot be cut into {PARTS} equal parts")
    first = _integers(pa.array([r["vector"] for r in starts], pa.list_(pa.float64())), dims)
    books = np.ascontiguousarray(first.reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2))
    blocks = scratch.keep(to_blocks(kept.select("row", "vector"), dims), "vector_blocks")
    for _ in range(rounds if dims else 0):
        books = refine(blocks, books)
    coded = scratch.keep(assign(blocks, books).select("row", "code", "error"), "vector_codes")
    measured = with_label_error(coded, F.col("row._l"), scratch)
    return measured.select(
        *(F.col(f"row._c{i}").alias(c) for i, c in enumerate(columns)), "code", "error", "label_error",
        F.lit(codebooks_text(books)).alias("codebooks"),
    )
