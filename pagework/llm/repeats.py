"""Removal of repeated strings: every byte covered by a ``length``-byte string that starts twice or more.

A string of ``length`` bytes is assigned to one anchor, the ``gram``-byte string with the least hash
inside it, so equal strings meet under equal anchors wherever they start. The strings of one
anchor occurrence form a region of text. Regions whose anchor occurs once hold nothing that repeats.
Equal regions are counted, not sorted. Where regions of an anchor differ, their suffixes are sorted:

* equal window hashes inside the anchor propose candidates, and two carriers of each candidate go into
  a suffix array over words, built by grouping (``gsaca``);
* the order of all byte positions follows from it: a byte suffix is the rest of its word and the rank of
  the next word; neighbours in that order with a common prefix of ``length`` bytes confirm the candidate.

An anchor with more than ``group_limit`` different regions is not gathered in one task: its strings are
counted one by one, by anchor and hash, with partial sums in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import slices
from pagework.llm.gsaca import common_prefixes, suffix_array
from pagework.sources.scratch import Scratch

LENGTH, GRAM = 200, 32
#: Bytes of regions that a task sorts at once, and bytes of a text that are hashed at once.
SORT_BYTES, BLOCK = 4 << 20, 1 << 19
#: Different regions of an anchor that one task sorts: about as many as it sorts at once.
GROUP_LIMIT = SORT_BYTES // 256
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, of its inverse modulo 2^64, and a random value for each byte."""
    size = 4 * BLOCK + 4096
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1], np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of a buffer of at most four blocks."""

    def __init__(self, data: np.ndarray):
        up, self.down, table = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` bytes."""
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = (ends - begins).astype(np.uint64)
        return _mixed((self.sums[ends] - self.sums[begins]) * self.down[begins] + sizes * np.uint64(_BASE))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: bytes, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Regions of texts laid end to end; text i begins at ``starts[i]``. Per region: its text, the place of
    its first string, its number of strings, the hash of its anchor and a hash of its bytes."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    hashes = Hashes(raw)
    grams = hashes.all(gram)
    # Of equal grams the first in the string is its anchor: the place decides among equal high bits.
    keyed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(keyed, length - gram + 1) & _POSITION).astype(np.int64)[:n]
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    ends = np.append(starts[1:], len(raw))
    inside = np.nonzero(np.arange(n) + length <= ends[owner])[0]
    if not len(inside):
        return anchors(b"", starts, length, gram)
    anchor, owner = anchor[inside], owner[inside]
    new = np.append(True, (np.diff(anchor) != 0) | (np.diff(inside) != 1))
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(inside)))
    low, at = inside[first], anchor[first]
    region = _mixed(hashes.of(low, low + count + length - 1) + (at - low).astype(np.uint64))
    return owner[first], low, count, grams[at], region


def _blocks(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text such that every string is in exactly one."""
    for at in range(0, max(1, len(text) - length + 1), BLOCK):
        yield at, text[at : at + BLOCK + length - 1]


def _occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(anchor, region, doc_id, tie, at)``: ``at`` holds first place * 256 + number of strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BLOCK):
            texts, owners, bases = [], [], []
            for i, text in enumerate(part.column("body").to_pylist()):
                if text and len(text) >= length:
                    for base, piece in _blocks(text, length):
                        texts.append(piece)
                        owners.append(i)
                        bases.append(base)
            for some in _bounded(texts):
                sizes = [len(texts[i]) for i in some]
                starts = np.cumsum([0, *sizes[:-1]])
                text, low, count, anchor, region = anchors(b"".join(texts[i] for i in some), starts, length, gram)
                if not len(text):
                    continue
                piece = np.array(some)[text]
                place = low - starts[text] + np.array(bases)[piece]
                row = pa.array(np.array(owners)[piece])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)),
                        part.column("doc_id").take(row), part.column("tie").take(row), pa.array(place * 256 + count),
                    ],
                    ["anchor", "region", "doc_id", "tie", "at"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"anchor long, region long, doc_id {kind}, tie long, at long")


def _bounded(texts: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts in groups of at most about two blocks."""
    some, total = [], 0
    for i, text in enumerate(texts):
        if some and total + len(text) > 2 * BLOCK:
            yield some
            some, total = [], 0
        some.append(i)
        total += len(text)
    if some:
        yield some


def _is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def confirmed(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its ``length``-byte windows also start elsewhere in the strings.

    Symbols are words: every white-space byte begins one, and so does every string. The suffixes that
    begin at symbols are sorted by grouping; all byte suffixes follow from them.
    """
    data = b"".join(strings)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(sizes) - sizes
    spaces = np.nonzero(_is_space(raw))[0]
    heads = np.unique(np.concatenate([spaces, begins[sizes > 0]]))
    tails = np.append(heads[1:], len(raw))
    words = [data[a:b] for a, b in zip(heads.tolist(), tails.tolist())]
    rank = {w: i for i, w in enumerate(sorted(set(words)))}
    # Symbols with an end mark of its own after each string; marks sort before words.
    last_symbol = np.searchsorted(heads, begins + sizes)  # the symbol after a string's last
    symbols = np.fromiter(map(rank.__getitem__, words), np.int64, len(words)) + len(strings)
    text = np.insert(symbols, last_symbol, np.arange(len(strings)))
    place_of_symbol = np.arange(len(words)) + np.searchsorted(last_symbol, np.arange(len(words)), side="right")
    array = suffix_array(text)
    shared = common_prefixes(text, array)
    order = np.empty(len(text), np.int64)
    order[array] = np.arange(len(array))
    # Bytes before each place of the text; a mark has none.
    width = np.zeros(len(text), np.int64)
    width[place_of_symbol] = tails - heads
    before = np.append(0, np.cumsum(width))
    symbol_at = np.full(len(text), -1, np.int64)
    symbol_at[place_of_symbol] = np.arange(len(words))
    common = np.zeros(len(array), np.int64)
    if len(array) > 1:
        low, high, same = array[:-1], array[1:], shared[1:]
        common[1:] = before[low + same] - before[low]
        a = np.where(low + same < len(text), symbol_at[np.minimum(low + same, len(text) - 1)], -1)
        b = np.where(high + same < len(text), symbol_at[np.minimum(high + same, len(text) - 1)], -1)
        for i in np.nonzero((a >= 0) & (b >= 0) & (common[1:] < length))[0].tolist():
            x, y = words[a[i]], words[b[i]]
            if x[:1] == y[:1]:
                most = min(len(x), len(y))
                common[i + 1] += next((k for k in range(1, most) if x[k] != y[k]), most)
    # All windows: the rest of the word they start in, cut at the window, and what follows it.
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(strings)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    # Only a white-space byte ends the rest: whether a string begins there says nothing of the others.
    following = np.append(spaces, len(raw))[np.searchsorted(spaces, start)]
    rest = np.minimum(following - start, length)
    key = np.empty(len(start), np.uint64)
    for i, j, hashes, base in _hashed(raw, start, rest, length):
        key[i:j] = hashes.of(start[i:j] - base, start[i:j] - base + rest[i:j])
    after = np.zeros(len(start), np.int64)
    short = np.nonzero(rest < length)[0]
    after[short] = order[place_of_symbol[np.searchsorted(heads, following[short])]]
    sort = np.lexsort((after, key))
    found = np.zeros(len(start), bool)
    if len(sort) > 1:
        one, two = sort[:-1], sort[1:]
        near = np.nonzero(key[one] == key[two])[0]
        one, two = one[near], two[near]
        need = length - rest[one]
        equal = need <= 0
        ask = np.nonzero(~equal)[0]
        equal[ask] = _least_between(common, after[one[ask]] + 1, after[two[ask]]) >= need[ask]
        found[one[equal]] = True
        found[two[equal]] = True
    return np.split(found, np.cumsum(counts)[:-1]) if len(strings) else []


def _hashed(raw, start, rest, length) -> Iterator[tuple[int, int, Hashes, int]]:
    """Hashes that cover windows i to j, in pieces of the buffer."""
    at = 0
    while at < len(start):
        base = int(start[at])
        to = int(np.searchsorted(start, base + 2 * BLOCK))
        yield at, to, Hashes(raw[base : int(start[to - 1]) + length]), base
        at = to


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value at places low to high, both included."""
    if not len(low):
        return np.empty(0, values.dtype)
    spans = high - low + 1
    levels = np.frexp(spans.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    row = values
    for level in range(int(levels.max()) + 1):
        at = np.nonzero(levels == level)[0]
        out[at] = np.minimum(row[low[at]], row[high[at] - (1 << level) + 1])
        if len(row) > 1 << level:
            row = np.minimum(row[: -(1 << level)], row[1 << level :])
    return out


def repeated_windows(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each region, which of its windows also start elsewhere in the regions."""
    sizes = np.array([len(r) for r in regions], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return [np.zeros(c, bool) for c in counts]
    raw = np.frombuffer(b"".join(regions), np.uint8)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(regions)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = inside + begins[owner]
    key = np.empty(len(start), np.uint64)
    for i, j, hashes, base in _hashed(raw, start, None, length):
        key[i:j] = hashes.all(length)[start[i:j] - base]
    sort = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[sort]) != 0)
    heads = np.nonzero(new)[0]
    many = np.diff(np.append(heads, len(sort))) > 1
    carriers = np.sort(np.concatenate([sort[heads[many]], sort[heads[many] + 1]]))
    out = np.zeros(len(start), bool)
    if len(carriers):
        # Neighbouring carriers of a region share their bytes.
        cut = np.nonzero((np.diff(carriers) != 1) | (np.diff(owner[carriers]) != 0))[0] + 1
        runs = np.split(carriers, cut)
        flat = raw.tobytes()
        found = confirmed([flat[start[r[0]] : start[r[-1]] + length] for r in runs], length)
        true = np.zeros(len(start), bool)
        true[carriers] = np.concatenate(found)
        group = np.cumsum(new) - 1
        good = np.zeros(len(heads), bool)
        good[group[true[sort]]] = True
        out[sort] = good[group]
    return np.split(out, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[int]:
    """First place and length of each run of true, one after the other."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first, end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    return np.stack([first, end - first], axis=1).ravel().tolist()


def _sorted_regions(length: int):
    """Decide regions that come sorted by anchor, some whole anchors at a time."""

    def decide(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = [_runs(f) for f in repeated_windows([r[2] for r in rows], length)]
        kept = [(r[0], r[1], f) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in kept], pa.int64()),
                pa.array([k[1] for k in kept], pa.int64()),
                pa.array([k[2] for k in kept], pa.list_(pa.int32())),
            ],
            ["anchor", "region", "runs"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        total = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", "body"))):
                if total > SORT_BYTES and row[0] != rows[-1][0]:
                    yield decide(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[2])
        if rows:
            yield decide(rows)

    return work


def _window_hashes(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            keys = [Hashes(np.frombuffer(b, np.uint8)).all(length) for b in bodies]
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("anchor").take(row),
                    batch.column("region").take(row),
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])),
                ],
                ["anchor", "region", "window", "place"],
            )

    return work


def _regions_of_texts(length: int):
    """Text of the regions that are named for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple[int, int, bool, bytes]] = []
            for text, wanted in zip(part.column("body").to_pylist(), part.column("wanted").to_pylist()):
                for w in wanted:
                    low, count = divmod(w["at"], 256)
                    out.append((w["anchor"], w["region"], w["crowded"], text[low : low + count + length - 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.bool_()), pa.array([o[3] for o in out], pa.binary()),
                ],
                ["anchor", "region", "crowded", "body"],
            )

    return work


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).cast("binary").alias("body")
    )


def repeated_spans(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    gram: int = GRAM, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``(doc_id, tie, spans)``: for each document with repeats, its repeated strings as pairs of first
    place and number of strings one after the other, in any order; ``tie`` is a hash of its text."""
    rows = _rows(docs, doc_id, text).filter(F.octet_length("body") >= length)
    found = scratch.keep(_occurrences(rows, length, gram), "occurrences")
    repeated = scratch.keep(
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), (F.min("region") == F.max("region")).alias("alike"))
        .filter("n > 1")
        .select("anchor", "alike"),
        "repeated",
    )
    kept = scratch.keep(found.join(repeated, "anchor"), "kept")
    mixed = kept.filter("not alike")
    regions = scratch.keep(
        mixed.groupBy("anchor", "region").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("tie", "at", "doc_id")).alias("first")
        ),
        "regions",
    )
    crowded = regions.groupBy("anchor").agg((F.count(F.lit(1)) > group_limit).alias("crowded"))
    wanted = (
        regions.join(crowded, "anchor")
        .groupBy(F.col("first.doc_id").alias("_id"), F.col("first.tie").alias("_tie"))
        .agg(F.collect_list(F.struct("anchor", "region", "crowded", F.col("first.at").alias("at"))).alias("wanted"))
    )
    # Rows with equal id and text are one here: any of them has the bytes.
    texts = scratch.keep(
        rows.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .select("body", "wanted")
        .mapInArrow(_regions_of_texts(length), "anchor long, region long, crowded boolean, body binary"),
        "texts",
    )
    sorted_ = (
        texts.filter("not crowded")
        .select("anchor", "region", "body")
        .dropDuplicates(["anchor", "region"])
        .repartition("anchor")
        .sortWithinPartitions("anchor", "region")
        .mapInArrow(_sorted_regions(length), "anchor long, region long, runs array<int>")
    )
    windows = (
        texts.filter("crowded")
        .select("anchor", "region", "body")
        .dropDuplicates(["anchor", "region"])
        .mapInArrow(_window_hashes(length), "anchor long, region long, window long, place int")
    )
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = (
        windows.join(twice, ["anchor", "window"], "left_semi")
        .groupBy("anchor", "region")
        .agg(F.collect_list("place").alias("places"))
        .select("anchor", "region", F.flatten(F.transform("places", lambda p: F.array(p, F.lit(1)))).alias("runs"))
    )
    parts = scratch.keep(sorted_, "sorted").unionByName(scratch.keep(counted, "counted"))
    verdicts = (
        regions.select("anchor", "region", (F.col("n") > 1).alias("whole"))
        .join(parts, ["anchor", "region"], "left")
        .filter(F.col("whole") | F.col("runs").isNotNull())
    )
    low, count = F.floor(F.col("at") / 256).cast("long"), (F.col("at") % 256).cast("int")
    all_of_it = F.array(F.struct(low.alias("low"), count.alias("count")))
    some_of_it = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
        lambda i: F.struct(
            (low + F.element_at("runs", i + 1)).alias("low"), F.element_at("runs", i + 2).alias("count")
        ),
    )
    decided = (
        mixed.join(verdicts, ["anchor", "region"])
        .select("doc_id", "tie", F.when(F.col("whole"), all_of_it).otherwise(some_of_it).alias("spans"))
        .unionByName(kept.filter("alike").select("doc_id", "tie", all_of_it.alias("spans")))
    )
    return decided.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal covered runs of bytes as first and end, from runs of strings as first and number."""
    out: list[tuple[int, int]] = []
    for low, count in sorted(spans):
        end = low + count - 1 + length
        if out and low <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((low, end))
    return out


def remove_repeats(
    docs: DataFrame, scratch: Scratch, *columns: str | Column, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT, as_text: bool = False,
) -> DataFrame:
    """The given columns with ``n_bytes``, ``n_removed``, ``removed`` (first and end of each maximal run of
    removed bytes) and ``kept``, the remaining bytes. ``as_text`` makes ``kept`` a string, from which parts
    of characters that were cut in two are left out.

    Null text counts as empty; texts shorter than ``length`` stay as they are. Rows are documents: of
    repeated rows each is a copy of the other. Null ids are ids like any other.
    """
    spans = scratch.keep(repeated_spans(docs, scratch, doc_id, text, length, gram, group_limit), "spans")
    own = [F.col(c) if isinstance(c, str) else c for c in columns]
    shown = docs.select(*own)
    names = [f"_c{i}" for i in range(len(own))]
    rows = docs.select(
        *(c.alias(n) for c, n in zip(own, names)), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_tie"),
        F.col(text).cast("binary").alias("body"),
    )
    joined = rows.join(
        spans.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie")), "left"
    ).select(*names, "body", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, gone, runs, rest = [], [], [], []
            for body, found in zip(part.column("body").to_pylist(), part.column("spans").to_pylist()):
                body = body or b""
                run = covered([(s["low"], s["count"]) for s in found or ()], length)
                ends = [0, *(e for _, e in run)]
                begins = [*(b for b, _ in run), len(body)]
                rest.append(b"".join(body[a:b] for a, b in zip(ends, begins)) if run else body)
                sizes.append(len(body))
                gone.append(len(body) - len(rest[-1]))
                runs.append([{"first": b, "end": e} for b, e in run])
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(n) for n in names), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array([r.decode("utf-8", "ignore") for r in rest], pa.string()) if as_text else pa.array(rest, pa.binary()),
                ],
                [*names, "n_bytes", "n_removed", "removed", "kept"],
            )

    fields = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, shown.schema))
    kept = "string" if as_text else "binary"
    done = joined.mapInArrow(
        cut, fields + f"n_bytes long, n_removed long, removed array<struct<first: long, end: long>>, kept {kept}"
    )
    return done.select(
        *(F.col(n).alias(f.name) for n, f in zip(names, shown.schema)), "n_bytes", "n_removed", "removed", "kept"
    )
