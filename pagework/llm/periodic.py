"""Periodic runs of words: stretches that repeat a period at least a given number of times.

A run is a stretch of consecutive words of a text with smallest period q, of length max(6, 4 q) or more,
that neither neighbouring word extends. Each word of a run occurs at least four times in it. So a word that
occurs less often in a text is part of no run and splits the text, a word that occurs less often in one of
the segments splits that, and so on until nothing changes. This is done for all texts of a slice at once.

The segments that are left are scanned lag by lag. Words one lag q apart are equal over 3 q words or more of a
run with period q, so a scan needs to look at places a fraction of the lag apart only; where enough of them in
a row are equal, the run is followed word by word. A stretch that a shorter period has already is passed over:
by the theorem of Fine and Wilf it is the same run. A segment of n words takes about n log n steps.
"""

from __future__ import annotations

import bisect
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, map_texts

#: A run has at least so many periods and at least so many words.
PERIODS, LEAST = 4, 6
#: Places of a lag that are looked at.
_PLACES = 16


def frequent_segments(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Segments ``(from, to)`` of LEAST words or more in which every word occurs PERIODS times or more.
    ``ids`` are the words of all texts end to end, ``starts`` where each text begins."""
    at = np.arange(len(ids))
    segment = np.zeros(len(ids), np.int64)
    np.add.at(segment, starts[(starts > 0) & (starts < len(ids))], 1)
    segment = np.cumsum(segment)
    while len(at):
        sizes = np.bincount(segment)
        keep = sizes[segment] >= LEAST
        _, place, counts = np.unique(segment * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        keep &= counts[place] >= PERIODS
        if keep.all():
            break
        # What was next to a word that goes is next to nothing now.
        whole = np.nonzero(keep)[0]
        at, old = at[whole], segment[whole]
        breaks = np.ones(len(at), bool)
        breaks[1:] = (np.diff(at) > 1) | (np.diff(old) > 0)
        segment = np.cumsum(breaks) - 1
    if not len(at):
        return []
    firsts = np.nonzero(np.diff(segment, prepend=-1))[0]
    return [(int(at[i]), int(at[j - 1]) + 1) for i, j in zip(firsts, [*firsts[1:], len(at)])]


class Runs:
    """Runs of one segment, found by ascending period."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.periods: dict[tuple[int, int], int] = {}  # (start, end) of a run to its smallest period
        self.long: list[tuple[int, int, int, int]] = []  # (length, start, end, period), ascending

    def scan(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs, by start and period."""
        if len(self.words) >= LEAST:
            for lag in range(1, max(1, len(self.words) // PERIODS) + 1):
                self._lag(lag)
        return sorted((s, e - s, q) for (s, e), q in self.periods.items())

    def _lag(self, lag: int) -> None:
        words = self.words
        need = max(LEAST, PERIODS * lag) - lag  # equal pairs in a row that a run has at least
        step = max(1, lag // _PLACES)
        equal = words[: len(words) - lag : step] == words[lag::step]
        # Wherever a run lies, at least this many of the places fall among its equal pairs.
        in_row = need // step
        edges = np.flatnonzero(np.diff(equal, prepend=False, append=False))
        edges = edges.reshape(-1, 2)[np.diff(edges)[::2] >= in_row] * step
        if not len(edges):
            return
        # Runs too short for this lag are too short for all that follow.
        del self.long[: bisect.bisect(self.long, (PERIODS * lag,))]
        known = sorted((start, end) for _, start, end, period in self.long if lag % period == 0)
        for at in edges[:, 0].tolist():
            i = bisect.bisect(known, (at, len(words) + 1))
            # Two runs with one period share less than the period, so no others can hold the pair.
            if not any(at + lag < end for _, end in known[max(0, i - 2) : i]):
                self._follow(at, lag, need)

    def _follow(self, at: int, lag: int, need: int) -> None:
        start = at - _equal_ahead(self.words[:at][::-1], self.words[lag : at + lag][::-1])
        end = at + _equal_ahead(self.words[at : len(self.words) - lag], self.words[at + lag :])
        if end - start >= need and (start, end + lag) not in self.periods:
            self.periods[start, end + lag] = lag
            bisect.insort(self.long, (end + lag - start, start, end + lag, lag))


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first pairs are equal, found in stretches of doubling length."""
    done, size = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done : done + size] != b[done : done + size])
        if len(differ):
            return done + int(differ[0])
        done, size = min(done + size, len(a)), size * 2
    return done


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each text, given as its words."""
    numbers: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(ids):
        return out
    for a, b in frequent_segments(ids, starts):
        # Of empty texts that begin at the same place, the last one before the words holds them.
        text = int(np.searchsorted(starts, a, "right")) - 1
        shift = a - int(starts[text])
        out[text] += [(s + shift, n, q) for s, n, q in Runs(ids[a:b]).scan()]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if runs:
        drop = bytearray(len(words))
        for start, length, period in runs:
            drop[start + period : start + length] = b"\x01" * (length - period)
        words = [w for w, gone in zip(words, drop) if not gone]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, *columns: str | Column, text: str = "text") -> DataFrame:
    """The given columns with ``runs``, an array of ``(start, length, period)`` by start and period, and
    ``collapsed``, the text with one period of each run.

    Words are separated by ASCII white space and numbered from 0. Null and empty text has no words, no runs
    and an empty collapsed text. Repeated rows come out one each; an empty table gives an empty result. A
    text is worked on as a whole by one task, whatever its length.
    """
    given = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = docs.select(*(c.alias(f"_c{i}") for i, c in enumerate(given)), F.col(text).cast("binary").alias("body"))
    own = rows.columns[:-1]
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[:-1])

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        words = [b.split() for b in bodies(part)]
        found = runs_of(words)
        lengths = np.cumsum([0, *map(len, found)])
        numbers = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(numbers[:, i]) for i in range(3)], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)
        left = pa.array([collapse(w, r) for w, r in zip(words, found)], pa.binary())
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in own), runs, left], [*own, "runs", "collapsed"])

    out = map_texts(rows, find, f"{fields}runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    names = docs.select(*columns).columns
    return out.select(*(F.col(c).alias(n) for c, n in zip(own, names)), "runs", F.col("collapsed").cast("string").alias("collapsed"))
