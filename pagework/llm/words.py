"""Distinct words of a worker, and the hashed character n-grams of many words at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

from pagework.llm.common import MEMO_WORDS, Memo

_MARK = 10  # stands between words; no word holds it


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Letters:
    """The letters of the given words in lower case; everything else is left out."""

    def __init__(self, words: list[bytes]):
        joined = b"\n".join(words).decode("utf-8", "ignore").lower()
        points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "ignore"), np.uint32)
        points = points[_letters()[points] | (points == _MARK)]
        #: Code points with a mark before and after each word.
        self.points = points.astype(np.uint64)
        marks = np.nonzero(points == _MARK)[0]
        self.starts, self.lengths = marks[:-1], np.diff(marks) - 1

    def words(self) -> np.ndarray:
        """A 64-bit hash of each word's letters, 0 for a word without letters."""
        weights = np.arange(len(self.points), dtype=np.uint64)
        at = weights - np.repeat(np.append(self.starts, len(self.points) - 1), np.append(self.lengths + 1, 1)).astype(np.uint64)
        terms = mix(self.points * np.uint64(0x9E3779B97F4A7C15) + at * np.uint64(0xC2B2AE3D27D4EB4F))
        terms[self.points == _MARK] = 0
        return np.add.reduceat(terms, self.starts)

    def grams(self, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, the bucket of the n-gram that starts at each code point and whether it is
        one: marks may stand at its ends only. Grams of word k start in [starts[k], starts[k + 1])."""
        mark = self.points == _MARK
        n_points = len(self.points)
        h, valid, order = self.points.copy(), ~mark, 1
        for wanted in sorted(orders):
            while order < wanted:
                nxt = np.full(n_points, _MARK, np.uint64)
                nxt[:-order] = self.points[order:]
                h = h * np.uint64(0x100000001B3) + nxt
                if order == 1:
                    valid = np.ones(n_points, bool)
                    valid[:-1] = ~(mark[:-1] & mark[1:])
                    valid[-1] = False
                else:
                    inner = np.ones(n_points, bool)
                    inner[: -order + 1] = mark[order - 1 :]
                    valid = valid & ~inner
                    valid[n_points - order :] = False
                order += 1
            yield (mix(h + np.uint64(wanted)) % np.uint64(buckets)).astype(np.int64), valid


class WordTable:
    """Rows of numbers, one for each distinct word, made for all new words of a batch at once.

    ``make`` turns a list of words into an array with a row for each. The table starts anew when it
    has more than ``limit`` words, so that a worker's memory does not grow with its input.
    """

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], limit: int = MEMO_WORDS):
        self.make, self.limit = make, limit
        self.reset()

    def reset(self) -> None:
        self.pending: list[bytes] = []
        self.size = 0
        self.rows: np.ndarray | None = None
        self.ids = Memo(self._new)

    def _new(self, word: bytes) -> int:
        self.pending.append(word)
        return self.size + len(self.pending) - 1

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the words (separated by ASCII white space) of each text."""
        if self.size > self.limit:
            self.reset()
        encoded = [np.fromiter(map(self.ids.__getitem__, t.split()), np.int64) for t in texts]
        if self.pending:
            made = self.make(self.pending)
            need = self.size + len(made)
            if self.rows is None:
                self.rows = np.empty((max(need, 1024), *made.shape[1:]), made.dtype)
            elif len(self.rows) < need:
                grown = np.empty((need * 3 // 2, *made.shape[1:]), made.dtype)
                grown[: self.size] = self.rows[: self.size]
                self.rows = grown
            self.rows[self.size : need] = made
            self.size, self.pending = need, []
        return encoded
