"""Sequences of numbers for the distinct words of a worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from pagework.llm.common import Memo


class RaggedTable:
    """For each distinct key a sequence of numbers, made for all new keys of a batch at once.

    Texts that are runs of keys are encoded by looking the keys up and laying their sequences end to
    end. The table starts anew beyond ``limit`` keys, so memory does not grow with the input.
    """

    def __init__(self, make: Callable[[list], list[Sequence[int]]], limit: int, dtype=np.int32):
        self.make, self.limit, self.dtype = make, limit, dtype
        self.reset()

    def reset(self) -> None:
        self.pending: list = []
        self.lengths, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)
        self.used, self.keys = 0, Memo(self._new)
        self.size = 0

    def _new(self, key) -> int:
        self.pending.append(key)
        return self.size + len(self.pending) - 1

    def _absorb(self) -> None:
        made = self.make(self.pending)
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        total = int(lengths.sum())
        flat = np.fromiter(chain.from_iterable(made), self.dtype, total)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty((self.used + total) // 2 + total, self.dtype)])
        self.flat[self.used : self.used + total] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total
        self.size, self.pending = len(self.lengths), []

    def encode(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts end to end, and how many there are of each text."""
        if self.size > self.limit:
            self.reset()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter(map(self.keys.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.pending:
            self._absorb()
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        up_to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], np.diff(up_to)
