"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Counting runs as one distributed pass that covers every training row. The model is a matrix of
``buckets`` x languages log probabilities, so it grows with the number of languages only; it is
broadcast, and batches are scored sparsely: each distinct word of a worker is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import MEMO_WORDS, Memo, bodies, free_name, map_texts, slices, texts
from pagework.llm.words import Letters, WordTable

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    priors: np.ndarray  # (languages,)
    weights: np.ndarray  # (buckets, languages), log probabilities


class _Counter:
    """Per language, how often each distinct word came; turned into bucket counts in one go."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.totals: dict[str, np.ndarray] = {}
        self._reset()

    def _reset(self) -> None:
        self.words: list[bytes] = []
        self.ids = Memo(self._new)
        self.seen: dict[str, np.ndarray] = {}

    def _new(self, word: bytes) -> int:
        self.words.append(word)
        return len(self.words) - 1

    def add(self, langs: list[str], texts_: list[bytes]) -> None:
        parts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(langs, texts_):
            ids = np.fromiter(map(self.ids.__getitem__, text.split()), np.int64)
            parts.setdefault(lang, []).append(ids)
        for lang, ids in parts.items():
            counts = np.bincount(np.concatenate(ids), minlength=len(self.words))
            old = self.seen.get(lang)
            if old is not None:
                counts[: len(old)] += old
            self.seen[lang] = counts
        if len(self.words) > MEMO_WORDS:
            self.fold()

    def fold(self) -> None:
        if self.words:
            letters = Letters(self.words)
            owner = np.repeat(np.arange(len(self.words)), letters.lengths + 1)
            owner = np.append(owner, 0)  # nothing starts at the last mark
            for lang, counts in self.seen.items():
                each = np.pad(counts, (0, len(self.words) - len(counts))).astype(np.float64)[owner]
                total = self.totals.setdefault(lang, np.zeros(self.buckets))
                for bucket, valid in letters.grams(ORDERS, self.buckets):
                    total += np.bincount(bucket[valid], weights=each[valid], minlength=self.buckets)
        self._reset()


def fit_language_model(
    docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5
) -> LanguageModel:
    """Learn from all rows whose language is not null; null text counts as empty. Without such rows
    the model has no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, rows = _Counter(buckets), {}
        for part in slices(batches):
            langs = part.column("lang").to_pylist()
            for name in langs:
                rows[name] = rows.get(name, 0) + 1
            counter.add(langs, bodies(part))
        counter.fold()
        for name, n in rows.items():
            total = counter.totals.get(name, np.zeros(buckets))
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(at) + 1)),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(total[at], n).astype(np.int64)),
                ],
                ["lang", "bucket", "n"],
            )

    rows = texts(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), "lang")
    counted = (
        rows.filter("lang is not null")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    languages = sorted({r["lang"] for r in counted})
    at = {name: i for i, name in enumerate(languages)}
    counts, documents = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for r in counted:
        if r["bucket"] < 0:
            documents[at[r["lang"]]] = r["n"]
        else:
            counts[r["bucket"], at[r["lang"]]] = r["n"]
    smooth = counts + smoothing
    return LanguageModel(
        languages,
        np.log(np.maximum(documents, 1) / max(documents.sum(), 1)),
        np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32),
    )


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.table = WordTable(self._make)

    def _make(self, words: list[bytes]) -> np.ndarray:
        """For each word, whether it has letters, and its sum of log probabilities per language."""
        letters, weights = Letters(words), self.model.weights
        sums = np.zeros((len(letters.points), weights.shape[1] + 1), np.float32)
        for bucket, valid in letters.grams(ORDERS, weights.shape[0]):
            sums[valid, 1:] += weights[bucket[valid]]
        rows = np.add.reduceat(sums, letters.starts, axis=0)
        rows[:, 0] = letters.lengths > 0
        return rows

    def __call__(self, texts_: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, sure = [], np.zeros(len(texts_))
        for i, ids in enumerate(self.table.encode(texts_)):
            sums = self.table.rows[ids].sum(axis=0, dtype=np.float64) if len(ids) else [0]
            if not sums[0] or not self.model.languages:
                names.append(UNKNOWN)
                continue
            logs = self.model.priors + sums[1:]
            best = int(np.argmax(logs))
            names.append(self.model.languages[best])
            sure[i] = 1 / np.exp(logs - logs[best]).sum()
        return names, sure


def predict_language(
    docs: DataFrame, model: LanguageModel, *columns: str | Column, text: str = "text"
) -> DataFrame:
    """The given columns with ``lang_pred`` and ``score``, the posterior of that language.

    Null text, empty text and text without a letter: ``und`` with score 0. Of equal languages the
    first by name. Repeated rows get the same answer, one each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns)
    names = kept.columns
    raw = free_name(names)
    rows = docs.select(*columns, F.col(text).cast("binary").alias(raw))
    state: list[_Scorer] = []

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(_Scorer(held.value))
        langs, sure = state[0](bodies(part, raw))
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(sure)],
            [*names, "lang_pred", "score"],
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_texts(rows, score, f"{fields}, lang_pred string, score double", column=raw)
