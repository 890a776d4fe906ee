"""Number of unigram pieces of a text, without making the pieces.

An Aho-Corasick automaton finds all vocabulary matches in the distinct runs of a batch of texts in one
pass; dynamic programming carries the best score and its number of pieces from position to position,
for all runs side by side. The rules are those of the unigram model of the tokenizers library behind
its space-mark pre-tokenizer: scores add up in double precision from the left; of equal scores the
match that starts first stays; where no piece covers just the next character it is unknown, at the
least score less ten; unknown characters count one for each UTF-8 byte if all byte pieces exist, and
else one for each run of them.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, free_name, map_texts
from pagework.llm.piece_model import SPACE, PieceModel, read_model
from pagework.llm.ragged import RaggedTable

UNKNOWN_PENALTY = 10.0
RUNS = 800_000
_GAP = "\n"


def space_runs(text: str) -> list[str]:
    """What the pre-tokenizer makes of a text: every space starts a run, and the text does too."""
    marked = text.replace(" ", SPACE)
    if not marked:
        return []
    return [SPACE + run for run in marked[marked[0] == SPACE :].split(SPACE)]


class PieceCounter:
    def __init__(self, model: PieceModel, runs: int = RUNS):
        import ahocorasick

        if any(_GAP in p for p in model.pieces):
            raise ValueError("a piece holds a line feed")
        self.scores = np.array(model.scores, np.float64)
        self.unknown = model.pieces.index(model.pieces[model.unknown])
        self.unknown_score = self.scores.min() - UNKNOWN_PENALTY
        known = set(model.pieces)
        self.bytes = model.byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        self.unknown_piece = model.pieces[model.unknown]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, piece in enumerate(model.pieces):
            if piece:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.table = RaggedTable(lambda runs_: [(c,) for c in self.count_runs(runs_).tolist()], runs)

    def count_runs(self, runs: list[str]) -> np.ndarray:
        """Pieces of each run. Positions of all runs stand in one row of nodes; the node after the last
        character of a run is its gap."""
        if not runs:
            return np.empty(0, np.int64)
        # A line feed inside a run would look like the end of it; a character that is in no piece
        # and has as many bytes takes its place.
        clean = [r.replace(_GAP, "\x00") if _GAP in r else r for r in runs]
        text = _GAP.join(clean) + _GAP
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        run_lengths = np.fromiter(map(len, clean), np.int64, len(clean))
        begins = np.cumsum(run_lengths + 1) - run_lengths - 1
        offset = np.arange(len(points)) - np.repeat(begins, run_lengths + 1)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        piece, end = found[:, 1], found[:, 0] + 1
        start = end - self.lengths[piece]
        single = np.zeros(len(points), bool)
        single[start[self.lengths[piece] == 1]] = True
        alone = np.nonzero(~single & (points != ord(_GAP)))[0]
        width = 1 + (points[alone] > 0x7F) + (points[alone] > 0x7FF).astype(np.int64) + (points[alone] > 0xFFFF)
        # Edges by the offset they end at, then by end, then by start: an edge's start is settled
        # before, and the first of equal edges into a node is the one that starts first.
        start, end = np.concatenate([start, alone]), np.concatenate([end, alone + 1])
        score = np.concatenate([self.scores[piece], np.full(len(alone), self.unknown_score)])
        cost = np.concatenate([np.ones(len(piece), np.int64), width if self.bytes else np.zeros(len(alone), np.int64)])
        strange = np.concatenate([piece == self.unknown, np.ones(len(alone), bool)])
        level = offset[end]
        order = np.lexsort((start, end, level))
        start, end, score, cost, strange = (x[order] for x in (start, end, score, cost, strange))
        bounds = np.searchsorted(level[order], np.arange(1, int(run_lengths.max(initial=0)) + 2))
        best, count = np.zeros(len(points)), np.zeros(len(points), np.int64)
        open_run = np.zeros(len(points), bool)  # the best way to a node ends with unknown characters
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            total = best[start[a:b]] + score[a:b]
            ends = end[a:b]
            heads = np.nonzero(np.append(True, ends[1:] != ends[:-1]))[0]
            top = np.maximum.reduceat(total, heads)
            is_top = np.nonzero(total == np.repeat(top, np.diff(np.append(heads, b - a))))[0]
            _, first = np.unique(ends[is_top], return_index=True)
            chosen = is_top[first] + a
            node = end[chosen]
            best[node] = top
            more = cost[chosen]
            if not self.bytes:
                more = np.where(strange[chosen], ~open_run[start[chosen]], more)
            count[node] = count[start[chosen]] + more
            open_run[node] = strange[chosen]
        return count[begins + run_lengths]

    def count(self, texts: list[bytes]) -> np.ndarray:
        counts, runs = self.table.encode([space_runs(t.decode("utf-8", "replace")) for t in texts])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(ends[np.concatenate([[0], np.cumsum(runs)])])


@cache
def counter(path: str) -> PieceCounter:
    """One for each worker process."""
    return PieceCounter(read_model(path))


def count_pieces(docs: DataFrame, model_path: str, *columns: str | Column, text: str = "text") -> DataFrame:
    """The given columns with ``n_pieces``. Null text counts as empty and has none; repeated rows are
    counted one each."""
    kept = docs.select(*columns)
    names = kept.columns
    raw = free_name(names)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        n = counter(model_path).count(bodies(part, raw))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64())], [*names, "n_pieces"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = docs.select(*columns, F.col(text).cast("binary").alias(raw))
    return map_texts(rows, count, fields + "n_pieces long", column=raw)
