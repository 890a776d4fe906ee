"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read, and its normaliser, space mark, vocabulary and byte fallback are rebuilt as a
``tokenizers`` tokenizer: a unigram model gets its scores, a BPE model its merges in the order of the
scores. No piece of such a vocabulary has a space mark after another character, so a text falls into
runs of one or more space marks and what follows them, and each run is encoded by itself. A worker
encodes each distinct run once, in multithreaded batches, and checks it against the SentencePiece
library if ``verify`` is set.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.llm.common import bodies, free_name, map_texts
from pagework.llm.piece_model import BPE, CONTROL, NORMAL, SPACE, UNIGRAM, USER_DEFINED, PieceModel, read_model
from pagework.llm.ragged import RaggedTable

#: Distinct runs a worker keeps.
RUNS = 800_000
#: Threads of a worker that encodes a batch; Spark runs a worker on each core.
THREADS = 2

_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merges_in_order(model: PieceModel) -> list[tuple[str, str]]:
    """All pairs of pieces that join to a piece, best joined piece first. Pairs of one piece come in
    the order of their parts, so that the order is fixed."""
    at = {p: i for i, p in enumerate(model.pieces)}
    found = []
    for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
        if kind in (NORMAL, USER_DEFINED):
            parts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
            found += [(-model.scores[i], i, at[a], at[b], a, b) for a, b in parts if a in at and b in at]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: PieceModel):
    """Tokenizer for runs: the space marks are in the text already, see ``runs_of``."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    vocabulary = {p: i for i, p in enumerate(model.pieces)}
    if model.model_type == BPE:
        unknown = model.pieces[model.unknown]
        core = models.BPE(vocabulary, merges_in_order(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), model.unknown, model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models have a counterpart")
    tokenizer = Tokenizer(core)
    own = [AddedToken(p, normalized=False) for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


def runs_of(model: PieceModel, text: str, charsmap=None) -> list[str]:
    """The normalised text, cut before every space mark that follows another character."""
    if charsmap is not None:
        text = charsmap.normalize_str(text)
    if model.fold_spaces:
        text = " ".join(filter(None, text.split(" ")))
    if not text:
        return []
    if model.dummy_prefix and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [SPACE + w for w in text.split(" ")]
    marked = text.replace(" ", SPACE)
    return _RUNS.findall(SPACE + marked if model.dummy_prefix else marked)


class PieceCodec:
    def __init__(self, path: str, verify: bool = True, runs: int = RUNS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.model = read_model(path)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.model.pieces):
            raise ValueError("a piece goes on after a space mark; runs are not independent")
        self.tokenizer = build_tokenizer(self.model)
        self.charsmap = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self.charsmap = normalizers.Precompiled(self.model.charsmap)
        self.checker = None
        if verify:
            import sentencepiece

            self.checker = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = RaggedTable(self._encode_runs, runs)

    def _encode_runs(self, runs: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        if self.checker is not None:
            # A run starts with the mark that the checker puts before a text by itself.
            plain = [i for i, r in enumerate(runs) if r[0] == SPACE and len(r) > 1] if self.model.dummy_prefix else []
            wanted = self.checker.encode([runs[i][1:].replace(SPACE, " ") for i in plain], num_threads=1)
            for i, w in zip(plain, wanted):
                if ids[i] != w and not self.model.charsmap and not self.model.fold_spaces:
                    ids[i] = w  # the reference library decides
                    self.repaired += 1
        return ids

    repaired = 0

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the number of ids of each."""
        return self.table.encode([runs_of(self.model, t.decode("utf-8", "replace"), self.charsmap) for t in texts])

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids; control pieces say nothing."""
        silent = {i for i, k in enumerate(self.model.kinds) if k == CONTROL}
        if silent:
            ids = [[i for i in x if i not in silent] if not silent.isdisjoint(x) else x for x in ids]
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@cache
def codec(path: str, verify: bool) -> PieceCodec:
    """One for each worker process."""
    return PieceCodec(path, verify)


def encode_pieces(
    docs: DataFrame, model_path: str, *columns: str | Column, text: str = "text", verify: bool = True
) -> DataFrame:
    """The given columns with ``ids``, the piece ids of the text, and ``text_back``, the text that
    decoding them gives. Null text counts as empty and has no ids; repeated rows are encoded one each."""
    kept = docs.select(*columns)
    names = kept.columns
    raw = free_name(names)

    def encode(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path, verify)
        flat, counts = own.encode(bodies(part, raw))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        back = own.decode([flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])])
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in names), ids, pa.array(back, pa.string())], [*names, "ids", "text_back"]
        )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    rows = docs.select(*columns, F.col(text).cast("binary").alias(raw))
    # Other work may follow in the same process, so a task leaves its runs behind.
    done = lambda: codec(model_path, verify).table.reset()
    return map_texts(rows, encode, fields + "ids array<int>, text_back string", done=done, column=raw)


def decode_pieces(rows: DataFrame, model_path: str, *columns: str | Column, ids: str = "ids") -> DataFrame:
    """The given columns with ``text``, decoded from the piece ids in ``ids``; null ids give null."""
    kept = rows.select(*columns)
    names = kept.columns

    def decode(batches):
        own = codec(model_path, False)
        for part in batches:
            lists = part.column("_ids").to_pylist()
            texts = iter(own.decode([x for x in lists if x is not None]))
            back = [None if x is None else next(texts) for x in lists]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(back, pa.string())], [*names, "text"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return rows.select(*columns, F.col(ids).alias("_ids")).mapInArrow(decode, fields + "text string")


def ids_crc32(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
