"""Token ids of a corpus in files: one wavelet matrix for each range of documents.

Documents are range-partitioned by id, encoded where they land, and each partition writes one file
below a shared folder. A file is written under a name of its own and then moved, so a task that runs
twice leaves the same file. Files are read back through Spark, from any store it reads.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.llm.common import Memo, bodies, slices
from pagework.llm.ragged import RaggedTable
from pagework.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from pagework.operators.ordering import running_total

#: Bytes of text for each file, about.
FILE_BYTES = 16 << 20
WORDS = 500_000
_BATCH = 2000
#: Characters that are neither letters nor digits nor white space nor part of a contraction or a special token.
_PUNCTUATION = b".,;:!?()[]{}\"*#$%&+-=/@_~^`"


class _Parts:
    """Ids of parts of words, by the number of the part, in arrays."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        mark = tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for piece, i in tokenizer.get_vocab().items():
            self.ends[i] = bool(mark) and piece.endswith(mark)
        self.reset()

    def reset(self) -> None:
        self.numbers, self.pending = Memo(self._new), []
        self.starts = self.lengths = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _new(self, part: bytes) -> int:
        self.pending.append(part)
        return len(self.starts) + len(self.pending) - 1

    def absorb(self, batch: int = _BATCH) -> None:
        """Encode the new parts: many at once, of which each ends in a piece with the end-of-word mark."""
        made, lengths = [], []
        for at in range(0, len(self.pending), batch):
            some = self.pending[at : at + batch]
            ids = self._ids(b" ".join(some))
            ends = np.nonzero(self.ends[ids])[0] + 1
            if batch > 1 and len(ends) == len(some) and ends[-1] == len(ids):
                made.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            else:  # one of them is more than one word to the pre-tokenizer
                each = [self._ids(p) for p in some]
                made += each
                lengths.append(np.array([len(e) for e in each], np.int64))
        if made:
            new = np.concatenate(lengths)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(new) - new])
            self.lengths = np.concatenate([self.lengths, new])
            self.flat = np.concatenate([self.flat, *made])
            self.pending = []

    def _ids(self, text: bytes) -> np.ndarray:
        text = text.decode("utf-8", "replace")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts end to end, and where each part's end."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        return self.flat[at], ends


def _split(word: bytes) -> tuple[bytes, ...] | None:
    """Punctuation, letters, punctuation; None if the word is not built so."""
    if word.isalpha():  # ASCII letters, whose lower case is what the normaliser makes of them
        return (word.lower(),)
    core = word.strip(_PUNCTUATION)
    if core.isalpha():
        lower = core.lower()
    elif not core:
        return (word,)
    elif core.decode("utf-8", "replace").isalpha():
        lower = core
    else:
        return None
    if len(core) == len(word):
        return (lower,)
    if word.startswith(core):
        return (lower, word[len(core) :])
    head, _, tail = word.partition(core)
    return (head, lower, tail) if tail else (head, lower)


class WordEncoder:
    """Ids of white-space separated words by a ``tokenizers`` file that drops white space.

    Words are encoded by themselves, each distinct one once. Most are letters between punctuation, which
    the pre-tokenizer splits there: letters and punctuation are then encoded apart, so that a word is known
    whatever stands beside it. Other words stay whole.
    """

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are busy with other tasks
        self.parts = _Parts(Tokenizer.from_file(path))
        self.table = RaggedTable(self._parts_of, words)

    def _parts_of(self, words: list[bytes]) -> list[tuple[int, ...]]:
        number = self.parts.numbers.__getitem__
        made, odd = [], []
        for i, word in enumerate(words):
            split = _split(word)
            if split is None:
                odd.append(i)
                made.append(())
            else:
                made.append(tuple(map(number, split)))
        self.parts.absorb()
        for i in odd:  # whole words go one by one
            made[i] = (number(words[i]),)
        self.parts.absorb(1)
        return made

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if self.table.size > self.table.limit:
            self.table.reset()
            self.parts.reset()
        numbers, counts = self.table.encode([t.split() for t in texts])
        ids, ends = self.parts.ids(numbers)
        up_to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(up_to)


@cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)


def _store(folder: str):
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the files and return one row for each: ``(shard, path, n_docs, n_tokens)``.

    Documents stand in ascending order of id, null ids first, equal ids by a hash of their text. Null
    text counts as empty: such a document has the end id alone. Repeated rows are written one each. An
    empty table has no file. Evaluate the result once: evaluating it writes the files.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("body"),
        F.xxhash64(text).alias("tie"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    files = max(1, -(-size // file_bytes))

    def write(batches):
        doc_ids, lengths, ids = [], [], []
        own = encoder(tokenizer_path)
        for part in slices(batches):
            doc_ids += part.column("doc_id").to_pylist()
            flat, counts = own.encode(bodies(part))
            ends = np.cumsum(counts)
            ids.append(np.insert(flat, ends, end_id).astype(np.uint32))
            lengths.append(counts + 1)
        if not doc_ids:
            return
        shard = TaskContext.get().partitionId()
        tokens = np.concatenate(ids)
        data = to_bytes(shard, doc_ids, np.concatenate(lengths), WaveletMatrix.build(tokens))
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        target, own_name = f"{base}/part-{shard:07d}.wvm", f"{base}/_{shard:07d}-{uuid.uuid4().hex}"
        with store.open_output_stream(own_name) as out:
            out.write(data)
        store.move(own_name, target)
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "path": target, "n_docs": len(doc_ids), "n_tokens": len(tokens)}],
            pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    ranged = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie"
    )
    return ranged.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """From the files, one row for each document: ``(doc_id, start, n_tokens, ids_crc32)``."""

    def read(batches):
        for part in batches:
            for data in part.column("content"):
                shard, doc_ids, lengths, matrix = from_bytes(data.as_py())
                raw = matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc_ids), shard)),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.wvm")
        .load(folder)
        .select("content")
        .mapInArrow(read, "shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    )
    begins = running_total(
        manifest.select(F.lit(0).alias("all"), "shard", "n_tokens"),
        ["all"],
        F.floor(F.col("shard") / (1 << 16)),
        ["shard"],
        F.col("n_tokens"),
        "begin",
    ).select("shard", "begin")
    return found.join(begins, "shard").select(
        "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
