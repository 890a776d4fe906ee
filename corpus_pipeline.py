"""Preparation of a corpus of documents in stages, each one an operator of the corpus subpackage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that ``run`` writes and reads again. All
but the last keep the columns of documents; a stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.llm.common import crc_remainder, prepare, table
from pagework.llm.decontaminate import contaminated
from pagework.llm.piece_codec import encode_pieces
from pagework.llm.queries import PIECE_MODEL, TOXIC_FROM, tokenizer_path
from pagework.llm.repeats import remove_repeats
from pagework.llm.simhash import RADIUS, representatives
from pagework.llm.toxicity import fit_toxicity, score_toxicity
from pagework.sources.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. The network learns from the labelled ones that op2 learns
    from. Null text counts as empty and stays."""
    prepare(spark)
    learn = docs.filter(crc_remainder(F.col("doc_id"), 3) != 1)
    net = fit_toxicity(learn, table(spark, sf_dir, "labels"))
    names = docs.columns
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]
    scored = score_toxicity(docs, net, *columns, given=f"_c{names.index('text')}")
    kept = scored.filter(F.col("score") < TOXIC_FROM)
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that op1 links, by its shingles and its bit distance: the one with the
    least id, of equal ids the one with the least hash of its text, of repeated rows one. Rows without id
    come last."""
    prepare(spark)
    scratch = Scratch(spark)
    first = Scratch(spark).keep(representatives(docs, scratch, radius=RADIUS), "first")
    scratch.drop()
    names = docs.columns
    rows = docs.select(
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie")
    )
    same = rows["_id"].eqNullSafe(first["doc_id"]) & (rows["_tie"] == first["tie"])
    # The join leaves the rows dealt by id and hash, so no other shuffle is needed to drop repeated ones.
    kept = rows.join(first.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["_id", "_tie"])
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat. What is left of a character that was cut in two is
    left out too. Where something was cut, ``n_chars`` counts what stays."""
    prepare(spark)
    names = docs.columns
    cut = remove_repeats(docs, Scratch(spark), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), as_text=True)
    columns = {c: F.col(f"_c{i}") for i, c in enumerate(names)}
    changed = F.col("n_removed") > 0
    columns["text"] = F.when(changed, F.col("kept")).otherwise(columns["text"])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.char_length("kept").cast(kind)).otherwise(columns["n_chars"])
    return cut.select(*(column.alias(c) for c, column in columns.items()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null ids are told apart by the hash of the text."""
    prepare(spark)
    names = docs.columns
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), key.alias("_key"))
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), key)
    hit = found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.tie").alias("_tie")).distinct()
    hit = Scratch(spark).keep(hit, "hit")
    same = F.col("_key.id").eqNullSafe(F.col("_id")) & (F.col("_key.tie") == F.col("_tie"))
    kept = rows.join(hit, same, "left_anti")
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids, text)``: piece ids of each document and the text they decode to."""
    prepare(spark)
    coded = encode_pieces(docs, tokenizer_path(PIECE_MODEL), "doc_id")
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.col("text_back").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: No stage is expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
