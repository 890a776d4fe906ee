"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagework.llm.common import crc_remainder, prepare, table
from pagework.llm.decontaminate import contaminated
from pagework.llm.html_text import extract_text
from pagework.llm.langid import fit_language_model, predict_language
from pagework.llm.lm_scores import score_texts
from pagework.llm.periodic import periodic_runs
from pagework.llm.piece_codec import encode_pieces
from pagework.llm.piece_count import count_pieces
from pagework.llm.quality import judge_quality
from pagework.llm.repeats import remove_repeats
from pagework.llm.simhash import near_duplicates
from pagework.llm.token_files import read_token_files, write_token_files
from pagework.llm.toxicity import fit_toxicity, score_toxicity
from pagework.llm.vector_codes import compress_vectors
from pagework.sources.scratch import Scratch

TOXIC_FROM = 0.7
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return near_duplicates(docs, Scratch(spark)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select(
        "doc_id", "text", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    )
    net = fit_toxicity(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, net, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(prepare(spark), sf_dir, "pages"), "page_id", "url")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return count_pieces(docs, tokenizer_path(PIECE_MODEL), "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    scratch = Scratch(spark)
    folder = f"{scratch.folder}/tokens"
    manifest = scratch.keep(write_token_files(docs, tokenizer_path(WORD_TOKENIZER), folder, END_ID), "manifest")
    return read_token_files(spark, folder, manifest)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select(
        "doc_id", "text", "lang", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    )
    model = fit_language_model(docs.filter("not held_out"))
    return predict_language(docs, model, "doc_id", "held_out")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    coded = encode_pieces(docs, tokenizer_path(PIECE_MODEL), "doc_id", F.col("text").alias("_text"))
    return coded.select(
        "doc_id",
        F.size("ids").alias("n_pieces"),
        (F.col("text_back") == F.coalesce("_text", F.lit(""))).alias("same_text"),
        "ids",
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return remove_repeats(docs, Scratch(spark), "doc_id").select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return judge_quality(docs, Scratch(spark), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    ranks = tokenizer_path(BYTE_RANKS)
    return score_texts(docs, ~F.col("held_out"), Scratch(spark), ranks, public_tokenizers.PATTERN, "doc_id", "held_out")


def with_cycles(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of documents; in every tenth text the words from some place on are replaced by the
    first few of them over and over. The place and the number of words follow from crc32 of the id as text, a
    null id counting as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    cycles = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    cyclic = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycles, F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(cyclic, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_cycles(table(prepare(spark), sf_dir, "documents"))
    found = periodic_runs(docs, "doc_id")
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = found.withColumn("best", F.array_min(ranked)).withColumn("length", -F.col("best.less"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        "length",
        F.col("best.period").alias("period"),
        F.floor(F.col("length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return compress_vectors(vectors, Scratch(spark), "vec_id").select(
        "vec_id", "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256")
    )


CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_lm_scores": op11_lm_scores,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_codes": op13_vector_codes,
}


def vector_codes_sql(rounds: int = 4) -> str:
    """Expected rows of op13: every part is compared with every entry."""
    gap = "list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    odd = "list_filter(embedding, lambda x: x is null or not isfinite(x))"
    steps = [
        "kept as (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, "
        "list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v "
        f"from embeddings where embedding is not null and len({odd}) = 0)",
        "parts as materialized (select r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] as part "
        "from kept cross join (select unnest(range(4)) as p) q)",
        "books0 as materialized (select p, r as e, part as entry from parts where r < 256)",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"near{k} as materialized (select r, t.p as p, any_value(part) as part, "
            f"min({{'d': cast({gap} as bigint), 'e': e}}) as m from parts t join books{k} b on b.p = t.p group by r, t.p)"
        )
        if k < rounds:
            steps.append(
                f"means{k} as (select p, e, list(x order by i) as entry from (select p, e, i, cast(floor(cast(sum(x) as double) / count(*)) as bigint) as x "
                f"from (select p, m.e as e, unnest(range(len(part))) as i, unnest(part) as x from near{k}) u group by p, e, i) w group by p, e)"
            )
            steps.append(
                f"books{k + 1} as materialized (select b.p, b.e, coalesce(n.entry, b.entry) as entry "
                f"from books{k} b left join means{k} n on n.p = b.p and n.e = b.e)"
            )
    steps += [
        f"coded as (select r, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error from near{rounds} group by r)",
        f"digest as (select sha256(string_agg(array_to_string(entry, ','), ',' order by p, e)) as s from books{rounds})",
    ]
    return (
        "with " + ",\n".join(steps) + "\nselect vec_id, code, error, "
        "cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256 "
        "from kept join coded on coded.r = kept.r cross join digest"
    )


CORPUS_ORACLES: dict[str, str] = {"op13_vector_codes": vector_codes_sql()}
