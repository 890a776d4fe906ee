"""Odd rows through the operators that work row by row, and each of them against a plain reference."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagework.llm import toxicity
from pagework.llm.common import crc_remainder
from pagework.llm.html_text import content_lines, extract_text, main_text
from pagework.llm.langid import fit_language_model, predict_language
from pagework.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces
from pagework.llm.piece_count import PieceCounter, count_pieces
from pagework.llm.piece_model import PieceModel, read_model
from pagework.llm.quality import COUNTS, chi_square_quantile, count_text, judge_quality, text_counts
from pagework.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_path
from pagework.llm.token_files import WordEncoder, read_token_files, write_token_files
from pagework.llm.toxicity import fit, fit_toxicity, score_toxicity
from pagework.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from pagework.sources.scratch import Scratch

ODD = [
    "", " ", "one", "a  b   c\n\n d ", " lead", "trail ", "日本語 テスト 😀 x▁y", "Don't (STOP), e-mail: 12.5% ... '' É é",
    "<|endoftext|> <s> <unk> <0x0A>", "\x00\x01 \x1f   z", "word " * 30000, "x" * 5000,
]
ROWS = [(i, t, "n") for i, t in enumerate(ODD)] + [(3, ODD[3], "n"), (None, "no id", None), (77, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, score string")


def test_pieces_equal_the_reference_library(docs):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = encode_pieces(docs, path, "doc_id", F.col("text").alias("ids_of"))
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == reference.encode(r.ids_of or "")
        assert r.text_back == (r.ids_of or "").replace("▁", " ")
    back = decode_pieces(coded.withColumn("ids", F.when(F.col("doc_id") != 2, F.col("ids"))), path, "doc_id", "text_back")
    assert all(r.text == (None if r.doc_id in (2, None) else r.text_back) for r in back.collect())
    codec = PieceCodec(path, verify=True)
    codec.encode([t.encode() for t in ODD])
    assert codec.repaired == 0


def small_unigram(seed, byte_fallback):
    import random

    rng = random.Random(seed)
    pieces = ["<unk>", *sorted({"".join(rng.choice("abé▁") for _ in range(rng.randint(1, 4))) for _ in range(25)})]
    scores, kinds = [0.0] + [-float(rng.randint(1, 4)) for _ in pieces[1:]], [2] + [1] * (len(pieces) - 1)
    if byte_fallback:
        pieces += [f"<0x{b:02X}>" for b in range(256)]
        scores, kinds = scores + [0.0] * 256, kinds + [6] * 256
    texts = ["".join(rng.choice("ab▁c é\n") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    return PieceModel(pieces, scores, kinds, 1, byte_fallback), texts


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_piece_counts_follow_the_tie_rules(byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    for seed in (1, 2):
        model, texts = small_unigram(seed, byte_fallback)
        reference = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), 0, byte_fallback))
        reference.pre_tokenizer = pre_tokenizers.Metaspace()
        wanted = [len(reference.encode(t).ids) for t in texts]
        assert PieceCounter(model).count([t.encode() for t in texts]).tolist() == wanted


def test_piece_counts_of_odd_rows(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path(PIECE_MODEL)
    model = read_model(path)
    reference = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), model.unknown, True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace()
    for r in count_pieces(docs, path, "doc_id", "text").collect():
        assert r.n_pieces == len(reference.encode(r.text or "", add_special_tokens=False).ids)


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for ids in (np.empty(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 70000, 3000), rng.zipf(1.5, 4000) % 50):
        ids = ids.astype(np.uint32)
        shard, docs, lengths, m = from_bytes(to_bytes(4, [None, 7], np.array([1, len(ids) - 1]), WaveletMatrix.build(ids)))
        assert (shard, docs, lengths.tolist()) == (4, [None, 7], [1, len(ids) - 1])
        assert (m.tokens() == ids).all()
        for at in range(0, len(ids), 97):
            v = int(ids[at])
            assert m.access(at) == v and m.count(v, at) == (ids[:at] == v).sum()
            assert m.select(v, m.count(v, at)) == at
        if len(ids):
            assert m.locate(int(ids[0])) == np.nonzero(ids == ids[0])[0].tolist()
        assert m.count(1 << 20) == 0
    with pytest.raises(ValueError, match="damaged"):
        from_bytes(to_bytes(0, [1], np.array([3]), WaveletMatrix.build(np.array([1, 2, 3])))[:-1] + b"?")


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path(WORD_TOKENIZER)
    plain = Tokenizer.from_file(path)
    scratch = Scratch(spark)
    folder = f"{scratch.folder}/tokens"
    manifest = scratch.keep(write_token_files(docs, path, folder, 1, file_bytes=60_000), "manifest")
    assert manifest.count() > 1
    got = read_token_files(spark, folder, manifest).orderBy("start").collect()
    start = 0
    ids_of = {}
    for d, t, _ in ROWS:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        ids_of[d] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda d: -1 if d is None else d)
    for r in got:
        assert (r.start, (r.n_tokens, r.ids_crc32)) == (start, ids_of[r.doc_id])
        start += r.n_tokens
    empty = scratch.keep(write_token_files(docs.limit(0), path, f"{scratch.folder}/none", 1), "none")
    assert empty.count() == 0
    assert WordEncoder(path).encode([b""])[1].tolist() == [0]


def test_language(spark, docs):
    train = [("the house and the garden " * 3, "en"), ("das haus und der garten " * 3, "de"), (None, "en"), ("el jardín", None)]
    model = fit_language_model(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["de", "en"]
    asked = spark.createDataFrame([(1, "the garden"), (2, "und das"), (3, "12 %"), (4, None), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 1)) for r in predict_language(asked, model, "doc_id").collect())
    assert [g[:2] for g in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (4, "und")]
    assert all(0 <= g[2] <= 1 for g in got)
    assert predict_language(docs, model, "doc_id", F.col("score").alias("body_")).count() == len(ROWS)
    nothing = fit_language_model(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in predict_language(docs, nothing, "doc_id").collect()} == {"und"}


def test_held_out_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_remainder(F.col("doc_id"), 4) == 2
    model = fit_language_model(table.filter(~held))
    out = predict_language(table.filter(held & F.col("lang").isNotNull()), model, "lang")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_network_gradients():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["ob"] += 3
    words, flat = [b"abc", b"de,f", b"ghij"], np.array([0, 1, 2, 1, 0] * 9)
    args = (words, flat, [30, 15], np.array([1, 0]))
    _, g = net.step_gradients(*args)
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, loss = net.p[k][at], []
        for step in (1e-4, -1e-4):
            net.p[k][at] = old + step
            loss.append(net.step_gradients(*args)[0])
        net.p[k][at] = old
        assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(g[k][at], rel=1e-2)


def test_windows_overlap_and_cover():
    first, sizes, owner = toxicity.windows([0, 5, 24, 25, 100])
    assert Counter(owner.tolist())[0] == 1 and sizes[0] == 0
    begin = 29 + 25
    assert {b for f, s, o in zip(first, sizes, owner) if o == 4 for b in range(f - begin, f - begin + s)} == set(range(100))


def test_long_clean_texts_stay_clean(spark):
    sf_dir = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = table.join(labels, "doc_id").withColumn("held", crc_remainder(F.col("doc_id"), 3) == 1)
    net = fit_toxicity(known.filter("not held"), labels)
    held = known.filter("held").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    scorer = toxicity._Scorer(net)
    score = scorer([(r.text or "").encode() for r in held])
    toxic = np.array([r.toxic == 1 for r in held])
    assert (score[toxic] >= 0.7).mean() >= 0.75 and (score[~toxic] >= 0.7).mean() < 0.01
    clean = [r.text or "" for r, s, t in zip(held, score, toxic) if not t]
    joined, size = [], 0
    for text in clean * 8:
        if not joined or size >= 1_000_000:
            joined.append([])
            size = 0
        joined[-1].append(text)
        size += len(text)
    long = scorer(["\n".join(j).encode() for j in joined[:6]])
    assert (long < 0.7).all(), long
    # One strong window is found however long the text is.
    worst = max((s, r.text) for r, s, t in zip(held, score, toxic) if t)[1]
    assert scorer(["\n".join([*joined[0], worst, *joined[1]]).encode()])[0] >= 0.7


def test_toxicity_finds_marked_texts(spark, docs):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(200)]
    made = []
    for i in range(240):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = ["badword", "worseword"][at % 2]
        made.append((i, " ".join(words), int(i % 3 == 0)))
    table = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made if m[0] < 160] + [(None, 1), (5, None)], "doc_id long, toxic int")
    net = fit_toxicity(table, labels)
    got = {r.doc_id: r.score for r in score_toxicity(table, net, "doc_id").collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, _, y in made if i >= 160]) > 0.9
    odd = score_toxicity(docs, net, "doc_id", F.col("score").alias("other")).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert fit([], []).constant == 0.0 and fit([b"a"], [1]).constant == 1.0
    assert score_toxicity(docs.limit(0), net, "doc_id").count() == 0


def test_pages(spark):
    page = (
        "<html><head><title>T</title></head><body><header><nav><a href=x>m</a></nav>Site</header>"
        "<div class='cookie-notice'>We use cookies</div><main><article><h1>Head&amp;line</h1><p>First  <b>bold</b>\npart."
        "<p>Second.<script>var p='</p>';</script><form>mail</form><aside>more</aside></article>"
        "<div id=comments><article class=comment>Nice long comment by a reader of the page</article></div></main>"
        "<footer>&copy;</footer>"
    )
    assert main_text(page) == "Head&line First bold part. Second."
    assert main_text("") == "" and main_text("<p>") == "" and main_text("plain &lt; text") == "plain < text"
    assert main_text("<nav>a<article><p>text of it</p></article>") == "text of it"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>x" * 20000), (None, "u", "<" * 3000)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", F.col("url").alias("text_"))
    got = sorted(((r.page_id or 0, r.n_chars, r.text) for r in out.collect()))
    assert [g[0] for g in got] == [0, 1, 1, 2, 3, 4] and all(g[1] == len(g[2]) for g in got)
    assert got[3][2] == got[4][2] == "" and got[5][1] == 39999
    assert content_lines(np.array([0.0, 0, 50, 60, 0, 0, 0])).tolist()[2:4] == [True, True]


def test_all_pages_give_their_article(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_text(pages, "html").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub("<[^>]*>", "", b) for b in re.split("</?(?:p|h1|br)>", article)]
        wanted = " ".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert r.text == wanted


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(hit),
    )


def test_counts_equal_plain_ones():
    for t in [*ODD[:10], "a b c d e a b c d e", "x\nx\n x\n\nx", "a " * 12, "1 2 3 4 5 6 1 2 3 4 5 6 7 é|#"]:
        assert count_text(t.encode())[:5] == plain_counts(t), t


def test_quality_rejects_junk(spark, docs):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    good = [" ".join(rng.choice(words, rng.integers(60, 300))) + "." for _ in range(300)]
    junk = [" ".join(f"{w}$$$" for w in rng.choice(words, 120)) for _ in range(20)]
    junk += [" ".join(rng.choice(words, 120)).upper() for _ in range(20)]
    rows = [(i, t, "en", "s" if i % 2 else None, 1) for i, t in enumerate(good + junk)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, pool int")
    kept = {r.doc_id: r.kept for r in judge_quality(table, Scratch(spark), "doc_id").collect()}
    assert np.mean([kept[i] for i in range(300)]) > 0.97
    assert not any(kept[i] for i in range(300, 340))
    odd = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("distance", F.lit(1))
    out = judge_quality(odd, Scratch(spark), "doc_id").collect()
    assert len(out) == len(ROWS) and all(r.base_failed and not r.kept for r in out if r.n_words < 10)
    assert judge_quality(odd.limit(0), Scratch(spark), "doc_id").columns[:1] == ["doc_id"]
    assert len(COUNTS) == 8 and chi_square_quantile(7, 0.95) == pytest.approx(14.07, abs=0.05)


def test_kept_columns_may_be_called_like_the_text_inside(docs):
    other = docs.select("doc_id", "text", F.col("score").alias("body"), F.lit(1).alias("_body"))
    path, keep = tokenizer_path(PIECE_MODEL), ("doc_id", "body", "_body")
    model = fit_language_model(docs.select("doc_id", "text", F.lit("en").alias("lang")))
    made = [
        encode_pieces(other, path, *keep), count_pieces(other, path, *keep), extract_text(other, *keep, html="text"),
        predict_language(other, model, *keep), score_toxicity(other, toxicity.Network(constant=0.5), *keep),
        text_counts(other, *keep),
    ]
    for out in made:
        got = out.select(*keep).collect()
        assert sorted(map(str, got)) == sorted(map(str, other.select(*keep).collect()))
