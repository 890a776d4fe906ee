import os
import re
import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pagework.functions import markup, urls
from pagework.llm import lm_scores, toxicity
from pagework.llm.queries import BYTE_RANKS, tokenizer_path
from pagework.plans.mirror import mirror_languages, mirror_pages, mirror_saved
from pagework.sources.scratch import Scratch

PAGES = "site string, url string, page_order long, html string"
HTML = '<body><link rel=stylesheet href="https://c/x.css"><img src="https://c/a.png"><ul><li class="language_selector" data-language="fr">f</ul></body>'


def made(scratch):
    return sorted(name.split("-", 1)[1] for name in os.listdir(scratch.folder.removeprefix("file:")))


def test_totals_need_no_edits(spark):
    assets = spark.createDataFrame([("https://c/x.css", 200, "a{}"), ("https://c/a.png", 200, "")], "url string, status int, content string")
    langs = [("e", f"https://e/?lang={x}", 1, HTML) for x in ("en", "fr")]
    pages = spark.createDataFrame(langs, PAGES)
    saved = spark.createDataFrame([("e", "index.html", HTML)], "site string, path string, html string")
    seeds = spark.createDataFrame([("e", "https://e/")], "site string, base_url string")
    jobs = [
        lambda s: mirror_languages(pages, seeds, assets, ["en", "fr"], s),
        lambda s: mirror_pages(pages, assets, s),
        lambda s: mirror_saved(saved, assets, s),
    ]
    for i, job in enumerate(jobs):
        scratch = Scratch(spark)
        done = job(scratch)
        row = done.totals.first()
        assert (row.pages_done, row.attempted, row.succeeded) == ((1, 2, 2) if i == 2 else (2, 2, 2))
        assert not {"matched", "selectors", "bundled_refs"} & set(made(scratch))
        assert done.files.count() == (3, 2, 1)[i] and done.files is done.files
        # What is read several times is cut from the pages once.
        assert made(scratch).count("matched") == 1
        assert made(scratch).count("selectors") == made(scratch).count("bundled_refs") == (i == 0)


def test_classes_of_frequent_patterns_are_tables():
    wanted = [markup.token_pattern(), markup.token_pattern(["a", "script"]), markup.attribute_pattern("href"), markup.TAG_PIECE]
    for pattern in [*wanted, urls.WEB_ADDRESS, urls.HOST_ADDRESS, urls.ROOT_PATH, urls.WHOLE_ORIGIN]:
        for inside in re.findall(r"\[((?:[^\]\\]|\\.)*)\]", pattern):
            assert inside == r"\s\S" or r"\s" not in inside and r"\x00-" not in inside, inside


def test_attributes_are_set_whatever_stands_between_them(apply):
    edits = "array(named_struct('name', 'href', 'value', 'n&\"'), named_struct('name', 'style', 'value', 's'))"
    tags = ["<a>", "<a href=x>", "<a\thref = 'x'\nHREF=y />", "<a / = b title='href' >", "<a style href>", "<script src=a>var s='<a href=b>'</script>"]
    new = 'href="n&amp;&quot;"'
    assert apply(lambda t: markup.set_attributes(t, F.expr(edits)), tags) == [
        f'<a {new} style="s">',
        f'<a {new} style="s">',
        '<a\thref="n&amp;&quot;"\nHREF="n&amp;&quot;" style="s" />',
        f"<a / = b title='href' {new} style=\"s\" >",
        f'<a style="s" {new}>',
        f"<script src=a {new} style=\"s\">var s='<a href=b>'</script>",
    ]


def test_fit_of_toxicity_holds_little(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [b" ".join(b"w%x" % w for w in rng.integers(0, 1 << 40, 2000)) for _ in range(80)]
    labels = [int(i % 8 == 0) for i in range(80)]
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    held = []
    for windows_held in (toxicity.WINDOWS_HELD, 1000):
        monkeypatch.setattr(toxicity, "WINDOWS_HELD", windows_held)
        tracemalloc.start()
        net = toxicity.fit(texts, labels, epochs=1)
        held.append((tracemalloc.get_traced_memory()[1] / 1e6, net))
        tracemalloc.stop()
    # Blocks of windows change nothing but the memory.
    assert held[1][0] < held[0][0] < 130
    for name, value in held[0][1].p.items():
        assert np.allclose(value, held[1][1].p[name], atol=1e-3), name


def test_every_text_is_learnt_from(spark, monkeypatch):
    """Each text goes to one learner in one round, equal rows once, whatever the number of texts."""
    monkeypatch.setattr(lm_scores, "TEXTS_A_LEARNER", 64)
    rows = [(i, f"text {i % 50}") for i in range(400)] * 2 + [(None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, learners = lm_scores.deal_texts(docs, "text", "doc_id")
    assert learners == -(-len(rows) // 64)
    got = dealt.collect()
    assert len(got) == len(rows) and {r["round"] for r in got} == set(range(lm_scores.ROUNDS))
    places = {}
    for r in got:
        places.setdefault(r.deal, set()).add((r["round"], r.learner))
    assert len(places) == 402 and all(len(p) == 1 for p in places.values())
    counts = lm_scores.count_words(docs)
    coder = lm_scores.subwords(tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN)
    vocabulary = lm_scores.Vocabulary.of(lm_scores.count_ids(counts, tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN), coder.begins)
    study = lm_scores._student(lm_scores.Model.fresh(vocabulary).vector, vocabulary, tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN, 0)
    n = sum(r.n for round_ in range(lm_scores.ROUNDS) for r in dealt.filter(F.col("round") == round_).groupBy("learner").applyInArrow(study, "n long, vector array<float>").collect())
    words = sum(len(coder.encode(w)) for i in range(400) for w in f"text {i % 50}".encode().split())
    assert n == words + 400 + 1 + len(coder.encode(b"x")) + 1
