"""The stages of the pipeline, held against plain versions of what they decide."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagework.llm.decontaminate import Items, common_subsequence, contaminated, hashed_words
from pagework.llm.simhash import fingerprint

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _tie string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], COLUMNS)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "suffix_dedup", "decontamination", "sentencepiece",
    ]


def test_near_dedup_keeps_one_of_each_group(spark):
    texts = ["one two three four five six", "ONE two three four five six", "something else is here now", None, ""]
    rows = [(5, texts[0]), (3, texts[1]), (3, texts[1]), (9, texts[2]), (None, texts[2]), (8, texts[3]), (7, texts[4]), (None, "alone with no id")]
    out = stage("near_dedup")(spark, make(spark, rows), DATA)
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted(
        [("3", texts[1]), ("9", texts[2]), ("7", ""), ("None", "alone with no id")]
    )
    assert len({fingerprint((t or "").encode()) for _, t in rows}) == 4


def test_cut_repeats_keeps_every_document(spark):
    shared = " ".join(f"é{i}" for i in range(80))
    rows = [(1, f"start {shared} end"), (2, f"other {shared} tail"), (3, "short"), (4, None), (4, None)]
    out = {r.doc_id: r for r in stage("suffix_dedup")(spark, make(spark, rows), DATA).collect()}
    assert out[1].text == "start end"[:5] + out[1].text[5:] and shared not in out[1].text
    assert out[1].text.startswith("start") and out[1].text.endswith("end") and out[1].n_chars == len(out[1].text)
    assert out[3].text == "short" and out[4].text is None


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence_equals_the_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 6, rng.integers(0, 90)).tolist() for _ in range(2))
        assert common_subsequence(a, b) == plain_subsequence(a, b)


def test_contaminated_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    items = Items.read([(r.item_id, r.text) for r in bench.collect()])
    wanted = set()
    for r in docs.select("doc_id", "text").collect():
        words = hashed_words([(r.text or "").encode()])[0].tolist()
        seen = Counter(words)
        for i, item in zip(items.ids, items.words):
            if sum(min(n, seen[w]) for w, n in Counter(item).items()) < 0.8 * len(item):
                continue
            step = 8
            for at in range(0, max(1, len(words) - len(item)) + step, step):
                if common_subsequence(item, words[at : at + len(item) + 2 * step]) >= 0.8 * len(item):
                    wanted.add((r.doc_id, i))
                    break
    assert wanted and len(wanted - got) <= 0.02 * len(wanted)
    assert len(got - wanted) <= 0.02 * len(wanted)


@pytest.mark.parametrize("change", ["none", "words", "case"])
def test_decontamination_drops_copies_and_paraphrases(spark, change):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    words = item.split()
    if change == "words":
        words[2], words[len(words) // 2] = "changed", "altered"
    copy = " ".join(words).upper() if change == "case" else " ".join(words)
    filler = " ".join(f"word{i}" for i in range(150))
    rows = [(1, f"{filler} {copy} {filler}"), (2, filler), (3, None), (None, f"{filler} {copy}"), (None, filler), (4, " ".join(words[:5]))]
    out = stage("decontamination")(spark, make(spark, rows), DATA)
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted(
        [("2", filler), ("3", ""), ("None", filler), ("4", " ".join(words[:5]))]
    )
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert contaminated(make(spark, rows), bench).count() == 0


def test_toxicity_drops_what_it_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit(1))
    out = stage("toxicity")(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = {r.toxic: r["count"] for r in out.join(labels, "doc_id").groupBy("toxic").count().collect()}
    whole = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    assert left[0] >= 0.98 * whole[0] and left.get(1, 0) < 0.6 * whole[1]


def test_run_over_empty_and_small_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_pieces", "ids", "text"] and 100 < out.count() < 200
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_matches(words, item, answer):
    """Whether a window that begins at a block matches by either rule, all windows tried."""
    blocks, size, n = -(-len(words) // 8), -(-len(item) // 8) + 1, len(item)
    for at in range(max(1, blocks - size + 1)):
        window = words[8 * at : 8 * at + 8 * (size + 1)]
        share = common_subsequence(item, window) / n
        held = len(answer) < n and any(window[i : i + len(answer)] == answer for i in range(len(window)))
        if share >= 0.8 or (share >= 0.6 and held):
            return True
    return False


def test_both_rules_equal_all_windows_in_small_and_large_tables(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = Items.read([(r.item_id, r.text) for r in bench.collect()])
    texts = {r.item_id: (r.text or "").split() for r in bench.collect()}
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    vocabulary = sorted({w for _, t in rows[:50] for w in (t or "").split()})
    planted = []
    for k in range(120):
        words = list(texts[items.ids[k % len(items.ids)]])
        end = len(words) - 8
        for at in rng.choice(max(end, 1), int(max(end, 1) * rng.uniform(0.1, 0.5)), replace=False):
            words[at] = str(rng.choice(vocabulary))
        around = [str(w) for w in rng.choice(vocabulary, int(rng.integers(0, 60)))]
        planted.append((10**6 + k, " ".join([*around, *words, *around])))
    wanted = set()
    for d, t in rows + planted:
        words = hashed_words([(t or "").encode()])[0].tolist()
        seen = Counter(words)
        for i, item, answer in zip(items.ids, items.words, items.answers):
            if sum(min(n, seen[w]) for w, n in Counter(item).items()) >= 0.6 * len(item) and plain_matches(words, item, answer):
                wanted.add((d, i))
    found = {}
    for name, table in (("small", planted), ("large", rows + planted)):
        out = contaminated(spark.createDataFrame(table, "doc_id long, text string"), bench).collect()
        found[name] = {(r.doc_id, r.item_id) for r in out}
        assert len(out) == len(found[name])
    assert len({d for d, _ in wanted if d >= 10**6}) > 40
    assert found["large"] == wanted
    assert found["small"] == {w for w in wanted if w[0] >= 10**6}


def test_small_tables_have_axes(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [(k, r.text) for k, r in enumerate(bench.collect())]
    out = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r.doc_id for r in out.collect() if r.share == 1 and r.cosine > 0.7} == {k for k, t in rows if hashed_words([(t or "").encode()])[1][0]}
