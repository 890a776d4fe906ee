"""Periodic runs, held against trying every lag word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pagework.llm.periodic import Runs, collapse, frequent_segments, periodic_runs, runs_of
from pagework.llm.queries import op12_periodic_runs


def plain_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, letters, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.3:
            out += [rng.choice(letters) for _ in range(rng.randint(1, 8))] * rng.randint(2, 9)
        else:
            out += [rng.choice(letters) for _ in range(rng.randint(1, 20))]
    return out[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_every_lag(seed):
    rng = random.Random(seed)
    texts = [random_words(rng, [b"%d" % i for i in range(k)], rng.randint(0, 260)) for k in (1, 2, 3, 8, 40) for _ in range(25)]
    texts += [[], [b"a"] * 6, [b"a"] * 5, [b"a", b"b"] * 4, [b"a", b"b"] * 3, [b"a"] * 6 + [b"b"] * 6]
    for words, found in zip(texts, runs_of(texts)):
        assert found == plain_runs(words)
        assert collapse(words, found) == plain_collapse(words, found)


def test_long_lags_are_looked_at_in_places():
    rng = random.Random(9)
    for period in (17, 33, 64, 150):
        for extra in range(3):
            base = [rng.randrange(40) for _ in range(period)]
            words = [rng.randrange(40) for _ in range(rng.randint(0, 300))]
            words += base * 4 + base[:extra] + [rng.randrange(40) for _ in range(200)]
            ids = np.array(words)
            assert Runs(ids).scan() == plain_runs(words)
    one = np.zeros(60_000, np.int64)
    assert Runs(one).scan() == [(0, 60_000, 1)]
    two = np.tile([0, 1, 0, 2, 5], 12_000)
    assert Runs(two).scan() == [(0, 60_000, 5)]


def test_words_that_are_too_rare_split_segments():
    words = [b"a", b"b"] * 5 + [b"c"] + [b"a"] * 3 + [b"d"] * 6 + [b"b", b"e"]
    ids = np.array([{b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"e": 4}[w] for w in words])
    assert frequent_segments(ids, np.array([0])) == [(0, 10), (14, 20)]
    assert frequent_segments(np.zeros(10, np.int64), np.array([0, 0, 5, 10, 10])) == []


def test_odd_rows(spark):
    rows = [
        (1, "a b a b a b a b end", "x"), (1, "a b a b a b a b end", "x"), (2, None, "x"), (3, "", None), (None, " \t", "x"),
        (4, "é\x0bé\x0cé é é é\n", "x"), (5, "w " * 200_000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic_runs(docs.withColumnRenamed("runs", "body"), "doc_id", "body").collect()
    got = sorted((str(r.doc_id), str(r.body), [tuple(x) for x in r.runs], r.collapsed) for r in out)
    assert got == sorted([
        ("1", "x", [(0, 8, 2)], "a b end"), ("1", "x", [(0, 8, 2)], "a b end"), ("2", "x", [], ""), ("3", "None", [], ""),
        ("None", "x", [], ""), ("4", "x", [(0, 6, 1)], "é"), ("5", "x", [(0, 200_000, 1)], "w"),
    ])
    assert periodic_runs(docs.limit(0), "doc_id").count() == 0


def wanted_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        doc_id, len(runs), best[0], best[1], best[2], best[1] and best[1] * 1000 // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapse(words, runs)).hexdigest(),
    )


def test_query_equals_every_lag(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = op12_periodic_runs(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(wanted_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in rows) > 10


def test_query_of_odd_tables(spark, tmp_path):
    rows = [(None, "a b c d e f g h i j k l"), (None, None), (3, ""), (7, None), (7, "x y")] + [(i, "a b c " * 7) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((wanted_row(*r) for r in rows), key=str)
