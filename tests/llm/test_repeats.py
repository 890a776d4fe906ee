import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagework.llm.repeats import confirmed, covered, remove_repeats, repeated_windows
from pagework.sources.scratch import Scratch


def plain(texts, length):
    """Per text: number of bytes removed, number of runs, and what stays."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def made_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(k):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(k))

    passages = [prose(rng.randint(30, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            base = rng.choice(texts)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(base) + 1)
                base = base[:at] + rng.choice(["x", "", " yy "]) + base[at + rng.randint(0, 3) :]
            texts.append(base)
        elif kind < 0.6:
            texts.append(prose(rng.randint(0, 40)) + rng.choice(passages) + prose(rng.randint(0, 40)))
        else:
            texts.append(prose(rng.randint(0, 150)))
    return [*texts, "", "a" * 199, "a" * 200, "a" * 201, "ab" * 300, "x" * 150 + "q" * 230, "y" * 150 + "q" * 230]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length", [1, 7, 30])
def test_windows_of_regions(seed, length):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab \n") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    strings += [b"abcabcabc" * 8, b"", b" "]
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    wanted = [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
    assert [list(f) for f in confirmed(strings, length)] == wanted
    assert [list(f) for f in repeated_windows(strings, length)] == wanted


@pytest.mark.parametrize(("seed", "limit"), [(1, 256), (2, 256), (3, 2)])
def test_removal_equals_brute_force(spark, seed, limit):
    texts = made_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = remove_repeats(docs, Scratch(spark), "doc_id", group_limit=limit)
    got = {r.doc_id: (r.n_removed, len(r.removed), bytes(r.kept)) for r in out.collect()}
    wanted = plain([t.encode() for t in texts], 200)
    assert any(w[0] for w in wanted) and any(not w[0] for w in wanted)
    assert [got[i] for i in range(len(texts))] == wanted


def test_covered_merges_touching_runs():
    assert covered([(10, 1), (0, 1)], 10) == [(0, 20)]
    assert covered([(11, 2), (0, 1)], 10) == [(0, 10), (11, 22)]


def test_odd_rows(spark):
    long = "word and " * 30
    other = "".join(f"{i} " for i in range(100))
    rows = [(1, other, 5), (1, other, 5), (None, long, 1), (2, None, 2), (3, "", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = remove_repeats(docs, Scratch(spark), "doc_id", F.col("spans").alias("tie"))
    got = sorted((str(r.doc_id), r.tie, r.n_bytes, r.n_removed) for r in out.collect())
    wanted = plain([(r[1] or "").encode() for r in rows], 200)
    assert got == sorted((str(r[0]), r[2], len((r[1] or "").encode()), w[0]) for r, w in zip(rows, wanted))
    assert wanted[0][0] == len(other) and hashlib.sha256(b"").hexdigest()
    assert remove_repeats(docs.limit(0), Scratch(spark), "doc_id").count() == 0
