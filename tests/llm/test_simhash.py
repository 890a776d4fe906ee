import random

import numpy as np
import pytest

from pagework.llm import simhash
from pagework.llm.simhash import Partitions, choose_parts, fingerprint, group_bits, near_duplicates, near_links, representatives
from pagework.sources.scratch import Scratch


def plain_components(fps, radius=2):
    own = list(range(len(fps)))

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)[0]:
            a, b = find(i), find(i + 1 + int(j))
            own[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def made_fingerprints(seed=5, clusters=60):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) & 0xFFFF00FFFF00FFFF for _ in range(400)}
    for _ in range(clusters):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            fps.add(base & (2**64 - 1))
    centre = rng.getrandbits(64)
    for i in range(14):
        for j in range(14):
            fps.add(centre ^ (1 << i) ^ (1 << j + 20))
    return sorted(fps | {0, 1, 6, 2**64 - 1})


@pytest.mark.parametrize(("parts", "limit"), [(None, 128), (1, 500), (2, 20), (3, 5), (4, 1)])
def test_links_reach_all_near_fingerprints(spark, parts, limit):
    fps = made_fingerprints()
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = near_links(nodes, Scratch(spark), parts=parts, bucket_limit=limit).collect()
    at = {f: i for i, f in enumerate(signed)}
    own = list(range(len(fps)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        assert (fps[at[a]] ^ fps[at[b]]).bit_count() <= 2
        x, y = find(at[a]), find(at[b])
        own[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_thresholds_add_up_and_are_cheapest():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 20, 200, dtype=np.uint64)
    groups = [list(range(0, 10)), list(range(10, 40)), list(range(40, 64))]
    plain = Partitions(groups, None, len(fps), 2)
    own = Partitions(groups, plain.count_subs(fps), len(fps), 2)
    chosen, costs = own.thresholds(fps), own.estimates(fps)
    assert (chosen.sum(axis=1) == 2 - 3 + 1).all() and chosen.min() >= -1
    options = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    for i in range(len(fps)):
        price = {o: sum(costs[i, p, t] for p, t in enumerate(o) if t >= 0) for o in options}
        assert price[tuple(chosen[i])] == pytest.approx(min(price.values()))
    assert len(np.unique(chosen, axis=0)) > 0


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 63] = bits[:, 3]
    groups = group_bits(bits.T @ bits, 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40, 63} <= set(g) for g in groups)
    assert choose_parts(10**5) == 3 and choose_parts(10**10) == 2


def test_fingerprint_rules():
    assert fingerprint(b"") == fingerprint(b" \n\t") == 0
    assert fingerprint(b"One TWO") == fingerprint(b"  one\ntwo ") != 0
    assert fingerprint("É a b".encode()) != fingerprint("é a b".encode())
    long = b"a b c d " * 40000
    assert fingerprint(long) == fingerprint(long.replace(b" ", b"\n"))


def test_odd_rows(spark):
    rows = [(3, "a b c d e", "x"), (1, "A b c d e", "y"), (1, "A b c d e", "y"), (None, "a b c d e", None),
            (9, None, "z"), (8, "", "z"), (None, "only the null one has this text", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = near_duplicates(docs, Scratch(spark))
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (None, 1), (9, 8), (8, 8), (None, None)], key=str)
    empty = near_duplicates(docs.limit(0), Scratch(spark))
    assert empty.columns == ["doc_id", "fp", "component_id"] and empty.count() == 0


def test_representatives_are_the_least_of_their_component(spark):
    rows = [(4, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (None, "a b c d e"), (7, None), (6, " "), (None, "alone with no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = representatives(docs, Scratch(spark))
    assert sorted((r.doc_id for r in chosen.collect()), key=str) == [2, 6, None]
    assert representatives(docs.limit(0), Scratch(spark)).count() == 0


def test_bucket_limit_is_not_a_cap():
    assert simhash.BUCKET_LIMIT >= 65
