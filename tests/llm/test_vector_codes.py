"""Vector codes, held against plain integer arithmetic over all rows."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagework.llm import vector_codes
from pagework.llm.queries import op13_vector_codes
from pagework.llm.vector_codes import compress_vectors
from pagework.sources.scratch import Scratch


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """``{(id, code, error, label_error): count}`` and the digest, from rows ``(id, vector, label)``."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = len(kept[0][1]) // parts
    vectors = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[nearest(v[p], books[p])[1]].append(v[p])
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], defaultdict(int)
    for r, v in zip(kept, cut):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[r[2]] += error
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), error, r[2]))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((a, b, c, by_label[d]) for a, b, c, d in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_plain_codes(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = op13_vector_codes(spark, "/root/testdata/sf0.01").collect()
    wanted, digest = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == wanted
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("block_values", [16, 1 << 19])
@pytest.mark.parametrize("labels", [0, 100_000])
def test_odd_rows(spark, monkeypatch, block_values, labels):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", block_values)
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.1, -0.1, 0.25, 3.0, 0, 0, 0, -30.5], 1), (5, [0.1, -0.1, 0.25, 3.0, 0, 0, 0, -30.5], 1),
        (5, [0.0, -0.1, 0.25, 3.0, 0, 0, 0, 0.0], None), (None, [1.0] * 8, None), (3, [-0.0004] * 8, 2),
        (1, None, 1), (2, [1.0, None] * 4, 1), (4, [nan] + [0.0] * 7, 1), (6, [0.0] * 7 + [-inf], 1),
    ]
    rows = [(i, v and [x if x is None else float(x) for x in v], lab) for i, v, lab in rows]
    rows += [(100 + i, [((i * 7 + k * 3) % 11 - 5) / 9 for k in range(8)], i % 3) for i in range(400)]
    frame = spark.createDataFrame([(*r, "own", b"x") for r in rows], "vec_id long, embedding array<double>, label int, code string, row binary")
    out = compress_vectors(frame, Scratch(spark), "vec_id").withColumn("digest", F.sha2("codebooks", 256)).collect()
    wanted, digest = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=str) == wanted
    assert {r.digest for r in out} == {digest}


def test_few_rows_none_and_ragged_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = compress_vectors(spark.createDataFrame([(1, [0.5, 0.25, 0.0, -1.0], None)], schema), Scratch(spark), "vec_id").collect()
    assert [(r.vec_id, r.code, r.error, r.label_error, r.codebooks) for r in one] == [(1, "00000000", 0, 0, "512,256,0,-1024")]
    none = compress_vectors(spark.createDataFrame([(1, None, 3)], schema), Scratch(spark), "vec_id")
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks"] and none.count() == 0
    bare = compress_vectors(spark.createDataFrame([(1, [], 3), (2, [], 3)], schema), Scratch(spark), "vec_id").collect()
    assert [(r.code, r.error) for r in bare] == [("00000000", 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(spark.createDataFrame([(1, [1.0, 2.0], 3)], schema), Scratch(spark), "vec_id")
    with pytest.raises(Exception, match="components"):
        compress_vectors(spark.createDataFrame([(1, [1.0] * 4, 3), (2, [1.0] * 8, 3)], schema), Scratch(spark), "vec_id")
