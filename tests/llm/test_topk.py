"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from tabulon.llm.topk import choose_pivots, top_k


def brute(rows, queries, k):
    def ints(v):
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(256 * float(x)) for x in v] if ok else None

    base = [(i, ints(v)) for i, v in rows if i is not None]
    base = [(i, v) for i, v in base if v]
    asked = {}
    for i, v in base:
        if i in queries:
            asked[i] = min(asked.get(i, v), v) if len(asked.get(i, v)) == len(v) else min(asked[i], v, key=len)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in base if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("annulus_rows,chunk", [(2000, 512), (7, 3)])
def test_equals_brute_force(spark, annulus_rows, chunk):
    rng = np.random.default_rng(annulus_rows)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(400)]
    rows += [(400 + i, rows[10][1]) for i in range(120)]  # a third that are equal
    rows += [(600, None), (601, []), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (605, [0.0] * 8),
             (None, [1.0] * 8), (7, rows[7][1]), (30, [9.0] * 8), (700, [1.0, 2.0]), (750, [0.5, -1.0]), (800, [3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    got = top_k(df, df.where("vec_id % 50 = 0"), annulus_rows=annulus_rows, chunk_queries=chunk).collect()
    assert sorted(map(tuple, got)) == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert top_k(df.where("false"), df.where("false")).count() == 0
    assert top_k(df, df.where("false")).count() == 0
    assert top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_pivots_of_equal_vectors():
    assert len(choose_pivots(np.ones((50, 3)), 8)) == 1
