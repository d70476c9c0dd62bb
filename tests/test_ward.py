"""Ward trees against the definition on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.learn import segment as K
from tabulon.learn import ward as W


def exact(x):
    """Heights and clusters by trying all pairs of groups at each step."""
    groups, heights, states = [[i] for i in range(len(x))], [], []
    while len(groups) > 1:
        states.append([sorted(g) for g in groups])
        best = (np.inf, 0, 0)
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[groups[i]], x[groups[j]]
                h = 2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if h < best[0]:
                    best = (h, i, j)
        h, i, j = best
        heights.append(np.sqrt(h))
        groups[j] += groups.pop(i)
    return heights, states


@pytest.mark.parametrize("seed", range(4))
def test_tree_of_single_rows_is_the_exact_one(seed):
    x = np.random.default_rng(seed).normal(size=(40, 3)) * [1, 5, 0.2]
    heights, states = exact(x)
    merges = W.ward_merges(np.ones(40), x)
    assert np.allclose(merges[:, 2], heights) and (np.diff(merges[:, 2]) >= -1e-9).all()
    for k in (2, 3, 7, 40):
        got = W.cut(merges, 40, k)
        assert sorted(np.flatnonzero(got == c).tolist() for c in range(k)) == sorted(states[40 - k])


def test_groups_of_rows_merge_like_their_rows():
    rng = np.random.default_rng(7)
    centre, n = rng.normal(size=(12, 2)) * 10, rng.integers(1, 6, 12)
    x = np.repeat(centre, n, axis=0)
    heights, _ = exact(x)
    assert np.allclose(W.ward_merges(n, centre)[:, 2], [h for h in heights if h > 1e-9])


def test_rows_of_a_table(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)) + c for c in ([0, 0], [20, 0], [0, 30])])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id long, a double, b double").repartition(5)
    seg, tree = K.ward_segments(df.where("id < 900"), ["a", "b"], 3)
    rows = {r["id"]: r["hsegment"] for r in seg.collect()}
    assert len({rows[k] for k in range(30)}) == len({rows[k] for k in range(30, 60)}) == len({rows[k] for k in range(60, 90)}) == 1 and len(set(rows.values())) == 3
    assert np.allclose([r["height"] for r in tree.table().orderBy("step").collect()], exact(x)[0])
    assert tree.labels(df, 3).where("id = 900").first()["cluster"] is None


def test_many_rows_in_few_summaries(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(n, 2)) + c for n, c in ((3000, [0, 0]), (500, [25, 0]), (200, [0, 40]), (60, [60, 60]))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double").repartition(6)
    tree = W.WardTree(df, ["a", "b"], most=50)
    assert len(tree.n) <= 50 and tree.n.sum() == len(x) and np.allclose((tree.n[:, None] * tree.centres).sum(0), x.sum(0))
    assert (np.diff(tree.merges[:, 2]) >= -1e-9).all()
    sizes = sorted(r["n"] for r in tree.labels(df, 4).groupBy("cluster").agg(F.count("id").alias("n")).collect())
    assert sizes == [60, 200, 500, 3000]


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, a double")
    assert W.WardTree(df, ["a"]).labels(df, 3).first()["cluster"] == 0
    assert W.WardTree(df.limit(0), ["a"]).table().count() == 0
