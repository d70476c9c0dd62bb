"""Trees to purity: no training error without ties, tops and subtrees, forests, saved models."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.learn import fulltree as T


def table(spark, n=600, d=3, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.sin(3 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=n) * 0.1
    rows = [(k, *[float(v) for v in x[k]], float(y[k]), float(y[k] > 0.8)) for k in range(n)]
    cols = [f"x{j}" for j in range(d)]
    df = spark.createDataFrame(rows, ["id", *cols, "label", "c"]).repartition(parts, "id")
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df), x, y


def predictions(model, df, column="prediction"):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(column).collect()])


@pytest.mark.parametrize("finish", [20_000, 100, 7])
def test_no_training_error_without_ties(spark, finish):
    df, x, y = table(spark)
    model = T.FullForest(finish_rows=finish).fit(df)
    assert np.allclose(predictions(model, df), y)
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    labels = T.FullForest(finish_rows=finish, classification=True, labelCol="c").fit(df)
    assert np.array_equal(predictions(labels, df), (y > 0.8).astype(float))


def test_the_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(60, 3)), 1), rng.normal(size=60)
    w = rng.integers(1, 4, 60).astype(float)
    feature, threshold, *_ = T.grow_exact(x, y, w, 3, (0,))

    def spread(rows):
        return (w[rows] * (y[rows] - np.average(y[rows], weights=w[rows])) ** 2).sum() if rows.any() else 0.0

    best = min((spread(x[:, f] <= t) + spread(x[:, f] > t), f) for f in range(3) for t in np.unique(x[:, f])[:-1])
    left = x[:, feature[0]] <= threshold[0]
    assert spread(left) + spread(~left) == pytest.approx(best[0])


def _by_node(x, y, w, rows, min_leaf):
    """Leaf value of each row of a tree that is grown node by node."""
    out = np.full(len(rows), (w[rows] * y[rows]).sum() / w[rows].sum())
    best = (-np.inf,)
    for f in range(x.shape[1]):
        for t in np.unique(x[rows, f])[:-1]:
            left = x[rows, f] <= t
            if min(left.sum(), (~left).sum()) >= min_leaf:
                a, b = rows[left], rows[~left]
                gain = (w[a] * y[a]).sum() ** 2 / w[a].sum() + (w[b] * y[b]).sum() ** 2 / w[b].sum()
                best = max(best, (gain, f, t))
    if len(rows) >= 2 and y[rows].min() < y[rows].max() and best[0] > -np.inf:
        left = x[rows, best[1]] <= best[2]
        out[left], out[~left] = _by_node(x, y, w, rows[left], min_leaf), _by_node(x, y, w, rows[~left], min_leaf)
    return out


def test_nodes_of_one_size_are_divided_together(monkeypatch):
    rng = np.random.default_rng(4)
    for n, min_leaf in ((1, 1), (150, 1), (150, 3)):
        x, y, w = np.round(rng.normal(size=(n, 3)), 2), rng.normal(size=n), rng.integers(1, 4, n).astype(float)
        for most in (1 << 16, 1):
            monkeypatch.setattr(T, "BATCH_NUMBERS", most)
            feature, threshold, left, right, value, gains = T.grow_exact(x, y, w, 3, (0,), 2, min_leaf)
            at = np.zeros(n, int)
            for _ in range(n):
                go = x[np.arange(n), np.array(feature)[at]] <= np.array(threshold)[at]
                at = np.where(np.array(feature)[at] < 0, at, np.where(go, np.array(left)[at], np.array(right)[at]))
            got, want = np.array(value)[at], _by_node(x, y, w, np.arange(n), min_leaf)
            # a pair of rows that several columns part has one tree of several
            assert np.allclose(got, want) and np.isclose(gains.sum(), (w * want ** 2).sum() - (w * y).sum() ** 2 / w.sum())
    monkeypatch.setattr(T, "BATCH_NUMBERS", 1 << 16)
    x, y = rng.normal(size=(4000, 2)), rng.normal(size=4000)
    steps = []

    class Counted:
        def __getattr__(self, name):
            steps.append(name)
            return getattr(np, name)

    monkeypatch.setattr(T, "np", Counted())
    inner = sum(f >= 0 for f in T.grow_exact(x, y, np.ones(4000), 2, (0,))[0])
    assert inner == 3999 and steps.count("cumsum") < inner / 5  # was two for each node


def test_splits_found_in_tasks_are_those_of_the_driver(spark, monkeypatch):
    df, x, y = table(spark, seed=6)
    found = []
    for most in (10 ** 6, 0):
        monkeypatch.setattr(T, "DRIVER_SUMS", most)
        model = T.FullForest(n_estimators=3, bootstrap=True, max_features=2, seed=2, finish_rows=40).fit(df)
        found.append((model.tops, predictions(model, df).tolist()))
    assert found[0] == found[1] and len(found[0][0][0]["feature"]) > 5


def test_equal_rows_and_fine_values(spark):
    # values that common bins cannot tell apart, equal rows of different labels, and one hot value
    rows = [(k, 1.0 + k * 1e-9 if k < 400 else 5.0, float(k % 2)) for k in range(900)] + [(900 + k, 1000.0 * k, 3.0) for k in range(300)]
    df = VectorAssembler(inputCols=["x0"], outputCol="features").transform(spark.createDataFrame(rows, "id long, x0 double, label double"))
    got = predictions(T.FullForest(finish_rows=50).fit(df), df)
    assert np.allclose(got[:400], [k % 2 for k in range(400)]) and np.allclose(got[400:900], 0.5) and np.allclose(got[901:], 3.0)


def test_forest_draws_repeat_and_improve(spark, monkeypatch, tmp_path):
    ids = np.arange(200_000)
    w = T.draws(ids, 3, 7, True)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and not np.array_equal(w, T.draws(ids, 4, 7, True))
    df, x, y = table(spark, seed=3)
    train, test = df.where("id < 400"), df.where("id >= 400")
    one = T.FullForest(n_estimators=12, bootstrap=True, max_features=2, seed=5).fit(train)
    got = predictions(one, test)
    assert np.allclose(got, predictions(T.FullForest(n_estimators=12, bootstrap=True, max_features=2, seed=5).fit(train), test))
    alone = predictions(T.FullForest().fit(train), test)
    assert ((got - y[400:]) ** 2).mean() < ((alone - y[400:]) ** 2).mean()
    small = T.FullForest(n_estimators=5, bootstrap=True, max_features=2, seed=5, finish_rows=60).fit(train)
    want = predictions(small, test)
    small.save(f"{tmp_path}/forest")
    monkeypatch.setattr(T, "SMALL_NODES", 0)  # rows and subtrees are joined
    monkeypatch.setattr(T, "FINISH_ROWS", 20)
    assert np.allclose(predictions(small, test), want)
    assert np.allclose(predictions(T.FullForestModel.load(f"{tmp_path}/forest"), test), want)


def test_no_rows(spark):
    df, *_ = table(spark, n=20)
    with pytest.raises(ValueError):
        T.FullForest().fit(df.limit(0))
    part = df.withColumn("label", F.when(F.col("id") < 10, F.col("label")))
    assert T.FullForest().fit(part).transform(df).where("prediction is null").count() == 0
