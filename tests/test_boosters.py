"""Boosted trees against brute force on small tables."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.learn import boosters as B
from tabulon.learn import staged as ST


def table(spark, n=240, d=4, seed=0, missing=0.15, parts=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[rng.random((n, d)) < missing] = np.nan
    clean = np.nan_to_num(x, nan=-0.7)
    y = np.where(clean[:, 0] > 0.2, 3.0, 0.0) + clean[:, 1] * (clean[:, 2] > 0) + rng.normal(size=n) * 0.3
    rows = [(k, *[float(v) for v in x[k]], float(y[k]), float(y[k] > 1.2), k % 3) for k in range(n)]
    cols = [f"x{j}" for j in range(d)]
    df = spark.createDataFrame(rows, ["id", *cols, "y", "c", "fold"]).repartition(parts, "id")
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df), x, y, np.array([k % 3 for k in range(n)])


def grad(y, m, logistic):
    if not logistic:
        return m - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-m))
    return p - y, p * (1 - p)


def best_split(x, g, h, lam, least_weight, least_rows):
    """(gain, feature, threshold, missing_left) by trying everything."""
    score = lambda s, k: s * s / max(k + lam, 1e-300)
    found = (-np.inf, None, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[~np.isnan(x[:, f]), f])
        for t in (values[:-1] + values[1:]) / 2:
            for missing_left in (False, True):
                left = (x[:, f] <= t) | (np.isnan(x[:, f]) & missing_left)
                if min(left.sum(), (~left).sum()) < max(least_rows, 1) or min(h[left].sum(), h[~left].sum()) < least_weight:
                    continue
                gain = (score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())) / 2
                if gain > found[0] + 1e-9:
                    found = (gain, f, t, missing_left)
    return found


def level_wise(x, y, spec, logistic):
    base = y.mean() if not logistic else np.log(y.mean() / (1 - y.mean()))
    m = np.full(len(y), base)
    for _ in range(spec["rounds"]):
        g, h = grad(y, m, logistic)
        out = np.zeros(len(y))

        def grow(rows, depth):
            value = -spec["rate"] * g[rows].sum() / (h[rows].sum() + spec["lam"])
            gain, f, t, ml = best_split(x[rows], g[rows], h[rows], spec["lam"], spec["least_weight"], spec["least_rows"])
            if depth == spec["depth"] or f is None or gain - spec["gamma"] <= 1e-12:
                out[rows] = value
                return
            left = (x[rows, f] <= t) | (np.isnan(x[rows, f]) & ml)
            grow(rows[left], depth + 1)
            grow(rows[~left], depth + 1)

        grow(np.arange(len(y)), 0)
        m = m + out
    return m


def leaf_wise(x, y, spec):
    m = np.full(len(y), y.mean())
    for _ in range(spec["rounds"]):
        g, h = m - y, np.ones(len(y))
        leaves = [np.arange(len(y))]
        while len(leaves) < spec["leaves"]:
            splits = [best_split(x[r], g[r], h[r], spec["lam"], spec["least_weight"], spec["least_rows"]) for r in leaves]
            k = max(range(len(leaves)), key=lambda i: splits[i][0])
            gain, f, t, ml = splits[k]
            if f is None or gain <= 1e-12:
                break
            rows = leaves.pop(k)
            left = (x[rows, f] <= t) | (np.isnan(x[rows, f]) & ml)
            leaves += [rows[left], rows[~left]]
        for rows in leaves:
            m[rows] = m[rows] - spec["rate"] * g[rows].sum() / (h[rows].sum() + spec["lam"])
    return m


def oblivious(x, y, spec):
    m = np.full(len(y), y.mean())
    score = lambda s, k: s * s / (k + spec["lam"])
    for _ in range(spec["rounds"]):
        g = m - y
        leaf = np.zeros(len(y), int)
        for _ in range(spec["depth"]):
            best = (-np.inf, None, None)
            now = sum(score(g[leaf == k].sum(), (leaf == k).sum()) for k in np.unique(leaf))
            for f in range(x.shape[1]):
                values = np.unique(x[~np.isnan(x[:, f]), f])
                for t in (values[:-1] + values[1:]) / 2:
                    right = ~((x[:, f] <= t) | np.isnan(x[:, f]))
                    key = leaf * 2 + right
                    gain = sum(score(g[key == k].sum(), (key == k).sum()) for k in np.unique(key)) - now
                    if gain > best[0] + 1e-9:
                        best = (gain, f, t)
            if best[1] is None or best[0] <= 1e-12:
                break
            leaf = leaf * 2 + ~((x[:, best[1]] <= best[2]) | np.isnan(x[:, best[1]]))
        for k in np.unique(leaf):
            rows = leaf == k
            m[rows] = m[rows] - spec["rate"] * g[rows].sum() / (rows.sum() + spec["lam"])
    return m


def predictions(model, df, column="prediction"):
    return np.array([r[0] for r in model.transform(df).orderBy("id").select(column).collect()])


def test_second_order_trees_equal_brute_force(spark):
    df, x, y, _ = table(spark)
    est = B.SecondOrderBooster(n_estimators=4, max_depth=3, learning_rate=0.4, reg_lambda=2.0, gamma=0.5, min_child_weight=5.0, labelCol="y")
    assert np.allclose(predictions(est.fit(df), df), level_wise(x, y, est.spec(), False))


def test_logistic_trees_equal_brute_force(spark):
    df, x, y, _ = table(spark, seed=2)
    est = B.SecondOrderBooster(n_estimators=3, max_depth=2, learning_rate=0.5, min_child_weight=0.3, labelCol="c", classification=True)
    model = est.fit(df)
    margin = level_wise(x, (y > 1.2).astype(float), est.spec(), True)
    assert np.allclose([v[1] for v in predictions(model, df, "probability")], 1 / (1 + np.exp(-margin)))
    assert np.array_equal(predictions(model, df), (margin > 0).astype(float))


def test_leaf_wise_order_equals_brute_force(spark):
    df, x, y, _ = table(spark, seed=3)
    for leaves in (2, 7, 12):
        est = B.LeafWiseBooster(n_estimators=3, num_leaves=leaves, learning_rate=0.3, min_child_samples=6, reg_lambda=0.5, labelCol="y")
        assert np.allclose(predictions(est.fit(df), df), leaf_wise(x, y, est.spec())), leaves


def test_oblivious_trees_equal_brute_force(spark):
    df, x, y, _ = table(spark, seed=4)
    est = B.ObliviousBooster(n_estimators=3, max_depth=3, learning_rate=0.5, labelCol="y")
    assert np.allclose(predictions(est.fit(df), df), oblivious(x, y, est.spec()))


@pytest.mark.parametrize("kind", [B.SecondOrderBooster, B.LeafWiseBooster, B.ObliviousBooster])
def test_folds_in_common_passes_equal_single_fits(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 50)
    monkeypatch.setattr(B, "MOST_NUMBERS", 4000)
    monkeypatch.setattr(B, "DIRECT_TASKS", 1)
    df, *_ = table(spark, seed=5)
    est = kind(n_estimators=5, max_depth=2, num_leaves=4, subsample=0.99999, colsample_bytree=0.5, min_child_samples=2, labelCol="y")
    found = B.fit_folds([est, kind(n_estimators=2, max_depth=1, num_leaves=3, labelCol="y")], df, [0, 1, 2], "fold", full=True)[0]
    cuts = [str(t["threshold"]) for t in found[None]._state()["trees"]]
    assert np.allclose(predictions(found[None], df), predictions(est.fit(df), df)) and cuts
    for f in range(3):
        alone = B.fit_together(df, "features", "y", [est.spec(f)], "fold")[0]
        assert np.allclose(predictions(found[f], df), predictions(est.model(alone), df))


@pytest.mark.parametrize("kind", [B.SecondOrderBooster, B.LeafWiseBooster, B.ObliviousBooster])
@pytest.mark.parametrize("classification", [False, True])
def test_a_model_grown_in_one_task_is_that_of_passes(spark, monkeypatch, kind, classification):
    """The same trees from one task that holds all blocks, without a pass, and from passes of a few models at a time."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    df, *_ = table(spark, seed=9, parts=1)
    est = kind(n_estimators=11, max_depth=3, num_leaves=6, subsample=0.8, colsample_bytree=0.7, min_child_samples=2, labelCol="c" if classification else "y",
               classification=classification)
    passes, run = [], B._run
    monkeypatch.setattr(B, "_run", lambda *a: passes.append(a[4]) or run(*a))
    whole = B.fit_folds([est], df, [0, 1, 2], "fold", full=True)[0]
    assert not passes
    monkeypatch.setattr(B, "WHOLE_BYTES", 0)
    monkeypatch.setattr(B, "MODELS", 3)
    by_passes = B.fit_folds([est], df, [0, 1, 2], "fold", full=True)[0]
    assert set(passes) == {1, 3} and list(whole) == list(by_passes) == [0, 1, 2, None]
    for f in whole:
        assert whole[f]._state() == by_passes[f]._state() and len(whole[f]._state()["trees"]) == 11


def test_a_saved_model_is_whole_and_staged(spark, tmp_path):
    df, x, y, _ = table(spark, seed=6)
    est = B.LeafWiseBooster(n_estimators=6, num_leaves=5, labelCol="y")
    model = est.fit(df)
    model.save(f"{tmp_path}/m")
    assert np.allclose(predictions(B.BoosterModel.load(f"{tmp_path}/m"), df), predictions(model, df))
    staged = ST.staged_sums(ST.read_trees(model), x, [0, 2, 6])
    assert np.allclose(staged[:, 0], y.mean()) and np.allclose(staged[:, 2], predictions(model, df))
    two = B.LeafWiseBooster(n_estimators=2, num_leaves=5, labelCol="y").fit(df)
    assert np.allclose(staged[:, 1], predictions(two, df))
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_many_values_are_binned_by_weight(spark):
    rng = np.random.default_rng(1)
    x, w = rng.exponential(size=20000), rng.random(20000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "x double, w double").repartition(5)
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    cuts = B.weighted_cuts(v, "features", 1, 32, "w")[0]
    assert len(cuts) == 31
    share = np.histogram(x, np.concatenate([[-1], cuts, [np.inf]]), weights=w)[0] / w.sum()
    assert np.abs(share - 1 / 32).max() < 0.003


def test_ordered_statistics_never_see_their_own_row(spark):
    rng = np.random.default_rng(2)
    rows = [(k, None if k % 11 == 0 else ["hot", "hot", "a", "b"][rng.integers(4)], None if k % 13 == 0 else float(rng.integers(5))) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    got = {r["id"]: r["c_ts"] for r in B.ordered_target_statistics(df, ["c"], "y", ["id"]).collect()}
    import hashlib
    prior = np.mean([r[2] for r in rows if r[2] is not None])
    for level in {r[1] for r in rows}:
        total, n = 0.0, 0
        for r in sorted((r for r in rows if r[1] == level), key=lambda r: (hashlib.md5(f"0:{r[0]}".encode()).hexdigest(), r[0])):
            assert abs(got[r[0]] - (total + prior) / (n + 1)) < 1e-9
            if r[2] is not None:
                total, n = total + r[2], n + 1
    enc = B.OrderedTargetEncoder(["c"], "y", ["id"])
    assert enc.fit_transform(df).count() == 400
    new = enc.transform(spark.createDataFrame([(1, "a"), (2, "never"), (3, None)], "id long, c string"))
    want = {lvl: (sum(r[2] or 0 for r in rows if r[1] == lvl) + prior) / (sum(r[2] is not None for r in rows if r[1] == lvl) + 1) for lvl in ("a", None)}
    assert {r["id"]: round(r["c_ts"], 9) for r in new.collect()} == {1: round(want["a"], 9), 2: round(prior, 9), 3: round(want[None], 9)}


def test_no_label_and_no_rows(spark):
    df, *_ = table(spark, n=30)
    est = B.SecondOrderBooster(n_estimators=2, labelCol="y")
    part = df.withColumn("y", F.when(F.col("id") < 20, F.col("y")))
    assert np.allclose(predictions(est.fit(part), df), predictions(est.fit(df.where("id < 20")), df))
    with pytest.raises(ValueError):
        est.fit(df.limit(0))


def test_walk_ends_in_the_leaf_of_each_row():
    rng = np.random.default_rng(4)
    n, d = 700, 5
    x = rng.integers(0, 256, (n, d)).astype(np.uint8)
    x[rng.random((n, d)) < 0.2] = B.MISSING
    for depth in (0, 1, 3, 4, 9):
        tree, todo = B._Tree(), [(0, 0)]
        while todo:
            node, level = todo.pop()
            if level < depth and (level < 2 or rng.random() < 0.7):
                todo += [(child, level + 1) for child in tree.split(node, rng.integers(d), rng.integers(0, 255), rng.random() < 0.5, 1.0)]
        feature, last, missing_left, left, right, _ = arrays = tree.arrays()
        want = []
        for row in x:
            node = 0
            while feature[node] >= 0:
                value = row[feature[node]]
                low = missing_left[node] if value == B.MISSING else value <= last[node]
                node = left[node] if low else right[node]
            want.append(node)
        walk, begins = B._Walk(arrays), np.arange(n) * d
        some = np.flatnonzero(rng.random(n) < 0.3)
        assert walk(x.ravel(), begins).tolist() == want and walk(x.ravel(), begins[some]).tolist() == np.array(want)[some].tolist()
        assert len(walk(x.ravel(), begins[:0])) == 0
