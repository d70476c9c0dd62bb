"""Positions, folds, AUC and quantiles: functions of the values, whatever the physical plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.ranking import exact_quantiles, row_index, running_sums
from tabulon.learn.evaluate import kfold, roc_auc, stratified_kfold
from tabulon.operators import encode as G


@pytest.fixture(params=[("true", 3), ("false", 8), ("false", 200)])
def plan(spark, request):
    reuse, parts = request.param
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_positions_folds_and_auc_with_payload(spark, plan):
    rnd = random.Random(1)
    ids = list(range(4000))
    rnd.shuffle(ids)
    rows = [(i, f"payload {i}", "abc"[i % 7 % 3], rnd.choice([0.5, rnd.random()]), int(rnd.random() < 0.3)) for i in ids]
    df = spark.createDataFrame(rows, "id long, extra string, label string, score double, y int").repartition(11)

    got = {r["id"]: r["_rn"] for r in row_index(df, ["id"]).collect()}
    assert got == {i: i for i in range(4000)}
    grouped = sorted((r["label"], r["_rn"], r["id"]) for r in row_index(df, ["id"], ["label"]).collect())
    assert [n for _, n, _ in grouped] == [k for name in "abc" for k in range(sum(r[2] == name for r in rows))]
    assert [i for _, _, i in grouped] == [i for name in "abc" for i in sorted(r[0] for r in rows if r[2] == name)]

    folds = kfold(df, "id", 7)
    assert folds.columns == df.columns + ["fold"]
    want = {i: f for f, part in enumerate(np.array_split(np.arange(4000), 7)) for i in part.tolist()}
    assert {r["id"]: r["fold"] for r in folds.collect()} == want

    y, s = np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert roc_auc(df, "y", "score").first()["auc"] == pytest.approx(auc, abs=1e-12)


def test_stratified_folds_take_classes_in_order_of_their_first_row(spark):
    labels = ["z", "z", "a", "m", "a", "z", "m", "a", "z", "z", "a", "m", "z"]
    df = spark.createDataFrame([(k, x, "payload") for k, x in enumerate(labels)], "id long, y string, extra string")
    got = {r["id"]: r["fold"] for r in stratified_kfold(df, "id", "y", 3).collect()}
    order = list(dict.fromkeys(labels))
    coded = sorted(order.index(x) for x in labels)
    alloc = [np.bincount(coded[i::3], minlength=3) for i in range(3)]
    want = {}
    for c, x in enumerate(order):
        of = np.repeat(np.arange(3), [alloc[i][c] for i in range(3)])
        want.update(zip([k for k, v in enumerate(labels) if v == x], of.tolist()))
    assert got == want


def test_auc_by_group(spark):
    rows = [(k % 3, (k * 37 % 11) / 10.0, int(k * 7 % 5 < 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "fold int, s double, y int")
    got = {r["fold"]: r["auc"] for r in roc_auc(df, "y", "s", ["fold"]).collect()}
    for f in range(3):
        assert got[f] == pytest.approx(roc_auc(df.where(F.col("fold") == f), "y", "s").first()["auc"])


def test_a_hot_value_is_dealt_over_the_ranges(spark):
    df = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(4000)], "v int, id long").repartition(5)
    got = row_index(df, ["v"], num_partitions=8)
    assert sorted(r["_rn"] for r in got.collect()) == list(range(4000))
    per_task = [r["n"] for r in got.groupBy(F.floor(F.col("_rn") / 500).alias("k")).agg(F.count("*").alias("n")).collect()]
    assert max(per_task) <= 500


def test_running_sums(spark):
    rows = [(k * 17 % 101, k % 5, 1.5) for k in range(101)]
    df = spark.createDataFrame(rows, "k int, a int, b double").repartition(4)
    got = sorted((r["_rn"], r["k"], r["a_before"], r["b_before"]) for r in running_sums(df, ["k"], ["a", "b"]).collect())
    total_a, total_b, want = 0, 0.0, []
    for n, (k, a, b) in enumerate(sorted(rows)):
        want.append((n, k, total_a, total_b))
        total_a, total_b = total_a + a, total_b + b
    assert got == want


@pytest.mark.parametrize("inside_rows", [100_000, 20])
def test_quantiles_by_brackets(spark, inside_rows):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=3000), 2)
    x[:1100] = 0.5  # a hot value
    y = rng.integers(0, 5, 3000).astype(float)
    rows = [(float(a), None if k % 3 == 0 else float(b), float("nan")) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(6)
    probs = [0.0, 0.013, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x", "y", "z"], probs, accuracy=200, inside_rows=inside_rows).collect()}
    want = {("x", q): np.quantile(x, q) for q in probs} | {("y", q): np.quantile([b for _, b, _ in rows if b is not None], q) for q in probs}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_encoders_keep_the_order_of_numbers_and_take_any_number_of_levels(spark):
    df = spark.createDataFrame([(10, 0), (2, 1), (30, 2), (None, 3), (2, 4)], "x int, id int")
    codes = {r["id"]: r["x"] for r in G.LabelEncoder(inputCols=["x"]).fit(df).transform(df).collect()}
    assert codes == {0: 1, 1: 0, 2: 2, 3: None, 4: 0}
    hot = G.OneHotEncoder(inputCols=["x"]).fit(df).transform(df)
    assert hot.columns == ["x_10", "x_30", "id"]
    many = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("x"), "id")
    out = G.LabelEncoder(inputCols=["x"]).fit(many).transform(many)
    assert out.where("x <> (id * 7919) % 3000").count() == 0 and out.count() == 3000


def test_correlations_of_400_columns(spark):
    from tabulon.operators.select import correlation_matrix
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 400)) * np.arange(1, 401) + 1000
    x[:, 7] = 3.0
    x[rng.random(x.shape) < 0.1] = np.nan
    import pandas as pd
    frame = pd.DataFrame(x, columns=[f"c{k}" for k in range(400)])
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in correlation_matrix(df, df.columns).collect()}
    want = frame.corr()
    assert len(got) == 400 * 399 // 2
    for (a, b), r in list(got.items())[::97]:
        w = want.loc[a, b]
        assert (r is None) == bool(np.isnan(w)) and (r is None or abs(r - w) < 1e-9)


def test_ridge_moments_of_many_features_equal_the_expressions(spark, monkeypatch):
    from tabulon.learn import tune as TU
    rng = np.random.default_rng(1)
    rows = [(*map(float, rng.normal(size=3) + 5), int(k % 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    want = TU.ridge_grid_search(df, ["a", "b"], "y", [0.1, 10.0]).collect()
    monkeypatch.setattr(TU, "MOST_EXPRESSIONS", 1)
    got = TU.ridge_grid_search(df, ["a", "b"], "y", [0.1, 10.0]).collect()
    for g, w in zip(got, want):
        assert g["mean_r2"] == pytest.approx(w["mean_r2"]) and g["mean_rmse"] == pytest.approx(w["mean_rmse"]) and g["is_best"] == w["is_best"]


def test_skew_p_value_is_the_complementary_error_function(spark):
    from tabulon.operators.profile import skew_test
    df = spark.createDataFrame([(float(x * x),) for x in range(60)], "v double")
    r = skew_test(df, ["v"]).first()
    # constants: z and p of D'Agostino's test of 0, 1, 4, ..., 3481
    import math
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-14) and 0.01 < r["p_value"] < 0.05
