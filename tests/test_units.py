"""Unit tests on hand-written rows (FIXTURES.md section 4); expected values written by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions import exact_quantiles, column_modes, row_index
from tabulon.learn import ensemble as N
from tabulon.learn import evaluate as T
from tabulon.operators import clean as C
from tabulon.operators import encode as G
from tabulon.operators import features as X
from tabulon.operators import profile as P
from tabulon.operators import shape as S

TINY = [1, 2, 2, 3, 7, 9, 9, 20]


@pytest.fixture(scope="module")
def tiny_num(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(TINY)], "id bigint, x double")


def test_quantile_interpolated(tiny_num):
    q = {r["prob"]: r["value"] for r in exact_quantiles(tiny_num, ["x"], [0.1, 0.5, 1.0, 0.0]).collect()}
    assert q[0.1] == pytest.approx(1.7)
    assert q[0.5] == pytest.approx(5.0)
    assert q[0.0] == 1.0 and q[1.0] == 20.0


def test_quantile_approx_option(tiny_num):
    q = {r["prob"]: r["value"] for r in exact_quantiles(tiny_num, ["x"], [0.5], approx=True).collect()}
    assert q[0.5] in TINY


def test_summary_moments(tiny_num):
    r = P.num_summary(tiny_num, ["x"], [0.1]).first()
    assert r["std"] == pytest.approx(6.300510, abs=1e-6)
    assert r["q10"] == pytest.approx(1.7)
    sk = P.skew_G1(tiny_num, ["x"]).first()["skew"]
    assert sk == pytest.approx(1.520131, abs=1e-6)
    g1 = P.skew_test(tiny_num, ["x"]).first()["skew"]
    assert g1 == pytest.approx(1.218816, abs=1e-6)


def test_mode_smallest_on_tie(tiny_num):
    m = column_modes(tiny_num, ["x"], value_type="double").first()
    assert m["mode"] == 2.0 and m["count"] == 2


def test_standard_scaler_population_std(tiny_num):
    out = G.StandardScaler(inputCols=["x"]).fit(tiny_num).transform(tiny_num)
    r = out.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert r["m"] == pytest.approx(0.0, abs=1e-12) and r["s"] == pytest.approx(1.0)
    first = out.orderBy("id").first()["x"]
    assert first == pytest.approx((1 - 6.625) / 5.893588, abs=1e-6)


def test_constant_column_scalers(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r.x for r in G.StandardScaler(inputCols=["x"]).fit(df).transform(df).collect()] == [0.0, 0.0]
    assert [r.x for r in G.MinMaxScaler(inputCols=["x"]).fit(df).transform(df).collect()] == [0.0, 0.0]


def test_group_mean_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 4.0)], "k string, v double")
    out = sorted(X.group_mean(df, "v", "k", "m").collect(), key=lambda r: r.v)
    assert [r.m for r in out] == [None, None, 4.0]


def test_outer_merge_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1.0, 2)], "k double, a bigint")
    b = spark.createDataFrame([(None, 3), (1.0, 4)], "k double, b bigint")
    rows = {(r.k, r.a, r.b) for r in S.outer_merge(a, b, ["k"]).collect()}
    assert rows == {(1.0, 2, 4), (None, 1, 3)}


def test_outer_merge_unmatched_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k int, b double")
    rows = {(r.k, r.a, r.b) for r in S.outer_merge(a, b, ["k"]).collect()}
    assert rows == {(1, "x", None), (2, "y", 20.0), (3, None, 30.0)}


def test_qcut_right_closed(spark):
    xs = [2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, x double")
    out = X.quantile_bins(df, "x", 3, name="b").orderBy("id").collect()
    assert [r.b for r in out] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_qcut_edge_value(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5] * 4], "x double")
    out = X.quantile_bins(df, "x", 2, name="b").where("x = 3").select("b").distinct().collect()
    assert [r.b for r in out] == [0]


def test_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 10, "x double")
    with pytest.raises(Exception):
        X.quantile_bins(df, "x", 3, name="b").collect()


def test_cap_truncates_and_rounds(spark):
    df = spark.createDataFrame([(-10.0,), (0.0,), (10.0,)], "x double")
    m = C.OutlierCapperModel()
    m._set(inputCols=["x"], mode="both")
    m._set_state({"x": [-2.7, 2.5]})
    assert [r.x for r in m.transform(df).collect()] == [-2.0, 0.0, 2.0]
    m._set(mode="upper")
    assert [r.x for r in m.transform(df).collect()] == [-10.0, 0.0, 2.0]


def test_capped_values_within_original_limits(spark):
    df = spark.range(200).select((F.col("id") * F.col("id") / 100.0).alias("x"))
    lim = C.outlier_limits(df, ["x"], 0.25, 0.75).first()
    capped = C.cap_outliers(df, ["x"], 0.25, 0.75)
    r = capped.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert r.hi <= math.trunc(lim.up) and r.lo >= math.trunc(lim.low)


def test_one_hot_drop_first_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    out = G.OneHotEncoder(inputCols=["c"]).fit(df).transform(df)
    assert out.columns == ["c_b", "c_c"]
    sums = [r.c_b + r.c_c for r in out.collect()]
    assert max(sums) <= 1 and sorted(sums) == [0, 0, 1, 1]


def test_label_encoder_sorted(spark):
    df = spark.createDataFrame([("No",), ("Yes",), ("No",), (None,)], "c string")
    out = [r.c for r in G.LabelEncoder(inputCols=["c"]).fit(df).transform(df).collect()]
    assert out == [0, 1, 0, None]


def test_rare_encoder_keeps_missing(spark):
    rows = [("a",)] * 8 + [("b",)] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    out = [r.c for r in C.rare_encode(df, ["c"], 0.15).collect()]
    assert out.count("Rare") == 1 and out.count(None) == 1 and out.count("a") == 8


def test_not_equal_keeps_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert S.not_equal_keep_null(df, "x", 1).count() == 2


def test_row_stats_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    r = X.row_stats(df, ["a", "b", "c"], ["mean", "sum", "std", "median", "min", "max"]).collect()
    assert r[0]["mean"] == 2.0 and r[0]["sum"] == 4.0 and r[0]["median"] == 2.0
    assert r[0]["std"] == pytest.approx(math.sqrt(2.0))
    assert r[1]["mean"] is None and r[1]["sum"] == 0.0 and r[1]["min"] is None


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    out = [r.r for r in df.select(X.ratio("a", "b").alias("r")).collect()]
    assert out == [None, None, 0.5]


def test_auc_ties_average(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = T.roc_auc(df, "y", "s").first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)


def test_blend_weights_brute_force(spark):
    rows = [(1.0, 1.1, 0.7, 1.5), (2.0, 2.3, 1.8, 2.6), (3.0, 2.7, 3.4, 3.1), (4.0, 4.4, 3.9, 4.2),
            (5.0, 5.2, 4.4, 5.9), (6.0, 5.7, 6.3, 6.4)]
    df = spark.createDataFrame(rows, "y double, p1 double, p2 double, p3 double")
    best = N.best_blend_weights(df, "y", ["p1", "p2", "p3"]).first()
    grid = N.weight_grid()
    assert len(grid) == 36
    scores = [math.sqrt(sum((w[0] * a + w[1] * b + w[2] * c - y) ** 2 for y, a, b, c in rows) / len(rows))
              for w in grid]
    i = min(range(36), key=lambda j: (round(scores[j], 12), j))
    assert (best.w1, best.w2, best.w3) == pytest.approx(grid[i])
    assert best.rmse == pytest.approx(scores[i]) and all(best.rmse <= s + 1e-12 for s in scores)


def _sklearn_stratified(y, k):
    """Reference algorithm of unshuffled StratifiedKFold, from its public description."""
    classes = sorted(set(y))
    enc = [classes.index(v) for v in y]
    order = sorted(enc)
    alloc = [[sum(1 for p in range(i, len(order), k) if order[p] == c) for c in range(len(classes))]
             for i in range(k)]
    folds = [None] * len(y)
    for c in range(len(classes)):
        seq = [f for f in range(k) for _ in range(alloc[f][c])]
        idx = [i for i, v in enumerate(enc) if v == c]
        for i, f in zip(idx, seq):
            folds[i] = f
    return folds


def test_stratified_kfold_matches_algorithm(spark):
    y = [0, 1, 1, 0, 2, 0, 1, 0, 0, 2, 1, 0, 0, 0, 1, 2, 2, 0, 1, 0, 0, 1, 0]
    df = spark.createDataFrame(list(enumerate(y)), "id int, y int")
    for k in (2, 3, 5):
        out = {r.id: r.fold for r in T.stratified_kfold(df, "id", "y", k).collect()}
        assert [out[i] for i in range(len(y))] == _sklearn_stratified(y, k)


def test_kfold_blocks(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    out = {r.k: r.fold for r in T.kfold(df, "k", 3).collect()}
    assert [out[i] for i in range(11)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_row_index_partition_independent(spark, parts):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v")).repartition(parts)
    r = sorted((x.v, x.r) for x in row_index(df, ["v"], name="r", num_partitions=parts).collect())
    assert r == [(i, i) for i in range(100)]


def test_rfm_and_seconds(spark):
    df = spark.createDataFrame([("2021-01-01 00:00:00", "2021-01-11 12:00:00", 2, 1, 10.0, 5.0)],
                               "f string, l string, a int, b int, x double, y double") \
        .select(F.to_timestamp_ntz("f").alias("f"), F.to_timestamp_ntz("l").alias("l"), "a", "b", "x", "y")
    r = X.rfm(df, "f", "l", ["a", "b"], ["x", "y"]).first()
    assert r.recency == 2 and r.tenure == 10 and r.tenure_seconds == 10.5 * 86400
    assert r.frequency == 3 and r.monetary == 15.0


def test_missing_table_ratio_half_even(spark):
    df = spark.createDataFrame([(None,)] + [(1,)] * 7, "x int")
    r = P.missing_table(df).first()
    assert r.n_miss == 1 and r.ratio == 12.5


def test_column_kinds_invariant(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", f"id{i}", float(i % 4)) for i in range(30)],
                               "a int, b string, c string, d double")
    kinds = {r.feature: r.kind for r in P.column_kinds(df).collect()}
    assert kinds == {"a": "num", "b": "cat", "c": "cardinal", "d": "cat"}
    assert len(kinds) == len(df.columns)


def test_knn_exact_against_brute_force(spark):
    import numpy as np
    from tabulon.learn.knn import knn_classify, knn_regress
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 10, size=(4, 3))
    pts = np.vstack([c + rng.normal(0, 1, size=(60, 3)) for c in centers] + [rng.normal(0, 30, size=(10, 3))])
    labels = [int(i % 3) for i in range(len(pts))]
    rows = [(i, [float(v) for v in p], labels[i]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    got = {r.id: r.prediction for r in knn_classify(df, df, "id", "v", "y", k=5, exclude_self=True,
                                                   n_pivots=8).collect()}
    reg = {r.id: r.prediction for r in knn_regress(df, df, "id", "v", "y", k=5, exclude_self=True,
                                                  n_pivots=8).collect()}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(axis=1))
        order = sorted((d[j], j) for j in range(len(pts)) if j != i)[:5]
        ys = [labels[j] for _, j in order]
        counts = {v: ys.count(v) for v in set(ys)}
        best = min(counts, key=lambda v: (-counts[v], v))
        assert got[i] == best
        assert reg[i] == pytest.approx(sum(ys) / 5)


def test_quantiles_with_one_hot_value(spark):
    # a third of the rows share one value; the sort still spreads them (tiebreak) and
    # the interpolated quantiles stay exact
    vals = [5.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.25, 0.5, 0.9]).collect()}
    import numpy as np
    for p in (0.25, 0.5, 0.9):
        assert q[p] == pytest.approx(float(np.quantile(vals, p)))


def test_ridge_grid_search_matches_direct_fits(spark):
    import numpy as np
    from tabulon.learn.tune import ridge_grid_search
    rng = np.random.default_rng(5)
    X = rng.normal(size=(120, 3)) * [1.0, 10.0, 100.0] + [5.0, -3.0, 1000.0]
    y = X @ [2.0, -0.5, 0.03] + rng.normal(size=120) * 2 + 7
    fold = np.arange(120) % 4
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t), int(f))
                                for (a, b, c), t, f in zip(X, y, fold)], "a double, b double, c double, y double, fold int")
    alphas = [0.01, 1.0, 100.0]
    got = {r.alpha: (r.mean_r2, r.mean_rmse) for r in ridge_grid_search(df, ["a", "b", "c"], "y", alphas).collect()}
    for al in alphas:
        r2s, rmses = [], []
        for f in range(4):
            tr, va = fold != f, fold == f
            mx, my = X[tr].mean(0), y[tr].mean()
            Xc = X[tr] - mx
            w = np.linalg.solve(Xc.T @ Xc + al * np.eye(3), Xc.T @ (y[tr] - my))
            pred = (X[va] - mx) @ w + my
            res = y[va] - pred
            r2s.append(1 - (res ** 2).sum() / ((y[va] - y[va].mean()) ** 2).sum())
            rmses.append(np.sqrt((res ** 2).mean()))
        assert got[al][0] == pytest.approx(np.mean(r2s), rel=1e-9)
        assert got[al][1] == pytest.approx(np.mean(rmses), rel=1e-9)


def test_adaboost_samme_learns_a_threshold(spark):
    from pyspark.ml.feature import VectorAssembler
    from tabulon.learn.models import AdaBoostSAMME
    rows = [(float(i), 1.0 if (i % 20) >= 12 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("x2", F.col("x") % 20))
    df = VectorAssembler(inputCols=["x2"], outputCol="f2").transform(df).drop("features").withColumnRenamed("f2", "features")
    model = AdaBoostSAMME(n_estimators=5, checkpoint_every=2).fit(df)
    out = model.transform(df)
    acc = out.where(F.col("prediction") == F.col("label")).count() / 200
    assert set(r.prediction for r in out.select("prediction").distinct().collect()) <= {0.0, 1.0}
    assert acc == 1.0


def test_group_mean_and_merge_with_hot_key(spark):
    # one key holds a third of the rows on the big side
    rows = [(0 if i % 3 == 0 else i, float(i)) for i in range(3000)]
    big = spark.createDataFrame(rows, "k int, v double").repartition(7)
    out = X.group_mean(big, "v", "k", "m").where("k = 0").select("m").distinct().collect()
    assert len(out) == 1 and out[0].m == pytest.approx(sum(v for k, v in rows if k == 0) / 1000)
    small = spark.createDataFrame([(0, "hot"), (1, "one"), (99999, "none")], "k int, tag string")
    merged = S.outer_merge(big, small, ["k"])
    assert merged.count() == 3000 + 1  # every big row once, plus the unmatched small row
    assert merged.where("k = 0 and tag = 'hot'").count() == 1000
