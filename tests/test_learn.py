"""Estimators as Params, booster defaults, stacking and comparisons."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon.learn import models as M
from tabulon.learn import tune as TU


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, float(k % 17), float(k * 7 % 23), 3.0 * (k % 17) - 0.5 * (k * 7 % 23) + (k % 3), k % 3) for k in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, fold int").withColumn("c", (F.col("y") > 15).cast("double")).cache()


def test_linear_estimators_copy_tune_and_persist(spark, data, tmp_path):
    est = M.Ridge(alpha=5.0).copy()
    assert est.getOrDefault("alpha") == 5.0 and est.setFeaturesCol("f").getOrDefault("featuresCol") == "f"
    M.ElasticNet(alpha=2.0, l1_ratio=0.3).save(f"{tmp_path}/enet")
    assert M.ElasticNet.load(f"{tmp_path}/enet").getOrDefault("l1_ratio") == 0.3
    model, table = TU.grid_search(M.ElasticNet(), {"alpha": [0.01, 10.0], "l1_ratio": [0.2, 0.9]}, data, ["a", "b"], "y")
    assert table.count() == 4 and '"alpha": 0.01' in table.where("is_best = 1").first()["params"]
    _, table = TU.grid_search(M.LogisticC(), {"C": [0.1, 1.0]}, data, ["a", "b"], "c", task="classification", metric="roc_auc")
    assert all(r["score"] > 0.9 for r in table.collect())


def test_tuned_models_have_a_holdout_score(data):
    out = TU.tune_models({"ridge": (M.Ridge(), {"alpha": [0.1, 100.0]})}, data.where("id < 200"), ["a", "b"], "y", holdout=data.where("id >= 200"))
    r = out.first()
    assert r["score"] > 0.9 and 0 < r["holdout"] < 3


def test_boosters_differ_and_take_the_names_of_their_parameters(data):
    assert len({type(M.regressor(n)) for n in M.BOOSTERS}) == 3
    assert M.classifier("lgbm", colsample_bytree=0.5).spec()["columns"] == 0.5
    assert M.regressor("catboost", iterations=7, depth=3, l2_leaf_reg=2.0).spec()["rounds"] == 7
    assert M.regressor("gbm", n_estimators=4, max_features=1).getFeatureSubsetStrategy() == "1.0"
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    preds = [tuple(r["prediction"] for r in M.regressor(n, labelCol="y", n_estimators=3).fit(df).transform(df).orderBy("id").collect())
             for n in M.BOOSTERS]
    assert len(set(preds)) == 3


def test_missing_features_are_an_error(spark, data):
    bad = data.withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a")))
    with pytest.raises(Exception):
        M.fit_predict(M.regressor("lr", labelCol="y"), bad, bad, ["a", "b"])[1].collect()


def test_stacking_over_the_ridge_family(spark, data):
    st = TU.StackingRegressor([M.Ridge(), M.Lasso(alpha=0.1), M.regressor("cart", max_depth=4)], ["a", "b"], "y")
    one = [r["prediction"] for r in st.fit(data).transform(data).orderBy("id").collect()]
    spark.catalog.clearCache()
    two = [r["prediction"] for r in st.fit(data).transform(data).orderBy("id").collect()]
    assert one == pytest.approx(two) and all(abs(p - r["y"]) < 3 for p, r in zip(one, data.orderBy("id").collect()))


def test_stacking_scores_each_row_once(spark, data):
    """The penalty and the meta model read predictions held; rows that have the base models' take the same prediction."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def first(v):
        seen.add(1)
        return float(v[0])

    class Counted:
        def copy(self):
            return Counted()

        def setFeaturesCol(self, _):
            return self

        setLabelCol = setFeaturesCol

        def setPredictionCol(self, name):
            self.name = name
            return self

        def fit(self, _):
            return self

        def transform(self, df):
            return df.withColumn(self.name, first("features"))

    TU.StackingRegressor([Counted()], ["a", "b"], "y").fit(data)
    assert seen.value == 300
    model = TU.StackingRegressor([M.Ridge(), M.Ridge(alpha=50.0)], ["a", "b"], "y").fit(data)
    rows = model.transform(data)
    for i, base in enumerate(model.bases):
        rows = base.copy().setPredictionCol(f"p{i}").transform(M.assemble(["a", "b"]).transform(rows.drop("features")))
    again = model.stacked(rows.withColumnRenamed("prediction", "whole"), ["p0", "p1"])
    assert again.where("prediction <> whole").count() == 0 and again.count() == 300


def test_comparison_has_five_scores(data):
    out = TU.compare_models({"logreg": M.classifier("logreg"), "ada": M.classifier("adaboost", n_estimators=3)}, data, ["a", "b"], "c", task="classification")
    assert out.columns == ["model", "accuracy", "precision", "recall", "f1", "auc"]
    assert all(0.8 < r["auc"] <= 1 for r in out.collect())


def test_adaboost_refuses_a_label_that_is_no_class(spark, data):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(data)
    with pytest.raises(ValueError):
        M.AdaBoostSAMME(n_estimators=2).fit(df.withColumn("label", F.lit(1.0)))


def test_knn_with_a_dense_cluster_in_parts_equals_brute_force(spark):
    import numpy as np
    from tabulon.learn.knn import knn_neighbours
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(120, 3)) * 0.01, rng.normal(size=(60, 3)) * 5, np.zeros((40, 3))])
    df = spark.createDataFrame([(i, [float(a) for a in v], float(i % 3)) for i, v in enumerate(x)], "id long, v array<double>, label double")
    got = knn_neighbours(df, df, "id", "v", "label", k=4, exclude_self=True, part_rows=15).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = {(q, n + 1): t for q in range(len(x)) for n, t in enumerate(np.lexsort((np.arange(len(x)), far[q]))[:4])}
    assert {(r["qid"], r["rank"]): r["tid"] for r in got} == want


# ----------------------------------------------------------------- whole grids from few passes
def test_elastic_net_grid_equals_direct_fits(spark, data):
    from tabulon.learn.paths import elastic_net_folds
    wide = data.withColumn("d", F.col("a") * 0.5 + F.col("b") + (F.col("id") % 5)).withColumn("e", F.lit(2.0))
    cols = ["a", "b", "d", "e"]
    for r in elastic_net_folds(wide, cols, "y", [0.001, 0.3, 5.0], [0.0, 0.4, 1.0]).collect():
        train = VectorAssembler(inputCols=cols, outputCol="features").transform(wide.where(F.col("fold") != r["fold"]))
        lr = M.ElasticNet(alpha=r["alpha"], l1_ratio=r["l1_ratio"], labelCol="y").fit(train)
        # the direct fit stops at a tolerance, with columns that depend on one another
        assert list(lr.coefficients) == pytest.approx(r["coefficients"], abs=1e-3) and lr.intercept == pytest.approx(r["intercept"], abs=1e-2)
        test = VectorAssembler(inputCols=cols, outputCol="features").transform(wide.where(F.col("fold") == r["fold"]))
        assert lr.evaluate(test).rootMeanSquaredError == pytest.approx(r["rmse"], rel=1e-3)


def test_elastic_net_grid_meets_its_optimality_conditions():
    import numpy as np
    from tabulon.learn.paths import Training, elastic_net_path
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=300)
    z = np.column_stack([np.ones(300), x, y])
    alphas, ratios = [0.001, 0.003, 0.005, 0.01, 0.03], [0.001, 0.005, 0.01, 0.03, 0.05, 0.1]
    path = elastic_net_path([Training(z.T @ z)], alphas, ratios)[0]
    xc, yc = x - x.mean(0), y - y.mean()
    for a, alpha in enumerate(alphas):
        for r, ratio in enumerate(ratios):
            w = path[a, r]
            slope = xc.T @ (yc - xc @ w) / 300 - alpha * (1 - ratio) * w
            assert np.all(np.abs(slope[w != 0] - alpha * ratio * np.sign(w[w != 0])) < 1e-6) and np.all(np.abs(slope[w == 0]) <= alpha * ratio + 1e-6)


def test_logistic_grid_equals_single_fits(spark, data):
    from pyspark.ml.classification import LogisticRegression
    from tabulon.learn.paths import logistic_fits
    noisy = data.withColumn("c", ((F.col("y") + (F.col("id") * 37 % 11)) > 20).cast("double"))
    cs = [0.01, 0.1, 1.0, 30.0]
    fits = logistic_fits(noisy, ["a", "b"], "c", cs)
    assert fits.steps < 15
    for c in cs:
        for f in (0, 1, 2, -1):
            train = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(noisy.where(F.col("fold") != f))
            lr = LogisticRegression(labelCol="c", regParam=1.0 / (c * train.count()), standardization=False, maxIter=500, tol=1e-14).fit(train)
            intercept, w = fits.fit(c, f)
            assert intercept == pytest.approx(lr.intercept, rel=1e-6, abs=1e-6) and list(w) == pytest.approx(list(lr.coefficients), rel=1e-6, abs=1e-6)


def test_logistic_grid_search_scores_each_c(data):
    from tabulon.learn.evaluate import cross_validated_scores
    from tabulon.learn.paths import logistic_grid_search, out_of_fold_probabilities
    fits, table = logistic_grid_search(data, ["a", "b"], "c", [0.001, 1.0], metric="auc")
    for r in table.collect():
        one = cross_validated_scores(out_of_fold_probabilities(data, fits, [r["C"]], "c"), "label", "prediction", "fold", "score").first()
        assert one["auc"] == pytest.approx(r["auc"]) and one["f1"] == pytest.approx(r["f1"])
    assert table.agg(F.sum("is_best")).first()[0] == 1


def test_a_separable_fold_and_models_that_take_turns(spark, monkeypatch):
    from tabulon.learn import paths as P
    rows = [(float(k), float(k >= 10), k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, "x double, c double, fold int")
    one = P.logistic_fits(df, ["x"], "c", [0.1, 100.0])
    monkeypatch.setattr(P, "MOST_NUMBERS", 1)
    two = P.logistic_fits(df, ["x"], "c", [0.1, 100.0])
    assert one.weights == pytest.approx(two.weights, rel=1e-6)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_staged_scores_equal_separate_fits(data, task):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    est = GBTRegressor(seed=3, maxDepth=3) if task == "regression" else GBTClassifier(seed=3, maxDepth=2)
    label, metric = ("y", "rmse") if task == "regression" else ("c", "roc_auc")
    got = {(r["value"], r["split"]): r["score"] for r in TU.validation_curve(est, "maxIter", [1, 3, 6], data, ["a", "b"], label, metric=metric, task=task).collect()}
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).withColumn("label", F.col(label))
    ev = TU.evaluator(metric, task)
    for n in (1, 3, 6):
        fits = [est.copy({est.maxIter: n}).fit(rows.where(F.col("fold") != f)) for f in range(3)]
        want = sum(ev.evaluate(m.transform(rows.where(F.col("fold") == f))) for f, m in enumerate(fits)) / 3
        seen = sum(ev.evaluate(m.transform(rows.where(F.col("fold") != f))) for f, m in enumerate(fits)) / 3
        assert got[str(n), "validation"] == pytest.approx(want, rel=1e-6) and got[str(n), "train"] == pytest.approx(seen, rel=1e-6)


@pytest.mark.parametrize("metric", ["mae", "rmse", "r2"])
def test_staged_sums_of_regression_write_no_row_for_each_model(data, metric):
    """The metric of every (fold, rounds, split) follows from sums of the tasks; rows without a fold take no part."""
    from pyspark.ml.regression import GBTRegressor

    from tabulon.learn.evaluate import regression_metrics
    from tabulon.learn.staged import staged_metrics
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).withColumn("label", F.col("y"))
    models = {f: GBTRegressor(seed=3, maxDepth=2, maxIter=2).fit(rows.where(F.col("fold") != f)) for f in range(3)}
    some = rows.withColumn("fold", F.when(F.col("id") % 10 != 4, F.col("fold")))
    table = staged_metrics(some, models, [1, 2], metric)
    assert "Generate" not in table._jdf.queryExecution().toString()
    got = {(r["fold"], r["rounds"], r["split"]): r["score"] for r in table.collect()}
    assert len(got) == 12
    for f, m in models.items():
        for split, part in (("validation", some.where(F.col("fold") == f)), ("train", some.where(F.col("fold") != f))):
            assert got[f, 2, split] == pytest.approx(regression_metrics(m.transform(part), "label", "prediction").first()[metric], rel=1e-9)


def test_grid_over_rounds_fits_each_combination_once(data):
    for est, grid in ((M.regressor("xgb"), {"max_depth": [1, 2], "n_estimators": [1, 3]}), (M.regressor("gbm"), {"maxDepth": [1, 2], "maxIter": [1, 3]})):
        model, table = TU.grid_search(est, grid, data, ["a", "b"], "y")
        rows = table.collect()
        assert len(rows) == 4 and sum(r["is_best"] for r in rows) == 1
        best = max(rows, key=lambda r: r["score"])
        assert best["is_best"] and model.bestModel.transform(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)).count() == 300
        # the score of a point is that of its own fits
        import json
        p = json.loads(rows[0]["params"])
        one = est.copy({est.getParam(k): v for k, v in p.items()})
        oof = TU.out_of_fold(one, data, ["a", "b"], "y")
        from tabulon.learn.evaluate import regression_metrics
        assert regression_metrics(oof, "label", "prediction", ["fold"]).agg(F.avg("r2")).first()[0] == pytest.approx(rows[0]["score"])


def test_comparison_of_all_families_equals_their_own_folds(data):
    models = {"lr": M.regressor("lr"), "ridge": M.Ridge(3.0), "lasso": M.Lasso(0.2), "cart": M.regressor("cart", max_depth=3), "lgbm": M.regressor("lgbm", n_estimators=2)}
    got = {r["model"]: r["rmse"] for r in TU.compare_models(models, data, ["a", "b"], "y").collect()}
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).withColumn("label", F.col("y"))
    ev = TU.evaluator("rmse")
    for name in ("lr", "ridge", "lasso", "cart"):
        want = sum(ev.evaluate(models[name].fit(rows.where(F.col("fold") != f)).transform(rows.where(F.col("fold") == f))) for f in range(3)) / 3
        assert got[name] == pytest.approx(want, rel=1e-3), name
    assert set(got) == set(models)


def test_group_means_without_the_own_fold(spark):
    from tabulon.operators.features import cross_group_means, group_mean, group_means
    rows = [(k, "hot" if k % 3 else "abc"[k % 9 // 3], None if k % 7 == 0 else float(k), None if k % 10 == 9 else k % 4, None if k % 8 == 0 else k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, y double, fold int, h int")

    def want(row, keys):
        if any(row[k] is None for k in keys):
            return None
        others = [r["y"] for r in data_ if all(r[k] == row[k] for k in keys) and r["fold"] != row["fold"] and r["y"] is not None]
        return sum(others) / len(others) if others else None

    data_ = [r.asDict() for r in df.collect()]
    for out, sets in ((group_mean(df, "y", "g", "m0", out_of_fold=True), [["g"]]),
                      (group_means(df, "y", [["g"], ["g", "h"]], ["m0", "m1"], out_of_fold=True), [["g"], ["g", "h"]])):
        for r in out.collect():
            for i, keys in enumerate(sets):
                assert r[f"m{i}"] == pytest.approx(want(r, keys)) if want(r, keys) is not None else r[f"m{i}"] is None
    assert cross_group_means(df, "y", ["g"], ["h", "fold"], out_of_fold=True).count() == 120


def test_models_of_a_query_share_one_stand_in(spark, tmp_path, monkeypatch):
    """The tables are joined and added up once for all models of a query, and folds are numbered from the written result."""
    from tabulon.catalog import q_learn as Q
    spark.range(40).selectExpr("id as p_partkey", "cast(id % 7 as int) as p_size", "cast(900 + id * 3 % 50 as double) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200).selectExpr("id % 40 as l_partkey", "cast(id % 9 as double) as l_quantity", "cast(id as double) as l_extendedprice",
                                "date_add(date'1996-01-01', cast(id * 5 as int)) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, plans, salary, kfold = [], [], Q.salary, Q.kfold
    monkeypatch.setattr(Q, "salary", lambda *a: made.append(a) or salary(*a))
    monkeypatch.setattr(Q, "kfold", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kfold(df, *a))
    rows = Q.m09_mean_invariants(spark, str(tmp_path)).collect()
    assert {r["model"] for r in rows} == {"gbm", "xgb", "lgbm", "catboost"} and {r["n"] for r in rows} == {40}
    assert len(made) == 1 and not any("Join" in p or "Aggregate" in p for p in plans)


def test_grid_of_trees_keeps_no_copy_of_a_fold(data, monkeypatch):
    """Scores are those of a fit a point and fold; nothing but the table of all folds is held."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor
    rows = M.assemble(["a", "b"]).transform(data).withColumn("label", F.col("y").cast("double"))
    folds, want = sorted(r[0] for r in data.select("fold").distinct().collect()), []
    for depth in (1, 3):
        fits = {f: DecisionTreeRegressor(seed=3, maxDepth=depth).fit(rows.where(F.col("fold") != f)) for f in folds}
        want.append(np.mean([RegressionEvaluator(metricName="r2").evaluate(fits[f].transform(rows.where(F.col("fold") == f))) for f in folds]))

    def cache(df):
        raise AssertionError("a fold is copied")

    monkeypatch.setattr(type(data), "cache", cache)
    model, table = TU.grid_search(DecisionTreeRegressor(seed=3), {"maxDepth": [1, 3]}, data, ["a", "b"], "y")
    found = {r["params"]: (r["score"], r["is_best"]) for r in table.collect()}
    assert np.allclose([found['{"maxDepth": %d}' % k][0] for k in (1, 3)], want)
    assert found['{"maxDepth": %d}' % (1, 3)[int(np.argmax(want))]][1] == 1 and model.bestModel.depth in (1, 2, 3)
