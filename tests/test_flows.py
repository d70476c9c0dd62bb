"""Comparisons and flows fit whole models: the rounds, trees, bins and depths of each model's own library."""

import pytest

from tabulon.catalog import q_learn as Q
from tabulon.learn import tune as TU
from tabulon.plans import flows


def assert_whole(models, task):
    g = {n: m.getOrDefault for n, m in models.items() if n not in ("knn", "cart", "rf")}
    assert g["gbm"]("maxIter") == 100 and g["gbm"]("maxDepth") == 3
    assert g["xgb"]("n_estimators") == 100 and g["xgb"]("max_depth") == 6 and g["xgb"]("max_bin") == 255
    assert g["lgbm"]("n_estimators") == 100 and g["lgbm"]("num_leaves") == 31 and g["lgbm"]("max_depth") == 0 and g["lgbm"]("max_bin") == 255
    assert g["catboost"]("n_estimators") == 1000 and g["catboost"]("max_depth") == 6 and g["catboost"]("max_bin") == 255
    assert g["svc" if task == "classification" else "svr"]("maxIter") == 50
    assert type(models["cart"]).__name__ == type(models["rf"]).__name__ == "FullForest"  # no bound on depth
    assert models["cart"].trees == 1 and models["rf"].trees == 100 and models["rf"].bootstrap
    if task == "classification":
        assert g["adaboost"]("n_estimators") == 50


@pytest.mark.parametrize("query, task, number", [("t09_compare_models", "regression", 12), ("t09_compare_classifiers", "classification", 10)])
def test_comparisons_fit_whole_models(spark, monkeypatch, query, task, number):
    seen = []
    monkeypatch.setattr(Q, "_salary_folds", lambda *a: None)
    monkeypatch.setattr(Q, "_churn_folds", lambda *a: None)
    monkeypatch.setattr(TU, "compare_models", lambda models, *a, **kw: seen.append(models))
    getattr(Q, query)(None, "")
    assert len(seen[0]) == number
    assert_whole(seen[0], task)


def test_flows_compare_whole_models(spark):
    models = flows._classifiers(42)
    assert len(models) == 10 and flows.FOLDS == 10
    assert_whole(models, "classification")


def test_the_price_flow_fits_whole_boosters(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id div 4 as l_orderkey", "id % 37 as l_partkey", "id % 11 as l_suppkey", "cast(id % 4 as int) as l_linenumber",
                                "cast(id % 50 as double) as l_quantity", "cast(1000 + 30 * (id % 50) + id % 7 as double) as l_extendedprice",
                                "id % 11 / 100 as l_discount", "id % 9 / 100 as l_tax", "substr('ANR', cast(id % 3 as int) + 1, 1) as l_returnflag",
                                "substr('FO', cast(id % 2 as int) + 1, 1) as l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")

    class Seen(Exception):
        pass

    def stack(bases, *a):
        raise Seen({type(b).__name__: (b.getOrDefault("n_estimators"), b.getOrDefault("max_bin")) for b in bases})

    monkeypatch.setattr(TU, "StackingRegressor", stack)
    with pytest.raises(Seen) as seen:
        flows.house_price_flow(spark, str(tmp_path))
    assert seen.value.args[0] == {"LeafWiseBooster": (100, 255), "ObliviousBooster": (1000, 255), "SecondOrderBooster": (100, 255)}
