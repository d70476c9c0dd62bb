"""A saved model is whole: same output from its own folder alone."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from tabulon.learn import models as M
from tabulon.learn import tune as TU
from tabulon.operators import encode as G


@pytest.fixture(scope="module")
def data(spark):
    rows = [(k, float(k % 17), float(k * 7 % 23), 3.0 * (k % 17) - 0.5 * (k * 7 % 23), float(k % 17 > 8), ["x", "y", None, "zz"][k % 4], k % 3) for k in range(200)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, c double, s string, fold int")


def column(model, df, name):
    return [r[0] for r in model.transform(df).orderBy("id").select(name).collect()]


def test_label_codes_are_saved_with_the_model(spark, data, tmp_path):
    model = G.LabelEncoder(inputCols=["s"]).fit(data)
    want = column(model, data, "s")
    Pipeline(stages=[G.LabelEncoder(inputCols=["s"])]).fit(data).write().overwrite().save(f"{tmp_path}/pipe")
    model.save(f"{tmp_path}/codes")
    # nothing of what was fitted is read from the scratch folder any more
    assert all(p.startswith(f"{tmp_path}/codes/") for p in G.LabelEncoderModel.load(f"{tmp_path}/codes")._state().values())
    assert all(p.startswith(f"{tmp_path}/pipe/") or p.startswith(f"file:{tmp_path}/pipe/") for p in PipelineModel.load(f"{tmp_path}/pipe").stages[0]._state().values())
    assert column(G.LabelEncoderModel.load(f"{tmp_path}/codes"), data, "s") == want
    assert column(PipelineModel.load(f"{tmp_path}/pipe"), data, "s") == want
    # saved again from where it was loaded
    G.LabelEncoderModel.load(f"{tmp_path}/codes").save(f"{tmp_path}/again")
    assert column(G.LabelEncoderModel.load(f"{tmp_path}/again"), data, "s") == want


def test_adaboost_and_kernel_features(spark, data, tmp_path):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    model = M.AdaBoostSAMME(n_estimators=4, labelCol="c").fit(rows)
    model.save(f"{tmp_path}/ada")
    assert column(M.AdaBoostSAMMEModel.load(f"{tmp_path}/ada"), rows, "prediction") == column(model, rows, "prediction")
    svm = M.kernel_svc(["a", "b"], "c", dim=10, maxIter=5).fit(data)
    svm.save(f"{tmp_path}/svm")
    assert column(PipelineModel.load(f"{tmp_path}/svm"), data, "prediction") == column(svm, data, "prediction")


def test_stacking(spark, data, tmp_path):
    model = TU.StackingRegressor([M.Ridge(), M.regressor("lgbm", n_estimators=2), M.regressor("cart", max_depth=3)], ["a", "b"], "y").fit(data)
    model.save(f"{tmp_path}/stack")
    assert np.allclose(column(TU.StackingModel.load(f"{tmp_path}/stack"), data, "prediction"), column(model, data, "prediction"))
