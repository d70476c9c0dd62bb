"""Approximate neighbours against brute force, and the Estimator over both modes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabulon.learn import knn as N
from tabulon.learn import models as M
from tabulon.learn import tune as TU


def table(spark, n=2500, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, d)) * 3
    of = rng.integers(0, 25, n)
    x = centres[of] + rng.normal(size=(n, d))
    x[:60] = x[0]  # many equal rows
    df = spark.createDataFrame([(i, [float(a) for a in v], float(of[i] % 2)) for i, v in enumerate(x)], "id long, v array<double>, label double").repartition(4)
    return df, x, of % 2


def test_recall_of_the_probed_buckets(spark):
    df, x, _ = table(spark)
    exact = N.knn_neighbours(df, df.where("id % 10 = 0"), "id", "v", "label", k=5, exclude_self=True).cache()
    one = N.approximate_neighbours(df, df.where("id % 10 = 0"), "id", "v", "label", k=5, exclude_self=True, bucket_rows=200, part_rows=70).cache()
    r = N.recall(one, exact).first()
    assert r["n"] == 1250 and r["recall"] >= 0.9
    # distances are exact, and ranks follow them
    for row in one.where("rank = 1").limit(40).collect():
        assert row["dist"] == pytest.approx(np.linalg.norm(x[row["qid"]] - x[row["tid"]]), abs=1e-9)
    assert one.where("qid = tid").count() == 0
    few = N.approximate_neighbours(df, df.where("id % 10 = 0"), "id", "v", "label", k=5, exclude_self=True, bucket_rows=100, tables=1, flips=0)
    assert N.recall(few, exact).first()["recall"] < r["recall"]


def test_small_tables_are_searched_whole(spark):
    df, x, _ = table(spark, n=120)
    got = N.approximate_neighbours(df, df, "id", "v", "label", k=4, exclude_self=True).collect()
    far = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(far, np.inf)
    for r in got:
        assert r["dist"] == pytest.approx(np.sort(far[r["qid"]])[r["rank"] - 1], abs=1e-8)
    assert len(got) == 480
    with pytest.raises(ValueError):
        N.approximate_neighbours(df.limit(0), df, "id", "v", "label")


@pytest.mark.parametrize("mode", ["exact", "approximate"])
def test_estimator(spark, mode, tmp_path):
    df, x, of = table(spark, n=300, seed=2)
    rows = df.withColumn("features", array_to_vector("v")).withColumn("fold", (F.col("id") % 3).cast("int"))
    model = N.KNN(k=3, classification=True, mode=mode).fit(rows.where("fold <> 0"))
    out = {r["id"]: r for r in model.transform(rows.where("fold = 0")).collect()}
    train = np.flatnonzero(np.arange(300) % 3 != 0)
    right = 0
    for k, r in out.items():
        near = train[np.argsort(((x[train] - x[k]) ** 2).sum(1), kind="stable")[:3]]
        if k >= 60:
            right += r["probability"][1] == pytest.approx(np.mean(of[near] == 1))
    assert len(out) == 100 and right >= 78
    model.save(f"{tmp_path}/knn")
    again = {r["id"]: r["prediction"] for r in N.KNNModel.load(f"{tmp_path}/knn").transform(rows.where("fold = 0")).collect()}
    assert again == {k: r["prediction"] for k, r in out.items()}
    wide = rows.select("id", "fold", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(12)])
    got = TU.compare_models({"knn": M.classifier("knn", mode=mode), "logreg": M.classifier("logreg")}, wide, [f"x{i}" for i in range(12)], "label", task="classification")
    scores = {r["model"]: r["accuracy"] for r in got.collect()}
    assert scores["knn"] > 0.9 and set(scores) == {"knn", "logreg"}
    assert M.regressor("knn", mode=mode, k=1).fit(rows).transform(rows).where("abs(prediction - label) > 1e-9 and id >= 60").count() == 0


def test_exact_neighbours_meet_in_bins(spark):
    """Many bins, cells larger than a bin, equal rows: as brute force; a query is sent once a bin at most."""
    df, x, _ = table(spark, n=600, d=9)
    got = N.knn_neighbours(df, df, "id", "v", "label", k=4, exclude_self=True, part_rows=50, n_pivots=16).collect()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    assert len(got) == 600 * 4
    for r in got:
        assert r["dist"] == pytest.approx(np.sort(far[r["qid"]])[r["rank"] - 1], abs=1e-9)
    assert [r["tid"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == 7] == [0, 1, 2, 3]  # equal rows by their id
    first, many = N._binned(np.arange(8.0).reshape(4, 2), [5_000, 100_000, 10, 20], 50_000)
    assert many[1] > 1 and many[0] == many[2] == many[3] == 1 and first[2] == first[3]
    assert max(f + m for f, m in zip(first, many)) <= 2 * N.LEAST_BINS + 4


def test_leaves_stay_small_where_few_columns_have_all_the_distance(spark):
    """One column of large scale, many equal rows: leaves of about equal size, the nearest rows are found, folds do not meet."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.exponential(1e6, 4000), rng.normal(size=(4000, 5))])
    sizes = np.bincount(N._Leaves(x, 6, 1, 5, 1).probe(x, 0, 1)[1], minlength=32)
    assert sizes.max() <= 2 * 4000 / 32 and sizes.min() > 0
    x[1000:2000] = x[0]
    fold = np.arange(4000) % 4
    rows = spark.createDataFrame([(i, [float(a) for a in v], float(i), int(f)) for i, (v, f) in enumerate(zip(x, fold))], "id long, v array<double>, label double, fold int").repartition(5)
    got = N.approximate_neighbours(rows, rows, "id", "v", "label", k=3, bucket_rows=100, part_rows=100, fold="fold").collect()
    assert len(got) == 12_000 and all(r["qid"] % 4 != r["tid"] % 4 for r in got)
    far = np.abs(x[:, None, 0] - x[None, :, 0])
    far[fold[:, None] == fold[None]] = np.inf
    kth = np.sort(far, axis=1)[:, 2]
    assert np.mean([r["dist"] <= kth[r["qid"]] + 20 for r in got]) >= 0.95  # by the column that has the distance
    # of equal rows those of the smallest ids
    assert sorted(r["tid"] for r in got if r["qid"] == 1500) == [1001, 1002, 1003]
    # a row that is there twice counts once
    assert [r["tid"] for r in N.approximate_neighbours(rows.union(rows), rows.where("id = 1500"), "id", "v", "label", k=3, fold="fold").orderBy("rank").collect()] == [1001, 1002, 1003]
    model = N.KNN(k=3, mode="approximate", bucket_rows=100)
    each = {r["id"]: r["prediction"] for r in model.out_of_fold(rows.withColumn("features", array_to_vector("v")), "fold").collect()}
    assert len(each) == 4000 and all(v is not None for v in each.values())
