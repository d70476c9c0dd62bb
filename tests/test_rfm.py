"""The RFM table is made once, and the elbow's fits read it in partitions that follow its bytes."""

import datetime

from tabulon.learn import segment as K
from tabulon.plans.rfm import RFM_COLS, rfm_features


def orders(spark, folder, customers=40):
    rows = [(c * 10 + k, c, 100.0 + 7 * c + k, datetime.datetime(2020, 1 + (c + k) % 12, 1 + c % 28), "1-URGENT" if (c + k) % 2 else "5-LOW")
            for c in range(customers) for k in range(1 + c % 5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet")
    return str(folder)


def test_features_no_longer_read_the_orders(spark, tmp_path):
    feats = rfm_features(spark, orders(spark, tmp_path))
    assert feats.count() == 40 and feats.dropDuplicates(["customer_id"]).count() == 40
    assert not any("orders.parquet" in f for f in feats.inputFiles())
    low, high = feats.selectExpr(*[f"min({c})" for c in RFM_COLS]).first(), feats.selectExpr(*[f"max({c})" for c in RFM_COLS]).first()
    assert min(low) == 0.0 and max(high) == 1.0


def test_elbow_fits_have_few_tasks(spark, monkeypatch):
    df = spark.range(400).selectExpr("cast(id % 20 as double) as a", "cast(id % 7 as double) as b").repartition(16)
    seen, kmeans = [], K.KMeans

    class Watched(kmeans):
        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return super().fit(data)

    monkeypatch.setattr(K, "KMeans", Watched)
    found = K.elbow(df, ["a", "b"], 2, 6).collect()
    assert seen == [1] * 4 and [r["k"] for r in found] == [2, 3, 4, 5]
    assert found[0]["cost"] > found[-1]["cost"] and sum(r["is_knee"] for r in found) == 1
