"""Flagship flow: RFM customer segmentation on the orders table.

orders -> per-customer history -> recency / tenure / frequency / monetary ->
outlier capping -> log1p -> min-max scaling -> k-means -> segment profile.
Every step is a lazy DataFrame operator or a fitted Estimator; the only
driver-side values are the fitted limits, scaler ranges and k centres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.learn.segment import kmeans_segments, segment_profile
from tabulon.learn.tune import fold_table
from tabulon.operators.clean import OutlierCapper
from tabulon.operators.encode import MinMaxScaler
from tabulon.operators.features import log1p_cols, rfm
from tabulon.plans.standins import customer_history

RFM_COLS = ["recency", "tenure", "frequency", "monetary"]


def rfm_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per-customer RFM table, capped at the .05/.95 limits, log1p'd and scaled to [0, 1].

    The customers' histories are written once: limits, scales and every pass of a
    fit read that table, and the orders are grouped a single time.
    """
    h = customer_history(spark, sf)
    r = rfm(h, "first_order_date", "last_order_date", ["order_num_online", "order_num_offline"],
            ["value_online", "value_offline"]).select("customer_id", *RFM_COLS)
    r = fold_table(r, ["customer_id", *[r[c].cast("double").alias(c) for c in RFM_COLS]])
    capped = OutlierCapper(inputCols=RFM_COLS, q1=0.05, q3=0.95, k=1.5, mode="both").fit(r).transform(r)
    logged = log1p_cols(capped, RFM_COLS)
    return MinMaxScaler(inputCols=RFM_COLS).fit(logged).transform(logged)


def rfm_segments(spark: SparkSession, sf: str, k: int = 4, seed: int = 42) -> DataFrame:
    feats = rfm_features(spark, sf)
    seg, _ = kmeans_segments(feats, RFM_COLS, k, seed=seed)
    return seg


def rfm_segments_report(spark: SparkSession, sf: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Segment sizes and mean/min/max of the scaled RFM features per segment."""
    return segment_profile(rfm_segments(spark, sf, k, seed), "segment", RFM_COLS).orderBy("segment")
