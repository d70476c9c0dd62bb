"""Segmentation (K01-K04) on ``pyspark.ml.clustering``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.learn.models import assemble
from tabulon.learn.tune import fold_table
from tabulon.learn.ward import MOST, WardTree


def _renumber_by_size(pred: DataFrame, raw: str, name: str) -> DataFrame:
    """Arbitrary cluster ids -> 0..k-1 by descending size (ties by the raw id)."""
    sizes = pred.groupBy(raw).agg(F.count(F.lit(1)).alias("__n"))
    order = sizes.withColumn(name, (F.row_number().over(Window.orderBy(F.desc("__n"), raw)) - 1).cast("int"))
    # k rows: the bound of this broadcast
    return pred.join(F.broadcast(order.select(raw, name)), raw).drop(raw)


def kmeans_segments(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, name: str = "segment",
                    max_iter: int = 50) -> tuple[DataFrame, object]:
    """K-means (k-means|| initialisation) labels, renumbered by segment size."""
    data = assemble(features, "__features").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__raw", maxIter=max_iter).fit(data)
    out = model.transform(data).drop("__features")
    return _renumber_by_size(out, "__raw", name), model


def elbow(df: DataFrame, features: Sequence[str], k_min: int = 2, k_max: int = 20, seed: int = 42) -> DataFrame:
    """Training cost for each k in [k_min, k_max) and the knee (Kneedle on the
    normalised, decreasing convex curve: largest gap to the chord).

    The fits are about a thousand short jobs, so the features are written once and
    read in partitions that follow their bytes, not the plan that made them."""
    from concurrent.futures import ThreadPoolExecutor
    data = assemble(features, "__features").transform(fold_table(df, features)).select("__features").persist()

    def cost(k: int) -> tuple[int, float]:
        return k, float(KMeans(k=k, seed=seed, featuresCol="__features").fit(data).summary.trainingCost)

    with ThreadPoolExecutor(max_workers=8) as pool:  # independent fits; the scheduler interleaves their tasks
        costs = list(pool.map(cost, range(k_min, k_max)))
    data.unpersist()
    knee = knee_point(costs)
    return df.sparkSession.createDataFrame([(k, c, int(k == knee)) for k, c in costs],
                                           "k int, cost double, is_knee int")


def knee_point(curve: list[tuple[int, float]]) -> int | None:
    """Knee of a decreasing convex curve of <= a few dozen (k, cost) points."""
    if len(curve) < 3:
        return None
    xs = [float(k) for k, _ in curve]
    ys = [c for _, c in curve]
    x0, x1 = xs[0], xs[-1]
    lo, hi = min(ys), max(ys)
    if hi == lo:
        return None
    xn = [(x - x0) / (x1 - x0) for x in xs]
    yn = [(y - lo) / (hi - lo) for y in ys]
    # decreasing convex: flip to increasing concave, difference curve = y - x
    yf = [1.0 - y for y in yn]
    diff = [y - x for x, y in zip(xn, yf)]
    best = max(range(len(diff)), key=lambda i: diff[i])
    return int(xs[best])


def segment_profile(df: DataFrame, segment: str, cols: Sequence[str]) -> DataFrame:
    """Mean / min / max of every column per segment, plus the segment size."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return df.groupBy(segment).agg(*aggs)


def ward_segments(df: DataFrame, features: Sequence[str], k: int = 5, name: str = "hsegment", most: int = MOST) -> tuple[DataFrame, WardTree]:
    """Ward's tree over at most ``most`` summaries of the rows, cut at ``k`` clusters, numbered by falling size."""
    tree = WardTree(df, features, most)
    return _renumber_by_size(tree.labels(df, k, "__raw"), "__raw", name), tree


def hierarchical_segments(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42,
                          name: str = "hsegment") -> tuple[DataFrame, object]:
    """Top-down alternative to ``ward_segments``: bisecting k-means, each split a distributed 2-means."""
    data = assemble(features, "__features").transform(df)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__raw").fit(data)
    out = model.transform(data).drop("__features")
    return _renumber_by_size(out, "__raw", name), model
