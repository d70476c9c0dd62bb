"""Splits, folds and metrics.

Folds and ranks come from a distributed row numbering
(:func:`tabulon.functions.ranking.row_index`), never from a window without
partitioning, and every metric is one aggregation over a prediction table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.ranking import row_index, running_sums


# ----------------------------------------------------------------- T01
def split_bucket(key: str, seed: int = 42, method: str = "hash", buckets: int = 100):
    """Bucket 0..buckets-1 of a row from its key and a seed (repeatable, partition independent).

    ``hash`` mixes with ``xxhash64``; ``affine`` uses ``(key * 7919 + seed) mod buckets``,
    which any SQL engine can repeat (used for the oracle twins).
    """
    if method == "affine":
        return F.pmod(F.col(key) * F.lit(7919) + F.lit(seed), F.lit(buckets))
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))


def train_test_split(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 42,
                     method: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(train, test) with about ``test_size`` of the rows in test."""
    b = split_bucket(key, seed, method, 10000)
    cut = int(round(test_size * 10000))
    return df.where(b >= cut), df.where(b < cut)


# ----------------------------------------------------------------- T02 / T03
def kfold(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """Unshuffled k-fold -- contiguous blocks in key order; the first n % k folds
    hold one row more (``KFold(shuffle=False)``)."""
    n = F.lit(df.count())  # one number; a scalar subquery over the sorted frame would sort again
    ranked = row_index(df, [key], name="_r")
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    fold = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(
        rem + F.floor((F.col("_r") - big) / q))
    return ranked.withColumn(name, fold.cast("int")).drop("_r")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, name: str = "fold") -> DataFrame:
    """``StratifiedKFold(shuffle=False)``.

    Classes, in order of their first row (smallest key), occupy consecutive blocks
    of the label vector; fold i takes every k-th position starting at i, which
    fixes how many rows of each class go to each fold.  Within a class, rows in key
    order fill fold 0 first, then fold 1, ...  Only the per-class boundaries
    (classes x k numbers) are computed on the side; the rows get their within-class
    position from the distributed row numbering.
    """
    ranked = row_index(df, [key], group_cols=[label], name="_r")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))  # one row per class
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    cls = sizes.withColumn("_start", start)

    def below(x, i):  # positions p in [0, x) with p = i (mod k)
        return F.greatest(F.floor((x - i + (k - 1)) / k), F.lit(0))

    alloc = [below(F.col("_start") + F.col("_n"), i) - below(F.col("_start"), i) for i in range(k)]
    ends = []
    acc = None
    for a in alloc:
        acc = a if acc is None else acc + a
        ends.append(acc)
    bounds = cls.select(F.col(label).alias("_class"), F.array(*ends).alias("_ends"))
    out = ranked.join(bounds, F.col(label).eqNullSafe(F.col("_class")))  # Spark broadcasts it when it is small
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_r")))
    return out.withColumn(name, fold.cast("int")).select(*df.columns, name)


# ----------------------------------------------------------------- T05 / T06 / T11
def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R^2 in one aggregation (optionally per group, e.g. per fold)."""
    e = F.col(pred).cast("double") - F.col(y).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
            (1 - F.sum(e * e) / (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1)))).alias("r2")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def cv_rmse(df: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """Mean over folds of the per-fold RMSE (not the pooled RMSE)."""
    per = regression_metrics(df, y, pred, [fold])
    return per.agg(F.avg("rmse").alias("cv_rmse"), F.count(F.lit(1)).alias("folds"))


def rmse_original_scale(df: DataFrame, y_log: str, pred_log: str) -> DataFrame:
    """RMSE after ``expm1`` of both sides of a log1p-target model."""
    e = F.expm1(pred_log) - F.expm1(y_log)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"))


# ----------------------------------------------------------------- T07
def classification_metrics(df: DataFrame, y: str, pred: str, score: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class (1), and the exact
    ROC AUC by the rank-sum formula with tied scores given their average rank."""
    yy, pp = F.col(y).cast("int"), F.col(pred).cast("int")
    c = df.agg(F.count_if((yy == 1) & (pp == 1)).alias("tp"), F.count_if((yy == 0) & (pp == 1)).alias("fp"),
               F.count_if((yy == 1) & (pp == 0)).alias("fn"), F.count_if((yy == 0) & (pp == 0)).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = c.select(((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
                   .alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    out = out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") /
                                      (F.col("precision") + F.col("recall"))).otherwise(0.0))
    if score:
        out = out.withColumn("auc", roc_auc(df, y, score).scalar())
    return out


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (per group of ``by``): (sum of positive ranks - P(P+1)/2) / (P N), ties averaged.

    Rows are first counted per distinct score; the average rank of a score is the
    number of rows below it plus half of its own, from running sums over the
    distinct scores.
    """
    d = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(y).cast("int").alias("_pos"))
    g = d.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("n"), F.sum("_pos").alias("_pos"))
    r = running_sums(g, [*by, "_s"], ["n"])
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    agg = r.groupBy(*by).agg(F.sum(rank * F.col("_pos")).alias("rs"), F.sum("_pos").alias("P"), F.sum("n").alias("N_all"),
                             F.min("n_before").alias("before"))
    P, N = F.col("P"), F.col("N_all") - F.col("P")
    return agg.select(*by, ((F.col("rs") - F.col("before") * P - P * (P + 1) / 2) / (P * N)).alias("auc"))


def metrics_by_fold(df: DataFrame, y: str, pred: str, fold: str = "fold", score: str | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """T04 on a table of out-of-fold predictions: per-fold accuracy / precision / recall / F1, and AUC with ``score``;
    also for each group of ``by`` (models, grid points), with one sort for all of them."""
    yy, pp = F.col(y).cast("int"), F.col(pred).cast("int")
    keys = [*by, fold]
    g = df.groupBy(*keys).agg(F.count_if((yy == 1) & (pp == 1)).alias("tp"),
                             F.count_if((yy == 0) & (pp == 1)).alias("fp"),
                             F.count_if((yy == 1) & (pp == 0)).alias("fn"),
                             F.count(F.lit(1)).alias("n"))
    tn = F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    g = g.select(*keys, ((F.col("tp") + tn) / F.col("n")).alias("accuracy"), prec.alias("precision"),
                 rec.alias("recall"))
    g = g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") /
                                  (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return g.join(roc_auc(df, y, score, keys), keys) if score else g


def cross_validated_scores(df: DataFrame, y: str, pred: str, fold: str = "fold", score: str | None = None,
                           by: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of accuracy, precision, recall and F1, and of AUC with ``score`` (for each group of ``by``)."""
    names = ["accuracy", "precision", "recall", "f1"] + (["auc"] if score else [])
    per = metrics_by_fold(df, y, pred, fold, score, by)
    return (per.groupBy(*by) if by else per.groupBy()).agg(*[F.avg(m).alias(m) for m in names])


# ----------------------------------------------------------------- T13
def comparison_table(df: DataFrame, key: str, y: str, pred: str, n: int = 20) -> DataFrame:
    """Actual, predicted and error for the first ``n`` rows in key order."""
    return (df.select(key, F.col(y).alias("actual"), F.col(pred).alias("predicted"),
                      (F.col(y) - F.col(pred)).alias("error")).orderBy(key).limit(n))


__all__ = ["train_test_split", "kfold", "stratified_kfold", "regression_metrics", "cv_rmse",
           "rmse_original_scale", "classification_metrics", "roc_auc", "metrics_by_fold",
           "cross_validated_scores", "comparison_table", "split_bucket"]
