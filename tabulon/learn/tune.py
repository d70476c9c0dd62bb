"""Model comparison and tuning (T04, T08-T10, T12) and stacking.

Folds are a column (``kfold`` / ``stratified_kfold``), so every fit sees the
same split and the fits of all grid points and folds share a pool.  The fold frame is written once and persisted for the fits of a call, in
partitions sized by its bytes.  Where a whole grid follows from one aggregation
(least squares), from common passes (logistic regression) or from one fit a fold
(rounds of boosted trees), no fit is run for each point.  Out-of-fold predictions of
all models are one written table, scored by one aggregation and one sort.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.moments import MOST_EXPRESSIONS, pairwise_sums
from tabulon.learn.boosters import _Booster, fit_folds
from tabulon.learn.evaluate import cross_validated_scores, metrics_by_fold, regression_metrics
from tabulon.learn.knn import KNN
from tabulon.learn.models import AdaBoostSAMME, ElasticNet, Lasso, LogisticC, Ridge, assemble
from tabulon.learn.paths import (elastic_net_grid_search, least_squares_folds, linear_by_fold, logistic_fits, logistic_grid_search,
                                 out_of_fold_probabilities)
from tabulon.learn.staged import staged_metrics, staged_scores
from tabulon.learn.svm import KernelSVM
from tabulon.operators._mlbase import WithParts
from tabulon.session import scratch_path


def _folds(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect())  # k values


def _parallel(fn, items, parallelism: int):
    """Run independent fits on a thread pool, as ``CrossValidator(parallelism=...)`` does:
    each thread submits its own Spark jobs and the scheduler interleaves their tasks."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


def _score_column(df: DataFrame):
    """Score of class 1 from what the model adds: probability, else raw prediction, else the prediction."""
    for name in ("probability", "rawPrediction"):
        if name in df.columns:
            return vector_to_array(name)[1]
    return F.col("prediction")


@contextmanager
def _persisted(df: DataFrame):
    """``df`` held in memory for the fits inside the block and given up after it."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


# ----------------------------------------------------------------- out-of-fold predictions
STEPWISE = (KernelSVM, AdaBoostSAMME, GBTRegressor, GBTClassifier)  # many short jobs, one after the other
PARTITION_BYTES = 16 << 20  # of numbers that a task of a fit reads at least, if there are so many


def fold_table(df: DataFrame, cols: Sequence) -> DataFrame:
    """``cols`` of ``df`` written in the shared folder and read in few partitions if the rows are few.

    Fits run many short jobs; what a task costs counts more than its rows on a small table.
    """
    path = scratch_path(df.sparkSession, "folds")
    df.select(*cols).write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    return table.coalesce(max(1, -(-table.count() * len(table.columns) * 8 // PARTITION_BYTES)))


def _penalty(est):
    """(kind, alpha, l1_ratio) if a model's folds follow from sums of products, else None."""
    if type(est) is Ridge:
        return "ridge", est.getOrDefault("alpha"), 0.0
    if type(est) is Lasso:
        return "net", est.getOrDefault("alpha"), 1.0
    if type(est) is ElasticNet:
        return "net", est.getOrDefault("alpha"), est.getOrDefault("l1_ratio")
    if type(est) is LinearRegression and est.getRegParam() == 0 and est.getLoss() == "squaredError" and est.getFitIntercept():
        return "ridge", 0.0, 0.0
    return None


def out_offold_table(models: dict, df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", keep: Sequence[str] = (),
                      task: str = "regression", parallelism: int = 8) -> DataFrame:
    """(model, keep..., label, fold, prediction, score): one written table of the out-of-fold predictions of all models.

    The folds of all least-squares models follow from one aggregation, those of all
    logistic models from common Newton passes, approximate neighbours of all folds from
    one search; the fits of the others, over all models and folds, share one pool.  ``score`` is that of class 1 (null in regression).
    """
    spark = df.sparkSession
    table = fold_table(df, [*keep, *features, F.col(label).alias("label"), fold])
    path = scratch_path(spark, "out-of-fold")
    penalties = {n: _penalty(e) for n, e in models.items() if task == "regression" and _penalty(e)}
    logistic = {n: float(e.getOrDefault("C")) for n, e in models.items() if task != "regression" and type(e) is LogisticC}
    others = [n for n in models if n not in penalties and n not in logistic]
    columns = [*keep, "label", fold, "prediction"]
    no_score = F.lit(None).cast("double").alias("score")

    with _persisted(table) as held:
        done = []
        if penalties:
            fits = least_squares_folds(held, features, "label", penalties, fold)
            done += [(n, held.where(F.col(fold).isNotNull()).withColumn("prediction", linear_by_fold(features, fits[n], fold)).select(
                F.lit(n).alias("model"), *columns, no_score)) for n in penalties]
        if logistic:
            fits = logistic_fits(held, features, "label", list(dict.fromkeys(logistic.values())), fold, full=False)
            done += [(n, out_of_fold_probabilities(held, fits, [c], "label", fold, keep).select(F.lit(n).alias("model"), *columns, "score"))
                     for n, c in logistic.items()]
        rows = assemble(features).transform(held).select(*keep, "features", "label", fold)
        with _persisted(rows) as vectors:
            folds = [f for f in _folds(vectors, fold) if f is not None] if others else []
            boosted = [n for n in others if isinstance(models[n], _Booster)]
            searched = [n for n in others if isinstance(models[n], KNN) and models[n].mode == "approximate"]
            alone = [n for n in others if n not in boosted and n not in searched]
            jobs = [(n, f) for n in alone if isinstance(models[n], STEPWISE) for f in folds]  # the longest first
            jobs += [(n, None) for n in [*searched, *boosted]] + [(n, f) for n in alone if not isinstance(models[n], STEPWISE) for f in folds]

            def fit(job):
                name, left_out = job
                if name in searched:  # predictions of all folds
                    return models[name].out_of_fold(vectors, fold)
                if left_out is None:
                    return fit_folds([models[name]], vectors, folds, fold)[0]
                return models[name].fit(vectors.where(F.col(fold) != left_out))

            fitted = dict(zip(jobs, _parallel(fit, jobs, parallelism)))
            fitted |= {(n, f): fitted[n, None][f] for n in boosted for f in folds}
            for n in others:
                parts = None
                for f in folds if n not in searched else [None]:
                    p = fitted[n, None] if f is None else fitted[n, f].transform(vectors.where(F.col(fold) == f))
                    p = p.select(F.lit(n).alias("model"), *columns, no_score if task == "regression" else _score_column(p).alias("score"))
                    parts = p if parts is None else parts.unionByName(p)
                if parts is not None:
                    done.append((n, parts))
            _parallel(lambda job: job[1][1].write.parquet(f"{path}/{job[0]}"), list(enumerate(done)), parallelism)
    return spark.read.schema(done[0][1].schema).parquet(*[f"{path}/{i}" for i in range(len(done))])


def out_of_fold(estimator, df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
                keep: Sequence[str] = (), parallelism: int = 8, score: bool = False) -> DataFrame:
    """Out-of-fold predictions of one model, as a written table; with ``score``, the classifier's score of class 1 as well."""
    found = out_offold_table({"model": estimator}, df, features, label, fold, keep, "classification" if score else "regression", parallelism)
    return found.select(*keep, "label", fold, "prediction", *(["score"] if score else []))


def compare_models(models: dict, df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
                   task: str = "regression", parallelism: int = 8) -> DataFrame:
    """One row of cross-validated scores per (name, estimator).

    Regression: mean over folds of RMSE (T05), MAE and R^2.  Classification:
    mean over folds of accuracy, precision, recall and F1 of class 1, and AUC (T04).
    All models are scored together: one aggregation, and one sort for the AUC.
    """
    oof = out_offold_table(models, df, features, label, fold, (), task, parallelism)
    if task == "regression":
        per = regression_metrics(oof, "label", "prediction", ["model", fold])
        return per.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))
    return cross_validated_scores(oof, "label", "prediction", fold, "score", by=["model"])


def evaluator(metric: str, task: str = "regression"):
    """An MLlib evaluator for a metric's name: rmse, mae, r2, ...; accuracy, f1, ...; areaUnderROC (or roc_auc)."""
    if task == "regression":
        return RegressionEvaluator(labelCol="label", metricName=metric)
    if metric in ("roc_auc", "areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC" if metric == "roc_auc" else metric)
    return MulticlassClassificationEvaluator(labelCol="label", metricName=metric)


class GridResult:
    """A finished grid: ``bestModel`` is the model of the best point, refit on all rows."""

    def __init__(self, bestModel, avgMetrics: list[float]):
        self.bestModel, self.avgMetrics = bestModel, avgMetrics


def grid_points(grid: dict) -> list[dict]:
    """All combinations, the last parameter moving fastest."""
    points = [{}]
    for name, values in grid.items():
        points = [p | {name: v} for p in points for v in values]
    return points


def _path_scores(estimator, points: list[dict], df: DataFrame, features, label, fold, task, metric) -> list[float] | None:
    """Mean scores of all points if they follow from sums of products or from common Newton passes, else None."""
    names = set(points[0])
    if task == "regression" and metric in ("r2", "rmse") and type(estimator) in (Ridge, Lasso, ElasticNet) and names <= {"alpha", "l1_ratio"}:
        alphas = list(dict.fromkeys(float(p.get("alpha", estimator.getOrDefault("alpha"))) for p in points))
        if type(estimator) is Ridge:
            table = {(r["alpha"],): r for r in ridge_grid_search(df, features, label, alphas, fold).collect()}  # one row a point
            keys = [(float(p.get("alpha", estimator.getOrDefault("alpha"))),) for p in points]
        else:
            own = 1.0 if type(estimator) is Lasso else estimator.getOrDefault("l1_ratio")
            ratios = list(dict.fromkeys(float(p.get("l1_ratio", own)) for p in points))
            table = {(r["alpha"], r["l1_ratio"]): r for r in elastic_net_grid_search(df, features, label, alphas, ratios, fold).collect()}
            keys = [(float(p.get("alpha", estimator.getOrDefault("alpha"))), float(p.get("l1_ratio", own))) for p in points]
        return [table[k]["mean_" + metric] for k in keys]
    if task != "regression" and type(estimator) is LogisticC and names == {"C"} and metric in ("accuracy", "roc_auc", "areaUnderROC"):
        _, found = logistic_grid_search(df, features, label, [float(p["C"]) for p in points], fold)
        name = "accuracy" if metric == "accuracy" else "auc"
        table = {r["C"]: r[name] for r in found.collect()}  # one row a point
        return [table[float(p["C"])] for p in points]
    return None


def _rounds_of(estimator) -> str | None:
    """The parameter that counts the rounds of a boosted model."""
    if isinstance(estimator, (GBTRegressor, GBTClassifier)):
        return "maxIter"
    return "n_estimators" if isinstance(estimator, _Booster) else None


def _fit_every_fold(estimators: list, held: DataFrame, folds: Sequence[int], fold: str, parallelism: int) -> list[dict]:
    """For each estimator, the model of each fold left out; boosters of one kind in common passes."""
    if isinstance(estimators[0], _Booster):
        return fit_folds(estimators, held, folds, fold)
    jobs = [(i, f) for i in range(len(estimators)) for f in folds]
    fitted = dict(zip(jobs, _parallel(lambda job: estimators[job[0]].fit(held.where(F.col(fold) != job[1])), jobs, parallelism)))
    return [{f: fitted[i, f] for f in folds} for i in range(len(estimators))]


def _staged_scores(estimator, points: list[dict], held: DataFrame, fold, task, metric, parallelism) -> list[float] | None:
    """Mean validation scores where the number of rounds is an axis: one fit a fold at the largest number."""
    axis = _rounds_of(estimator)
    if axis is None or axis not in points[0] or metric not in STAGED[task]:
        return None
    rounds = sorted({int(p[axis]) for p in points})
    rest = list(dict.fromkeys(json.dumps({k: v for k, v in p.items() if k != axis}, sort_keys=True) for p in points))
    folds = _folds(held, fold)
    most = [estimator.copy({estimator.getParam(k): v for k, v in (json.loads(r) | {axis: rounds[-1]}).items()}) for r in rest]
    scores = {}
    for r, models in zip(rest, _fit_every_fold(most, held, folds, fold, parallelism)):
        oof = staged_scores(held, models, rounds, fold, task)
        if task == "regression":
            per = regression_metrics(oof, "label", "prediction", ["rounds", fold])
        else:
            per = metrics_by_fold(oof, "label", "prediction", fold, "score" if metric != "accuracy" else None, by=["rounds"])
        column = STAGED[task][metric]
        for x in per.groupBy("rounds").agg(F.avg(column).alias("s")).collect():  # one row a number of rounds
            scores[r, x["rounds"]] = x["s"]
    return [scores[json.dumps({k: v for k, v in p.items() if k != axis}, sort_keys=True), int(p[axis])] for p in points]


def _fold_scores(estimator, points: list[dict], held: DataFrame, fold: str, ev, parallelism: int) -> list[float]:
    """Mean validation scores of fits point by point and fold by fold, in one pool over the rows held: no copy of a fold is
    kept, as ``CrossValidator`` does, and no Python function looks at each row's fold."""
    folds, made = _folds(held, fold), [estimator.copy({estimator.getParam(k): v for k, v in p.items()}) for p in points]

    def one(job):
        i, f = job
        return ev.evaluate(made[i].fit(held.where(F.col(fold) != f)).transform(held.where(F.col(fold) == f)))

    jobs = [(i, f) for f in folds for i in range(len(points))]
    found = dict(zip(jobs, _parallel(one, jobs, parallelism)))
    return [sum(found[i, f] for f in folds) / len(folds) for i in range(len(points))]


STAGED = {"regression": {"r2": "r2", "rmse": "rmse", "mae": "mae"},
          "classification": {"accuracy": "accuracy", "roc_auc": "auc", "areaUnderROC": "auc"}}


def grid_search(estimator, grid: dict, df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
                task: str = "regression", metric: str | None = None, parallelism: int = 8):
    """Every grid combination scored by k-fold CV (default R^2 / accuracy, like GridSearchCV);
    returns (a result whose ``bestModel`` is refit on ``df``, a table of (params, score, is_best)).

    Ridge, lasso and elastic net are scored from one aggregation, logistic regression
    over C from common Newton passes, boosted trees along their rounds from one fit a fold
    and combination of the other parameters; other models by a fit a point and fold, all in one pool.
    """
    metric = metric or ("r2" if task == "regression" else "accuracy")
    points = grid_points(grid)
    ev = evaluator(metric, task)
    table = fold_table(df, [*features, F.col(label).cast("double").alias("label"), F.col(fold).cast("int").alias(fold)])
    with _persisted(assemble(features).transform(table)) as held:
        scores = _path_scores(estimator, points, held, features, "label", fold, task, metric)
        if scores is None:
            scores = _staged_scores(estimator, points, held, fold, task, metric, parallelism)
        if scores is None:
            scores = _fold_scores(estimator, points, held, fold, ev, parallelism)
        best = (max if ev.isLargerBetter() else min)(range(len(scores)), key=lambda i: scores[i])
        final = estimator.copy({estimator.getParam(k): v for k, v in points[best].items()}).fit(held)
    rows = [(json.dumps(p, sort_keys=True), float(s), int(i == best)) for i, (p, s) in enumerate(zip(points, scores))]
    return GridResult(final, scores), df.sparkSession.createDataFrame(rows, "params string, score double, is_best int")


def tune_models(candidates: dict, df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
                task: str = "regression", metric: str | None = None, holdout: DataFrame | None = None) -> DataFrame:
    """Grid-search several models, one row per model with its best score and parameters and, for the model refit
    with them on ``df``, its score on ``holdout`` (RMSE, or the metric of a classifier)."""
    out = None
    for name, (est, grid) in candidates.items():
        model, table = grid_search(est, grid, df, features, label, fold, task, metric)
        best = table.where("is_best = 1").select(F.lit(name).alias("model"), "params", "score")
        if holdout is not None:
            data = assemble(features).transform(holdout).select("features", F.col(label).cast("double").alias("label"))
            ev = evaluator("rmse" if task == "regression" else metric or "accuracy", task)
            best = best.withColumn("holdout", F.lit(float(ev.evaluate(model.bestModel.transform(data)))))
        out = best if out is None else out.unionByName(best)
    return out


def validation_curve(estimator, param: str, values: Sequence, df: DataFrame, features: Sequence[str],
                     label: str, fold: str = "fold", metric: str = "rmse", task: str = "regression", parallelism: int = 8) -> DataFrame:
    """Mean train and validation score over folds for each value of one parameter, by any metric of ``evaluator``.

    Along the rounds of boosted trees each fold is fitted once; other
    parameters are fitted value by value, all values and folds in one pool.
    """
    table = fold_table(df, [*features, F.col(label).cast("double").alias("label"), fold])
    with _persisted(assemble(features).transform(table)) as held:
        folds = _folds(held, fold)
        if param == _rounds_of(estimator) and metric in STAGED[task]:
            most = estimator.copy({estimator.getParam(param): max(int(v) for v in values)})
            models = _fit_every_fold([most], held, folds, fold, parallelism)[0]
            per = staged_metrics(held, models, [int(v) for v in values], STAGED[task][metric], fold, task)
            found = {(r["rounds"], r["split"]): r["s"] for r in per.groupBy("rounds", "split").agg(F.avg("score").alias("s")).collect()}
            rows = [(str(v), split, float(found[int(v), split])) for v in values for split in ("train", "validation")]
        else:
            ev = evaluator(metric, task)

            def one(job):
                v, f = job
                m = estimator.copy({estimator.getParam(param): v}).fit(held.where(F.col(fold) != f))
                return (v, ev.evaluate(m.transform(held.where(F.col(fold) != f))),
                        ev.evaluate(m.transform(held.where(F.col(fold) == f))))

            scores = _parallel(one, [(v, f) for v in values for f in folds], parallelism)
            rows = []
            for v in values:
                tr = [t for vv, t, _ in scores if vv == v]
                va = [a for vv, _, a in scores if vv == v]
                rows.append((str(v), "train", sum(tr) / len(tr)))
                rows.append((str(v), "validation", sum(va) / len(va)))
    return df.sparkSession.createDataFrame(rows, "value string, split string, score double")


# ----------------------------------------------------------------- N03
class StackingModel(WithParts, Model):
    """Saved with its base models and the meta model."""

    def __init__(self, bases, meta, features):
        super().__init__()
        self.bases, self.meta, self.features = bases, meta, list(features)

    def _parts(self):
        return {"features": self.features}, {}, {"meta": self.meta} | {f"base-{i}": b for i, b in enumerate(self.bases)}

    @classmethod
    def _from_parts(cls, values, tables, children):
        return cls([children[f"base-{i}"] for i in range(len(children) - 1)], children["meta"], values["features"])

    def _transform(self, dataset):
        out = assemble(self.features).transform(dataset)
        for i, b in enumerate(self.bases):
            out = b.copy().setPredictionCol(f"__b{i}").transform(out)
        names = [f"__b{i}" for i in range(len(self.bases))]
        return self.stacked(out.drop("features"), names).drop(*names)

    def stacked(self, predictions: DataFrame, cols: Sequence[str]) -> DataFrame:
        """The prediction from those of the base models, for rows that have them already."""
        out = VectorAssembler(inputCols=list(cols), outputCol="__meta").transform(predictions)
        return self.meta.copy().setFeaturesCol("__meta").transform(out).drop("__meta")


class StackingRegressor(Estimator):
    """Base models' out-of-fold predictions feed a ridge meta model; the bases are then
    refit on all rows.  The meta model's penalty is chosen by the same folds."""

    def __init__(self, bases: Sequence, features: Sequence[str], label: str, fold: str = "fold",
                 alphas: Sequence[float] = (0.1, 1.0, 10.0)):
        super().__init__()
        self.bases, self.features, self.label, self.fold, self.alphas = list(bases), list(features), label, \
            fold, list(alphas)

    def _fit(self, dataset):
        data = assemble(self.features).transform(dataset).select(
            "features", F.col(self.label).cast("double").alias("label"), F.col(self.fold).cast("int").alias(self.fold))
        names = [f"__b{i}" for i in range(len(self.bases))]
        with _persisted(data) as held:
            folds = _folds(held, self.fold)

            every = [*folds, None]
            jobs = [(i, f) for i, est in enumerate(self.bases) for f in ([None] if isinstance(est, _Booster) else every)]

            def one(job):
                est = self.bases[job[0]].copy().setFeaturesCol("features").setLabelCol("label")
                if isinstance(est, _Booster):  # all folds and the whole in common passes
                    return fit_folds([est], held, folds, self.fold, full=True)[0]
                return est.fit(held if job[1] is None else held.where(F.col(self.fold) != job[1]))

            fitted = dict(zip(jobs, _parallel(one, jobs, 4)))
            by_fold = {f: [fitted[i, None][f] if isinstance(est, _Booster) else fitted[i, f] for i, est in enumerate(self.bases)] for f in every}
            # every base model of a fold scores that fold's rows in one pass: no row id, no join
            oof = None
            for f in folds:
                part = held.where(F.col(self.fold) == f)
                for name, model in zip(names, by_fold[f], strict=True):
                    part = model.copy().setPredictionCol(name).transform(part)
                part = part.select("label", self.fold, *names)
                oof = part if oof is None else oof.unionByName(part)
            with _persisted(oof) as scored:  # the penalty and the meta model read it several times
                # meta penalty by k-fold CV from one aggregation of fold moments (no refit per fold)
                best = ridge_grid_search(scored, names, "label", self.alphas, self.fold).where("is_best = 1").first()
                meta_in = VectorAssembler(inputCols=names, outputCol="__meta").transform(scored)
                meta = Ridge(best["alpha"], featuresCol="__meta", labelCol="label").fit(meta_in)
        return StackingModel(by_fold[None], meta, self.features)


__all__ = ["out_of_fold", "out_offold_table", "compare_models", "grid_search", "tune_models", "validation_curve",
           "StackingRegressor", "fold_moments", "ridge_grid_search"]


# ----------------------------------------------------------------- T08 for ridge: one pass for the whole grid
def fold_moments(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", with_means: bool = False):
    """Per-fold sufficient statistics of (1, x, y) for a linear model, in one aggregation.

    Values are centred by their global means first (one small aggregation) so that the
    second moments do not lose digits.  Returns ``{fold: (n, S)}`` with ``S`` the
    (d+2) x (d+2) matrix of sums of products of ``[1, x_1..x_d, y]`` -- a bounded
    (folds x (d+2)^2) result, whatever the row count; with ``with_means`` also the means taken off.
    """
    import numpy as np
    cols = list(features) + [label]
    if len(cols) * (len(cols) + 1) // 2 > MOST_EXPRESSIONS:  # matrices of sums in place of an expression a pair
        means, sums = pairwise_sums(df, cols, fold)
        out = {}
        for f, (n, x, _, xy) in sums.items():
            S = np.zeros((len(cols) + 1, len(cols) + 1))
            S[0, 0], S[0, 1:], S[1:, 0], S[1:, 1:] = n[0, 0], np.diag(x), np.diag(x), xy
            out[f] = (int(n[0, 0]), S)
        return (out, means) if with_means else out
    mrow = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()  # d+1 numbers
    z = [F.col(c).cast("double") - F.lit(mrow[f"m{i}"]) for i, c in enumerate(cols)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(z[i]).alias(f"s{i}") for i in range(len(cols))]
    aggs += [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(*aggs).collect()  # one row per fold
    out = {}
    m = len(cols) + 1
    for r in rows:
        S = np.zeros((m, m))
        S[0, 0] = r["n"]
        for i in range(len(cols)):
            S[0, i + 1] = S[i + 1, 0] = r[f"s{i}"]
            for j in range(i, len(cols)):
                S[i + 1, j + 1] = S[j + 1, i + 1] = r[f"p{i}_{j}"]
        out[r[fold]] = (int(r["n"]), S)
    return (out, np.array([mrow[f"m{i}"] for i in range(len(cols))])) if with_means else out


def _ridge_from_moments(S, alpha):
    """Intercept-unpenalised ridge (sklearn ``Ridge``) solved from the moment matrix."""
    import numpy as np
    n = S[0, 0]
    d = S.shape[0] - 2
    sx, sy = S[0, 1:d + 1], S[0, d + 1]
    xx, xy = S[1:d + 1, 1:d + 1], S[1:d + 1, d + 1]
    mx, my = sx / n, sy / n
    cxx = xx - n * np.outer(mx, mx)
    cxy = xy - n * mx * my
    # without a penalty columns may depend on one another: the smallest solution
    w = np.linalg.solve(cxx + alpha * np.eye(d), cxy) if alpha else np.linalg.lstsq(cxx, cxy, rcond=None)[0]
    return w, my - mx @ w


def ridge_grid_search(df: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float],
                      fold: str = "fold") -> DataFrame:
    """T08 for ``Ridge``: k-fold CV of every alpha from ONE aggregation.

    Each training part's moments are the total minus its fold, so all
    ``len(alphas) x k`` fits are small (d x d) solves on the driver, and each
    validation fold's R^2 and RMSE follow from its own moments.  The reference's
    1,000-alpha grid (15,000 fits) is one pass over the data here.  Scores:
    mean over folds of R^2 (GridSearchCV's default) and of RMSE; ``is_best`` marks
    the highest mean R^2 (first alpha on ties).
    """
    import numpy as np
    fm = fold_moments(df, features, label, fold)
    total = sum(S for _, S in fm.values())
    d = len(features)
    rows = []
    for a in alphas:
        r2s, rmses = [], []
        for f, (nf, Sf) in sorted(fm.items()):
            w, b = _ridge_from_moments(total - Sf, float(a))
            beta = np.concatenate([[-b], -w, [1.0]])  # residual = y - b - x.w as a form in [1, x, y]
            sse = float(beta @ Sf @ beta)
            sy, syy = Sf[0, d + 1], Sf[d + 1, d + 1]
            sst = syy - sy * sy / nf
            r2s.append(1 - sse / sst if sst > 0 else float("nan"))
            rmses.append(float(np.sqrt(max(sse, 0.0) / nf)))
        rows.append((float(a), float(np.mean(r2s)), float(np.mean(rmses))))
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    out = [(a, r2, rm, int(i == best)) for i, (a, r2, rm) in enumerate(rows)]
    return df.sparkSession.createDataFrame(out, "alpha double, mean_r2 double, mean_rmse double, is_best int")
