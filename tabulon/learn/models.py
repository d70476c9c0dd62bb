"""Model factories (M01-M15) on ``pyspark.ml``.

The reference's scikit-learn models are mapped to MLlib estimators, its boosters to
those of ``learn/boosters.py``,
with their parameters translated so that the penalised linear models solve the
same problem (MLlib scales the L2 penalty by the label's standard deviation).
Estimators that need data statistics to translate a parameter (ridge, elastic
net, logistic C) compute them in one aggregation at fit time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.learn.boosters import LeafWiseBooster, ObliviousBooster, SecondOrderBooster
from tabulon.learn.fulltree import FullForest
from tabulon.learn.knn import KNN
from tabulon.learn.svm import KernelSVM
from tabulon.operators._mlbase import WithParts
from tabulon.session import ensure_checkpoint_dir


# ----------------------------------------------------------------- linear models with translated penalties
class _ColumnParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Columns and penalties as ``Param``s: ``copy``, grids and persistence work as for MLlib's estimators."""

    def _start(self, values: dict, **defaults):
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", **defaults)
        self._set(**{k: v for k, v in values.items() if v is not None})

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)


def _number(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toFloat)


class _StatsLinear(Estimator, _ColumnParams):
    """Base: fit a ``LinearRegression`` whose parameters depend on n and std(y)."""

    alpha = _number("alpha", "weight of the penalty")

    def _params_for(self, n: int, sd: float) -> dict:  # pragma: no cover - abstract
        raise NotImplementedError

    def _fit(self, dataset):
        label = self.getOrDefault("labelCol")
        row = dataset.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(label)).alias("sd")).first()
        lr = LinearRegression(featuresCol=self.getOrDefault("featuresCol"), labelCol=label,
                              predictionCol=self.getOrDefault("predictionCol"), standardization=False,
                              **self._params_for(row["n"], row["sd"] or 1.0))
        return lr.fit(dataset)


class Ridge(_StatsLinear):
    """``Ridge(alpha)`` -- penalty alpha on the residual **sum** of squares."""

    def __init__(self, alpha: float | None = None, featuresCol=None, labelCol=None, predictionCol=None):
        super().__init__()
        self._start(dict(alpha=alpha, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol), alpha=1.0)

    def _params_for(self, n, sd):
        return dict(solver="normal", elasticNetParam=0.0, regParam=self.getOrDefault("alpha") * sd / n)


class Lasso(_StatsLinear):
    """``Lasso(alpha)`` (coordinate-descent objective 1/(2n)||r||^2 + alpha||w||_1)."""

    def __init__(self, alpha: float | None = None, featuresCol=None, labelCol=None, predictionCol=None):
        super().__init__()
        self._start(dict(alpha=alpha, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol), alpha=1.0)

    def _params_for(self, n, sd):
        return dict(elasticNetParam=1.0, regParam=self.getOrDefault("alpha"), maxIter=1000, tol=1e-8)


class ElasticNet(_StatsLinear):
    """``ElasticNet(alpha, l1_ratio)`` with MLlib's label scaling of the L2 part undone."""

    l1_ratio = _number("l1_ratio", "share of the L1 penalty")

    def __init__(self, alpha: float | None = None, l1_ratio: float | None = None, featuresCol=None, labelCol=None, predictionCol=None):
        super().__init__()
        self._start(dict(alpha=alpha, l1_ratio=l1_ratio, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol),
                    alpha=1.0, l1_ratio=0.5)

    def _params_for(self, n, sd):
        a, r = self.getOrDefault("alpha"), self.getOrDefault("l1_ratio")
        lam = a * r + a * (1 - r) * sd
        return dict(regParam=lam, elasticNetParam=(a * r / lam) if lam else 0.0, maxIter=1000, tol=1e-8)


class LogisticC(Estimator, _ColumnParams):
    """``LogisticRegression(C=1)`` -- L2 penalty 1/(2C) on the log-loss **sum**."""

    C = _number("C", "inverse weight of the penalty")
    maxIter = Param(Params._dummy(), "maxIter", "iterations at most", typeConverter=TypeConverters.toInt)

    def __init__(self, C: float | None = None, maxIter: int | None = None, featuresCol=None, labelCol=None, predictionCol=None):
        super().__init__()
        self._start(dict(C=C, maxIter=maxIter, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol), C=1.0, maxIter=100)

    def _fit(self, dataset):
        n = dataset.count()
        return LogisticRegression(featuresCol=self.getOrDefault("featuresCol"), labelCol=self.getOrDefault("labelCol"),
                                  predictionCol=self.getOrDefault("predictionCol"), maxIter=self.getOrDefault("maxIter"),
                                  regParam=1.0 / (self.getOrDefault("C") * n), elasticNetParam=0.0,
                                  standardization=False).fit(dataset)


# ----------------------------------------------------------------- M12: kernel machines via random features
class RandomFourierFeatures(WithParts, Model):
    """Maps numeric input columns to ``D`` random cosine features approximating an RBF kernel
    exp(-gamma ||x - y||^2) (Rahimi & Recht, 2007).  Pure Catalyst expressions: no UDF."""

    def __init__(self, inputCols: Sequence[str], outputPrefix: str = "rff_", gamma: float | None = None,
                 dim: int = 100, seed: int = 7):
        super().__init__()
        self.inputCols, self.outputPrefix, self.dim, self.seed = list(inputCols), outputPrefix, dim, seed
        self.gamma = gamma if gamma is not None else 1.0 / len(self.inputCols)  # gamma='auto'
        rng = np.random.default_rng(seed)
        self.W = rng.normal(0.0, math.sqrt(2 * self.gamma), size=(dim, len(self.inputCols)))
        self.b = rng.uniform(0, 2 * math.pi, size=dim)

    def _parts(self):
        return dict(inputCols=self.inputCols, outputPrefix=self.outputPrefix, gamma=float(self.gamma), dim=self.dim, seed=self.seed), {}, {}

    @classmethod
    def _from_parts(cls, values, tables, children):
        return cls(**values)  # the features follow from the seed

    def output_cols(self):
        return [f"{self.outputPrefix}{j}" for j in range(self.dim)]

    def _transform(self, dataset):
        scale = math.sqrt(2.0 / self.dim)
        exprs = []
        for j in range(self.dim):
            lin = F.lit(float(self.b[j]))
            for i, c in enumerate(self.inputCols):
                lin = lin + F.lit(float(self.W[j, i])) * F.col(c).cast("double")
            exprs.append((F.lit(scale) * F.cos(lin)).alias(f"{self.outputPrefix}{j}"))
        return dataset.select("*", *exprs)


def kernel_svc(inputCols: Sequence[str], labelCol: str = "label", dim: int = 100, gamma: float | None = None,
               regParam: float = 0.0, seed: int = 7, maxIter: int = 100) -> Pipeline:
    """M12 (classifier): RBF-kernel SVC re-aimed as random Fourier features + ``LinearSVC``."""
    rff = RandomFourierFeatures(inputCols, gamma=gamma, dim=dim, seed=seed)
    return Pipeline(stages=[rff, VectorAssembler(inputCols=rff.output_cols(), outputCol="rff_features"),
                            LinearSVC(featuresCol="rff_features", labelCol=labelCol, regParam=regParam,
                                      maxIter=maxIter)])


def kernel_svr(inputCols: Sequence[str], labelCol: str = "label", dim: int = 100, gamma: float | None = None,
               seed: int = 7) -> Pipeline:
    """M12 (regressor): RBF-kernel SVR re-aimed as random Fourier features + Huber regression."""
    rff = RandomFourierFeatures(inputCols, gamma=gamma, dim=dim, seed=seed)
    return Pipeline(stages=[rff, VectorAssembler(inputCols=rff.output_cols(), outputCol="rff_features"),
                            LinearRegression(featuresCol="rff_features", labelCol=labelCol, loss="huber")])


# ----------------------------------------------------------------- M13: AdaBoost SAMME
class AdaBoostSAMMEModel(WithParts, Model):
    """Adds the class with the most weighted votes, and ``probability``: the classes' shares of the votes."""

    def __init__(self, stumps, alphas, classes, featuresCol, predictionCol="prediction"):
        super().__init__()
        self.stumps, self.alphas, self.classes = stumps, alphas, classes
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def _parts(self):
        values = dict(alphas=[float(a) for a in self.alphas], classes=list(self.classes), featuresCol=self.featuresCol, predictionCol=self.predictionCol)
        return values, {}, {f"stump-{i}": s for i, s in enumerate(self.stumps)}

    @classmethod
    def _from_parts(cls, values, tables, children):
        return cls([children[f"stump-{i}"] for i in range(len(children))], **values)

    def _transform(self, dataset):
        out = dataset
        votes = {k: F.lit(0.0) for k in self.classes}
        for m, (stump, a) in enumerate(zip(self.stumps, self.alphas)):
            col = f"__h{m}"
            out = stump.setPredictionCol(col).setRawPredictionCol(f"__raw{m}") \
                       .setProbabilityCol(f"__prob{m}").transform(out).drop(f"__raw{m}", f"__prob{m}")
            for k in self.classes:
                votes[k] = votes[k] + F.when(F.col(col) == float(k), F.lit(a)).otherwise(0.0)
        best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
        pred = None
        for k in self.classes:  # first class with the top vote (argmax)
            pred = F.when(votes[k] == best, F.lit(float(k))) if pred is None else pred.when(votes[k] == best,
                                                                                          F.lit(float(k)))
        whole = float(sum(self.alphas)) or 1.0
        shares = array_to_vector(F.array(*[votes[k] / F.lit(whole) for k in self.classes]))
        return out.withColumn("probability", shares).withColumn(self.predictionCol, pred).drop(
            *[f"__h{m}" for m in range(len(self.stumps))])


class AdaBoostSAMME(Estimator, _ColumnParams):
    """``AdaBoostClassifier(algorithm='SAMME')`` with depth-1 trees and a weight column.

    Each round is a distributed stump fit plus one aggregation for the weighted
    error.  The weighted frame of a round is persisted while it is in use; every few
    rounds it is checkpointed to the cluster's checkpoint directory so the lineage
    stays short.
    """

    MAX_CLASSES = 1000

    n_estimators = Param(Params._dummy(), "n_estimators", "rounds at most", typeConverter=TypeConverters.toInt)
    learning_rate = _number("learning_rate", "factor of each round's vote")
    checkpoint_every = Param(Params._dummy(), "checkpoint_every", "rounds between checkpoints", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the stumps", typeConverter=TypeConverters.toInt)

    def __init__(self, n_estimators=None, learning_rate=None, featuresCol=None, labelCol=None, predictionCol=None,
                 checkpoint_every=None, seed=None):
        super().__init__()
        self._start(dict(n_estimators=n_estimators, learning_rate=learning_rate, featuresCol=featuresCol, labelCol=labelCol,
                         predictionCol=predictionCol, checkpoint_every=checkpoint_every, seed=seed),
                    n_estimators=50, learning_rate=1.0, checkpoint_every=5, seed=0)

    def _fit(self, dataset):
        features, label = self.getOrDefault("featuresCol"), self.getOrDefault("labelCol")
        found = dataset.select(label).distinct().limit(self.MAX_CLASSES + 1).collect()
        if len(found) > self.MAX_CLASSES:
            raise ValueError(f"{label} has over {self.MAX_CLASSES} values: not a class column")
        classes = sorted(r[0] for r in found)
        K = len(classes)
        if K < 2:
            raise ValueError(f"{label} has one class only")
        n = dataset.count()
        d = dataset.select(features, label).withColumn("__w", F.lit(1.0 / n)).persist()
        stumps, alphas = [], []
        ensure_checkpoint_dir(dataset.sparkSession)
        for m in range(self.getOrDefault("n_estimators")):
            tree = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="__w",
                                          maxDepth=1, seed=self.getOrDefault("seed") + m)
            model = tree.fit(d)
            p = model.setPredictionCol("__p").setRawPredictionCol("__r").setProbabilityCol("__q").transform(d)
            miss = F.col("__p") != F.col(label)
            row = p.agg(F.sum(F.when(miss, F.col("__w")).otherwise(0.0)).alias("e"), F.sum("__w").alias("t")).first()
            err = row["e"] / row["t"]
            if err <= 0:
                stumps.append(model)
                alphas.append(1.0)
                break
            if err >= 1.0 - 1.0 / K:
                if not stumps:
                    raise ValueError("first stump is no better than chance")
                break
            alpha = self.getOrDefault("learning_rate") * (math.log((1 - err) / err) + math.log(K - 1))
            stumps.append(model)
            alphas.append(alpha)
            # new total weight follows from this round's sums: no extra job to normalise
            new_total = (row["t"] - row["e"]) + row["e"] * math.exp(alpha)
            last, d = d, p.select(features, label,
                                  (F.col("__w") * F.when(miss, F.lit(math.exp(alpha))).otherwise(1.0)
                                   / F.lit(new_total)).alias("__w")).persist()
            if (m + 1) % self.getOrDefault("checkpoint_every") == 0:
                kept, d = d, d.checkpoint(eager=True)  # from the persisted rows
                kept.unpersist()
            else:
                d.count()
            last.unpersist()
        d.unpersist()
        return AdaBoostSAMMEModel(stumps, alphas, classes, features, self.getOrDefault("predictionCol"))


# ----------------------------------------------------------------- factories
def _gbt_params(params: dict) -> dict:
    """Booster parameter names -> GBT parameter names."""
    m = {"learning_rate": "stepSize", "n_estimators": "maxIter", "iterations": "maxIter", "max_depth": "maxDepth",
         "depth": "maxDepth", "subsample": "subsamplingRate", "min_samples_split": "minInstancesPerNode"}
    out = {}
    for k, v in params.items():
        if k in ("colsample_bytree", "max_features"):
            # a number from 0 to 1 is a share of the columns: "1.0" is all, where "1" would be one column
            out["featureSubsetStrategy"] = v if isinstance(v, str) else str(float(v)) if v <= 1 else str(int(v))
        else:
            out[m.get(k, k)] = v
    return out


# The three boosters (learn/boosters.py) and the names that their parameters go by.
BOOSTERS = {"xgb": SecondOrderBooster, "lgbm": LeafWiseBooster, "catboost": ObliviousBooster}
CATBOOST = dict(iterations=1000)  # rounds of the oblivious booster's library where none are given
_BOOSTER_NAMES = {"iterations": "n_estimators", "depth": "max_depth", "l2_leaf_reg": "reg_lambda"}


def booster(name: str, featuresCol: str = "features", labelCol: str = "label", seed: int = 42, **params):
    """``xgb``, ``lgbm`` or ``catboost`` with its documented defaults."""
    named = {_BOOSTER_NAMES.get(k, k): v for k, v in params.items()}
    return BOOSTERS[name](featuresCol=featuresCol, labelCol=labelCol, seed=seed, **named)


# Documented defaults of plain gradient boosting.
GBM = dict(maxIter=100, stepSize=0.1, maxDepth=3)


def full_forest(name: str, classification: bool, seed: int, params: dict, columns: dict) -> FullForest:
    """M06/M07 without a depth bound: one tree of all rows and columns, or a forest of bootstrapped trees."""
    named = {k: v for k, v in params.items() if k in ("n_estimators", "max_features", "min_samples_split", "min_samples_leaf", "finish_rows")}
    if name == "cart":
        return FullForest(**(named | {"n_estimators": 1}), classification=classification, seed=seed, **columns)
    return FullForest(**({"n_estimators": 100} | named), bootstrap=True, classification=classification, seed=seed, **columns)


def regressor(name: str, featuresCol: str = "features", labelCol: str = "label", seed: int = 42, **params):
    """M01-M10 (regression): name -> estimator.  Names: lr, ridge, lasso, enet, cart, rf, gbm, xgb, lgbm,
    catboost, knn, svr.  Trees of ``cart`` and ``rf`` grow until leaves are pure, unless ``max_depth`` (30 at most,
    on MLlib) is given."""
    kw = dict(featuresCol=featuresCol, labelCol=labelCol)
    if name == "lr":
        return LinearRegression(regParam=0.0, solver="normal", **kw)
    if name == "ridge":
        return Ridge(params.get("alpha", 1.0), **kw)
    if name == "lasso":
        return Lasso(params.get("alpha", 1.0), **kw)
    if name == "enet":
        return ElasticNet(params.get("alpha", 1.0), params.get("l1_ratio", 0.5), **kw)
    if name in ("cart", "rf") and not params.get("max_depth"):
        return full_forest(name, False, seed, params, kw)
    if name == "cart":
        return DecisionTreeRegressor(maxDepth=params["max_depth"], seed=seed, **kw)
    if name == "rf":
        return RandomForestRegressor(numTrees=params.get("n_estimators", 100),
                                     maxDepth=params["max_depth"], seed=seed, **kw)
    if name == "knn":
        return KNN(k=params.pop("k", 5), **params, **kw)
    if name == "svr":
        return KernelSVM(**params, **kw)
    if name == "gbm":
        return GBTRegressor(seed=seed, **(GBM | _gbt_params(params)), **kw)
    if name in BOOSTERS:
        return booster(name, seed=seed, **params, **kw)
    raise ValueError(name)


def classifier(name: str, featuresCol: str = "features", labelCol: str = "label", seed: int = 42, **params):
    """M05-M13 (classification): logreg, cart, rf, adaboost, gbm, xgb, lgbm, catboost."""
    kw = dict(featuresCol=featuresCol, labelCol=labelCol)
    if name == "logreg":
        return LogisticC(params.get("C", 1.0), params.get("max_iter", 100), **kw)
    if name in ("cart", "rf") and not params.get("max_depth"):
        return full_forest(name, True, seed, params, kw)
    if name == "cart":
        return DecisionTreeClassifier(maxDepth=params["max_depth"], seed=seed, **kw)
    if name == "rf":
        return RandomForestClassifier(numTrees=params.get("n_estimators", 100),
                                      maxDepth=params["max_depth"], seed=seed, **kw)
    if name == "adaboost":
        return AdaBoostSAMME(params.get("n_estimators", 50), params.get("learning_rate", 1.0), seed=seed, **kw)
    if name == "knn":
        return KNN(k=params.pop("k", 5), classification=True, **params, **kw)
    if name == "svc":
        return KernelSVM(classification=True, **params, **kw)
    if name == "gbm":
        return GBTClassifier(seed=seed, **(GBM | _gbt_params(params)), **kw)
    if name in BOOSTERS:
        return booster(name, seed=seed, classification=True, **params, **kw)
    raise ValueError(name)


def assemble(cols: Sequence[str], outputCol: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=outputCol, handleInvalid="error")


def fit_predict(estimator, train: DataFrame, score: DataFrame, cols: Sequence[str],
                labelCol: str = "label") -> tuple[PipelineModel, DataFrame]:
    """Assemble + fit on ``train``, score ``score``."""
    model = Pipeline(stages=[assemble(cols), estimator]).fit(train)
    return model, model.transform(score)


def feature_importance(model, names: Sequence[str], top: int | None = None) -> DataFrame:
    """(feature, importance) sorted descending; ``top`` keeps the n largest (a top-n report)."""
    from pyspark.sql import SparkSession
    m = model.stages[-1] if isinstance(model, PipelineModel) else model
    imp = m.featureImportances.toArray() if hasattr(m, "featureImportances") else np.abs(m.coefficients.toArray())
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    out = df.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out
