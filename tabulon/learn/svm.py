"""RBF support vector machines with their own losses (M12): hinge and epsilon-insensitive.

*Kernel.*  ``landmarks`` training rows (those of smallest hash, a proven bound) span the features:
``phi(x) = K(x, L) K(L, L)^(-1/2)``, whose inner products are the kernel's where the
landmarks cover the data (Nystroem).  With as many landmarks as different rows it is the kernel itself.

*Fit.*  Distributed dual coordinate ascent on ``|w|^2 / 2 + C * sum of losses``: every row has a
dual variable, kept in blocks.  In a round each task goes ``SWEEPS`` times through each of its blocks and improves
their duals one by one against ``w`` and its own changes, which count ``tasks`` times
as much as they are, so that the changes of all tasks can be added.  A round's blocks are
written in the shared folder; a task that runs again does the same steps in the same order.  A block
holds the rows' columns, not ``phi`` of them, which has as many numbers as landmarks: each round computes it
anew, for a block at a time, and the folders of a fit grow with rows times columns.

*When it stops.*  Every round also sums the primal and the dual objective at its start.
Their difference, the duality gap, bounds the distance from the best value; the fit ends
when it is below ``tolerance`` times the primal value, and ``gaps`` is the table of all rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators._mlbase import HasState
from tabulon.session import scratch_path, ship_package

BLOCK_ROWS = 4096
SWEEPS = 10
WHOLE_ROWS = 16 * BLOCK_ROWS  # rows up to which one task holds all duals


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    far = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(far, 0.0))


class Nystroem:
    """``phi`` of rows; the last feature is 1, for the intercept."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        self.landmarks, self.gamma = landmarks, gamma
        value, vector = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
        keep = value > 1e-10 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([rbf(x, self.landmarks, self.gamma) @ self.root, np.ones(len(x))])


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) if n else np.zeros((0, 0))


def _blocks():
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
                # column by column, where equal values lie together and pack well
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([_matrix(part.column("x")).T.tobytes()], pa.binary()),
                                                  pa.array([y.tobytes()], pa.binary()), pa.array([np.zeros(len(y)).tobytes()], pa.binary())],
                                                 names=["n", "x", "y", "dual"])

    return cut


_KIND = "n int, x binary, y binary, dual binary, change binary, primal double, dual_value double"


def hinge_step(dual: float, y: float, score: float, curve: float, c: float, _: float) -> float:
    """The dual (0 to C times y) that is best for one row, the others as they are."""
    return y * min(max(dual * y + (1 - y * score) / curve, 0.0), c)


def tube_step(dual: float, y: float, score: float, curve: float, c: float, epsilon: float) -> float:
    free = dual + (y - score) / curve
    size = max(abs(free) - epsilon / curve, 0.0)
    return max(min(math.copysign(size, free), c), -c)


def _round(phi: Nystroem, w: np.ndarray, round_: int, tasks: int, c: float, epsilon: float, classification: bool):
    """Coordinate ascent over a task's rows, block by block; objectives are those before it."""
    step = hinge_step if classification else tube_step

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros(len(w))
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                x = phi(np.ascontiguousarray(np.frombuffer(b.column("x")[i].as_py()).reshape(-1, n).T))
                y, dual = np.frombuffer(b.column("y")[i].as_py()), np.frombuffer(b.column("dual")[i].as_py()).copy()
                before = moved.copy()
                score = x @ w
                if classification:
                    loss, value = np.maximum(1 - y * score, 0.0), dual * y
                else:
                    loss, value = np.maximum(np.abs(y - score) - epsilon, 0.0), y * dual - epsilon * np.abs(dual)
                curve = tasks * np.maximum((x * x).sum(axis=1), 1e-12)
                rows, duals, labels, scores, curves = list(x), dual.tolist(), y.tolist(), score.tolist(), curve.tolist()  # plain numbers: the loop is short steps
                # a block's rows are gone through several times, each time in another order
                for k in np.concatenate([np.random.default_rng([round_, sweep]).permutation(n) for sweep in range(SWEEPS)]).tolist():
                    row, old = rows[k], duals[k]
                    new = step(old, labels[k], scores[k] + tasks * float(row.dot(moved)), curves[k], c, epsilon)
                    if new != old:
                        moved += (new - old) * row
                        duals[k] = new
                dual = np.array(duals, float)
                yield pa.RecordBatch.from_arrays(
                    [b.column("n").slice(i, 1), b.column("x").slice(i, 1), b.column("y").slice(i, 1), pa.array([dual.tobytes()], pa.binary()),
                     pa.array([(moved - before).tobytes()], pa.binary()), pa.array([float(c * loss.sum())]), pa.array([float(value.sum())])],
                    names=["n", "x", "y", "dual", "change", "primal", "dual_value"])

    return ascend


def dual_ascent(blocks: DataFrame, phi: Nystroem, tasks: int, c: float, epsilon: float, classification: bool, tolerance: float,
                rounds: int) -> tuple[np.ndarray, list[tuple[int, float, float, float]]]:
    """(w, [(round, primal, dual, gap)]) of ``|w|^2 / 2 + c * losses`` over the written ``blocks``."""
    spark, w, gaps = blocks.sparkSession, np.zeros(phi.root.shape[1] + 1), []
    for k in range(rounds):
        path = scratch_path(spark, "duals")
        # not more tasks than the step allows for
        blocks.select("n", "x", "y", "dual").coalesce(tasks).mapInArrow(_round(phi, w, k, tasks, c, epsilon, classification), _KIND).write.option("compression", "zstd").parquet(path)
        after = spark.read.schema(_KIND).parquet(path)
        rows = after.select("change", "primal", "dual_value").collect()  # a row of d numbers for each block of rows
        half = float(w @ w) / 2
        primal, dual = half + sum(r["primal"] for r in rows), sum(r["dual_value"] for r in rows) - half
        gaps.append((k, primal, dual, primal - dual))
        if primal - dual <= tolerance * max(abs(primal), 1e-12) or k == rounds - 1:
            break  # the last gap is that of the model
        w = w + sum(np.frombuffer(r["change"]) for r in rows)
        blocks = after
    return w, gaps


class KernelSVM(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``SVC`` / ``SVR`` with an RBF kernel: ``C``, ``gamma`` (0: one over the number of columns) and ``epsilon`` as usual."""

    C = Param(Params._dummy(), "C", "weight of the losses", typeConverter=TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", typeConverter=TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors that cost nothing (regression)", typeConverter=TypeConverters.toFloat)
    classification = Param(Params._dummy(), "classification", "two classes, 0 and 1", typeConverter=TypeConverters.toBoolean)
    landmarks = Param(Params._dummy(), "landmarks", "rows that span the kernel", typeConverter=TypeConverters.toInt)
    tolerance = Param(Params._dummy(), "tolerance", "duality gap over the primal value", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the landmarks", typeConverter=TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of columns", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(C=1.0, gamma=0.0, epsilon=0.1, classification=False, landmarks=100, tolerance=1e-3, maxIter=50, seed=7,
                         featuresCol="features", labelCol="label")
        self._set(**{k: v for k, v in params.items() if v is not None})

    def _fit(self, dataset):
        spark = dataset.sparkSession
        ship_package(spark)
        g = self.getOrDefault
        rows = dataset.select(vector_to_array(g("featuresCol")).alias("x"), F.col(g("labelCol")).cast("double").alias("y")).where("y is not null")
        if g("classification"):
            rows = rows.withColumn("y", 2 * F.col("y") - 1)
        some = rows.select("x").distinct().orderBy(F.xxhash64("x", F.lit(g("seed"))), "x").limit(g("landmarks")).collect()  # a bounded number
        if not some:
            raise ValueError("no rows to fit")
        points = np.array([r["x"] for r in some], float)
        phi = Nystroem(points, g("gamma") or 1.0 / points.shape[1])
        path = scratch_path(spark, "kernel")
        kind = "n int, x binary, y binary, dual binary"
        rows.mapInArrow(_blocks(), kind).write.option("compression", "zstd").parquet(path)
        blocks = spark.read.schema(kind).parquet(path)
        count = blocks.agg(F.sum("n")).first()[0]
        # fewer tasks need fewer rounds
        tasks = 1 if count <= WHOLE_ROWS else max(1, blocks.select(F.spark_partition_id()).distinct().count())
        w, gaps = dual_ascent(blocks, phi, tasks, g("C"), g("epsilon"), g("classification"), g("tolerance"), g("maxIter"))
        model = KernelSVMModel()
        model._set(featuresCol=g("featuresCol"))
        model._set_state(dict(landmarks=points.tolist(), gamma=phi.gamma, w=w.tolist(), classification=g("classification"), gaps=[list(x) for x in gaps]))
        return model


class KernelSVMModel(Model, HasState, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``; for two classes also ``rawPrediction``, the signed distance."""

    featuresCol = Param(Params._dummy(), "featuresCol", "vector of columns", typeConverter=TypeConverters.toString)

    def gaps(self, spark) -> DataFrame:
        """(round, primal, dual_value, gap): at most ``maxIter`` rows."""
        return spark.createDataFrame([(int(k), p, d, x) for k, p, d, x in self._state()["gaps"]], "round int, primal double, dual_value double, gap double")

    def _transform(self, dataset):
        from pyspark.ml.functions import array_to_vector
        ship_package(dataset.sparkSession)
        state = self._state()
        phi, w = Nystroem(np.array(state["landmarks"], float), state["gamma"]), np.array(state["w"])

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(phi(np.stack([np.asarray(v, float) for v in x])) @ w)

        scored = dataset.withColumn("__score", score(vector_to_array(self.getOrDefault("featuresCol"))))
        if not state["classification"]:
            return scored.withColumnRenamed("__score", "prediction")
        raw = array_to_vector(F.array(-F.col("__score"), F.col("__score")))
        return scored.withColumn("rawPrediction", raw).withColumn("prediction", (F.col("__score") > 0).cast("double")).drop("__score")


__all__ = ["KernelSVM", "KernelSVMModel", "Nystroem", "dual_ascent", "rbf"]
