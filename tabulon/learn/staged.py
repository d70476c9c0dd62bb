"""Every prefix of a boosted model, from one fit and one pass.

A boosted model of 500 rounds holds the models of 1, 2, ... 499 rounds: a round only
adds a tree.  So a grid or a validation curve along the number of rounds needs one
fit a fold, at the largest number.  The fitted trees are read into arrays, sent to
the tasks, and each row's running sum of trees is looked at after the asked rounds.
Scores are sums per (fold, rounds) that the tasks add up; ROC AUC, which needs the
order of all scores, is taken from the table of staged scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_package

# the four kinds of lines of a printed model
_TREE = re.compile(r"\s*Tree \d+ \(weight ([-+.\dEe]+)\):")
_IF = re.compile(r"\s*If \(feature (\d+) (<=|in) (.+)\)$")
_ELSE = re.compile(r"\s*Else \(feature")
_LEAF = re.compile(r"\s*Predict: ([-+.\dEeNa]+)")


class Trees:
    """Trees as flat arrays: node -> feature (-1: leaf), threshold, side of missing values, children, value; ``roots`` and
    ``weights`` per tree; their sum starts at ``base``, and ``link`` times it is the log odds of class 1."""

    def __init__(self, base: float = 0.0, link: float = 2.0):
        self.feature, self.threshold, self.missing_left, self.left, self.right, self.value = [], [], [], [], [], []
        self.roots, self.weights, self.base, self.link = [], [], base, link

    def _node(self) -> int:
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def frozen(self) -> Trees:
        self.feature, self.left, self.right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        self.threshold, self.value, self.weights = (np.array(x, float) for x in (self.threshold, self.value, self.weights))
        self.missing_left = np.array(self.missing_left, bool)
        return self

    def values(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf value of one tree for each row."""
        at = np.full(len(x), self.roots[tree], np.int32)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            value = x[inner, self.feature[node]]
            low = (value <= self.threshold[node]) | (np.isnan(value) & self.missing_left[node])
            at[inner] = np.where(low, self.left[node], self.right[node])


def read_trees(model) -> Trees:
    """The trees of a fitted boosted (or single) tree model; MLlib's are read from its printed form, which holds every
    threshold in full."""
    if hasattr(model, "boosted_trees"):
        return model.boosted_trees()
    out, waiting, node = Trees(), [], None
    lines = model.toDebugString.splitlines()
    if not any(_TREE.match(line) for line in lines):
        lines = ["Tree 0 (weight 1.0):", *lines]
    for line in lines:
        if found := _TREE.match(line):
            out.roots.append(out._node())
            out.weights.append(float(found[1]))
            waiting, node = [], out.roots[-1]
        elif found := _IF.match(line):
            if found[2] != "<=":
                raise ValueError("categorical splits are not read")
            out.feature[node], out.threshold[node] = int(found[1]), float(found[3])
            waiting.append(node)
            out.left[node] = node = out._node()
        elif _ELSE.match(line):
            parent = waiting.pop()
            out.right[parent] = node = out._node()
        elif found := _LEAF.match(line):
            out.value[node] = float(found[1])
    return out.frozen()


def staged_sums(trees: Trees, x: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
    """[row, stage]: the weighted sum of the first ``rounds[stage]`` trees."""
    out, total, done = np.zeros((len(x), len(rounds))), np.full(len(x), trees.base), 0
    for k in np.argsort(rounds, kind="stable"):
        while done < min(rounds[k], len(trees.roots)):
            total = total + trees.weights[done] * trees.values(done, x)
            done += 1
        out[:, k] = total
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def staged_scores(df: DataFrame, models: dict, rounds: Sequence[int], fold: str = "fold", task: str = "regression",
                  features_col: str = "features", label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., fold, label, rounds, prediction, score): rows scored by the model of their fold, after each number of rounds.

    ``models``: fold -> fitted boosted model.  Regression has a null score; for two classes the
    score is the probability of class 1, as the boosted classifier has it: ``1 / (1 + exp(-link * m))``.
    """
    ship_package(df.sparkSession)
    trees, rounds = {f: read_trees(m) for f, m in models.items()}, [int(r) for r in rounds]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, folds = _matrix(b.column("__x")), b.column("__fold").to_numpy(zero_copy_only=False)
            sums = np.zeros((b.num_rows, len(rounds)))
            for f, of in trees.items():
                mine = folds == f
                if mine.any():
                    sums[mine] = staged_sums(of, x[mine], rounds) * (1.0 if task == "regression" else of.link)
            flat = pa.array(sums.ravel())
            staged = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(rounds), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("__row"), staged], names=["__row", "staged"])

    row = F.struct(*keep, F.col(fold), F.col(label).cast("double").alias("label"))
    src = df.where(F.col(fold).isin(list(trees))).select(row.alias("__row"), F.col(fold).cast("int").alias("__fold"),
                                                         vector_to_array(features_col).alias("__x"))
    kind = src.schema["__row"].dataType.simpleString()
    done = src.mapInArrow(score, f"__row {kind}, staged array<double>").select("__row.*", F.posexplode("staged").alias("__k", "__s"))
    done = done.withColumn("rounds", F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("__k") + 1))
    if task == "regression":
        return done.select(*keep, fold, "label", "rounds", F.col("__s").alias("prediction"), F.lit(None).cast("double").alias("score"))
    chance = 1 / (1 + F.exp(-F.col("__s")))
    return done.select(*keep, fold, "label", "rounds", (F.col("__s") > 0).cast("double").alias("prediction"), chance.alias("score"))


def staged_metrics(df: DataFrame, models: dict, rounds: Sequence[int], metric: str, fold: str = "fold", task: str = "regression",
                   features_col: str = "features", label: str = "label") -> DataFrame:
    """(fold, rounds, split, score): each fold's model on its own fold (``validation``) and on the others (``train``)."""
    from tabulon.learn.evaluate import metrics_by_fold
    if task == "regression":
        return _regression_stages(df, models, rounds, metric, fold, features_col, label)
    folds = list(models)
    # a row is scored by the model of every fold: by its own as validation, by the others as training
    every = df.where(F.col(fold).isNotNull()).withColumn("__own", F.col(fold)).withColumn("__of", F.explode(F.array(*[F.lit(int(f)) for f in folds])))
    every = every.withColumn("split", F.when(F.col("__own") == F.col("__of"), "validation").otherwise("train"))
    scored = staged_scores(every, models, rounds, "__of", task, features_col, label, keep=["split"])
    per = metrics_by_fold(scored, "label", "prediction", "__of", "score" if metric in ("auc", "roc_auc", "areaUnderROC") else None, by=["rounds", "split"])
    name = "auc" if metric in ("roc_auc", "areaUnderROC") else metric
    return per.select(F.col("__of").alias(fold), "rounds", "split", F.col(name).alias("score"))


def _regression_stages(df: DataFrame, models: dict, rounds: Sequence[int], metric: str, fold: str, features_col: str, label: str) -> DataFrame:
    """(fold, rounds, split, score) from sums that each task adds up: no row is written for a model or a number of rounds."""
    ship_package(df.sparkSession)
    trees, rounds = {int(f): read_trees(m) for f, m in models.items()}, [int(r) for r in rounds]
    src = df.where(F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("own"), F.col(label).cast("double").alias("y"),
                                                   vector_to_array(features_col).alias("x")).where("y is not null")
    centre = src.agg(F.avg("y")).first()[0] or 0.0  # one number, so that squares lose no digits

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(trees), len(rounds), 2, 5))
        for b in batches:
            x, y, own = _matrix(b.column("x")), b.column("y").to_numpy(), b.column("own").to_numpy()
            if not len(y):
                continue
            z = y - centre
            for i, (f, of) in enumerate(trees.items()):
                e = staged_sums(of, x, rounds) - y[:, None]
                for split, mine in enumerate((own != f, own == f)):
                    part, there = e[mine], z[mine]
                    for k, v in enumerate((mine.sum(), np.abs(part).sum(axis=0), (part * part).sum(axis=0), there.sum(), (there * there).sum())):
                        sums[i, :, split, k] += v
        of, stage, split = np.nonzero(sums[..., 0])
        found = sums[of, stage, split]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(trees), np.int32)[of]), pa.array(np.array(rounds, np.int32)[stage]),
                                          pa.array(np.array(["train", "validation"])[split]), *[pa.array(c.copy()) for c in found.T]], names=["of", "rounds", "split", *_SUMS])

    kind = "of int, rounds int, split string, " + ", ".join(f"{c} double" for c in _SUMS)
    per = src.mapInArrow(add, kind).groupBy("of", "rounds", "split").agg(*[F.sum(c).alias(c) for c in _SUMS])
    variation = F.col("zz") - F.col("z") * F.col("z") / F.col("n")
    score = {"rmse": F.sqrt(F.col("squares") / F.col("n")), "mae": F.col("sizes") / F.col("n"), "r2": 1 - F.try_divide("squares", variation)}[metric]
    return per.select(F.col("of").alias(fold), "rounds", "split", score.alias("score"))


_SUMS = ["n", "sizes", "squares", "z", "zz"]

__all__ = ["Trees", "read_trees", "staged_sums", "staged_scores", "staged_metrics"]
