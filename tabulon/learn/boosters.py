"""Three boosted-tree learners (M09, M10): second-order, leaf-wise and oblivious.

They differ in how a tree grows; the work on the rows is the same and is shared by all
models of a call (the folds of a cross-validation, the points of a grid):

* rows become blocks of bin numbers once (``weighted_cuts`` gives each column's limits) and
  are written in the shared folder;
* a **pass** adds up, for every open node of every model, the sums of gradient,
  Hessian and rows for each bin of each column (a task's histograms are added in
  groups, and the driver adds the last few).  Split decisions need nothing else;
* margins are written again every ``WRITE_EVERY`` rounds; trees since then are applied in the
  pass, so any task can run again from the written blocks;
* where the blocks of all rows have up to ``WHOLE_BYTES``, each model is grown to its last round in one task that
  holds them (``_grow_whole``), by the same sums and decisions: no job a level, models side by side;
* on the way by passes up to ``MODELS`` models share a pass, so that a block's margins stay small.

``SecondOrderBooster`` splits all nodes of a level, with the gain
``GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)`` halved and less ``gamma``.
``LeafWiseBooster`` splits the open leaf of the largest gain until there are
``num_leaves``; a pass looks into all leaves that could still be split, which
changes the number of passes and not the order of splits.  ``ObliviousBooster`` takes one
split for a whole level, the one with the best sum over its leaves;
``OrderedTargetEncoder`` gives it categories.  Rows with a missing value go to the side that
gains more (below all values in oblivious trees).  Of two children only the one with fewer
rows is counted; the other is the parent less its sibling.

Every number that reaches the driver is a histogram: models x nodes x bins, in turns of
``MOST_NUMBERS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.moments import GROUPS
from tabulon.functions.ranking import running_sums
from tabulon.learn.staged import Trees, staged_sums
from tabulon.operators._mlbase import HasState
from tabulon.session import scratch_path, ship_package

BLOCK_ROWS = 8192
WRITE_EVERY = 10
MOST_NUMBERS = 1 << 20
MODELS = 8  # models whose margins a block holds
WHOLE_BYTES = 96 << 20  # of a model's rows in the task that holds them all
DIRECT_TASKS = 2 * GROUPS  # histograms of so many tasks go to the driver as they are
SUMMARY = 2048  # points that stand for a column within a task
MISSING = 255  # bin of a missing value
WALK_LEVELS = 3  # levels that all rows go down before those at a leaf are left out


# ----------------------------------------------------------------- bins
def _compress(value: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values and their weights; beyond ``most`` of them, ``most`` values at equal steps of weight."""
    value, inverse = np.unique(value, return_inverse=True)
    weight = np.bincount(inverse, weights=weight, minlength=len(value))
    if len(value) <= most:
        return value, weight
    part = np.minimum((np.cumsum(weight) - weight / 2) / weight.sum() * most, most - 1).astype(int)
    ends = np.append(np.flatnonzero(np.diff(part)), len(part) - 1)
    return value[ends], np.diff(np.append(0.0, np.cumsum(weight)[ends]))


def _summaries(d: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0)) for _ in range(d)]
        for b in batches:
            x, w = _matrix(b.column("x"), d), b.column("w").to_numpy(zero_copy_only=False)
            for f in range(d):
                there = ~np.isnan(x[:, f])
                held[f] = _compress(np.concatenate([held[f][0], x[there, f]]), np.concatenate([held[f][1], w[there]]), SUMMARY)
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()), pa.array([v.tobytes() for v, _ in held], pa.binary()),
             pa.array([w.tobytes() for _, w in held], pa.binary())], names=["feature", "part", "value", "weight"])

    return summarise


def _merged(table: pa.Table) -> pa.Table:
    value, weight = (np.concatenate([np.frombuffer(x.as_py()) for x in table[c]]) for c in ("value", "weight"))
    value, weight = _compress(value, weight, SUMMARY)
    return pa.table({"feature": table["feature"][:1], "part": table["part"][:1], "value": pa.array([value.tobytes()], pa.binary()),
                     "weight": pa.array([weight.tobytes()], pa.binary())})


def weighted_cuts(df: DataFrame, features_col: str, d: int, bins: int, weight: str | None = None) -> list[np.ndarray]:
    """Limits between the bins of each column: at most ``bins`` bins of about equal weight.

    A value belongs to the first bin whose limit is not below it.  A column with up to ``bins``
    different values has a limit halfway between any two of them.  Otherwise limits are
    weighted quantiles; a task keeps ``SUMMARY`` points a column, which is off by its
    weight over ``SUMMARY`` at most.
    """
    ship_package(df.sparkSession)
    src = df.select(vector_to_array(features_col).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    kind = "feature int, part int, value binary, weight binary"
    rows = src.mapInArrow(_summaries(d), kind).groupBy("feature", "part").applyInArrow(_merged, kind).collect()  # GROUPS a column
    out = []
    for f in range(d):
        mine = [r for r in rows if r["feature"] == f]
        value, total = _compress(np.concatenate([np.frombuffer(r["value"]) for r in mine] or [np.zeros(0)]),
                                 np.concatenate([np.frombuffer(r["weight"]) for r in mine] or [np.zeros(0)]), GROUPS * SUMMARY)
        middle = (value[:-1] + value[1:]) / 2
        if len(value) > bins:
            share = np.cumsum(total)[:-1] / total.sum()
            middle = middle[np.unique(np.searchsorted(share, np.arange(1, bins) / bins).clip(0, len(middle) - 1))]
        out.append(middle)
    return out


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), d)


def _bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for f, limits in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(limits, x[:, f], side="left"))
    return out


def _blocks(cuts: list[np.ndarray], models: int):
    """Rows of a task in blocks: bins, label, fold and the margin of each model."""
    d = len(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            n = rows.num_rows
            x = _bins_of(_matrix(rows["x"].combine_chunks(), d), cuts)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([n], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                 pa.array([rows["y"].to_numpy().tobytes()], pa.binary()), pa.array([rows["fold"].to_numpy().astype(np.int32).tobytes()], pa.binary()),
                 pa.array([np.zeros((n, models)).tobytes()], pa.binary())], names=_BLOCK)

        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            while count >= BLOCK_ROWS:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, BLOCK_ROWS))
                held, count = rows.slice(BLOCK_ROWS).to_batches(), count - BLOCK_ROWS
        if count:
            yield block(pa.Table.from_batches(held))

    return cut


_BLOCK = ["block", "n", "x", "y", "fold", "margin"]
_BLOCK_KIND = "block long, n int, x binary, y binary, fold binary, margin binary"


# ----------------------------------------------------------------- trees over bins
class _Tree:
    """A tree while it grows: node -> column, last bin of the left side, side of missing values, children, value, gain."""

    def __init__(self):
        self.feature, self.bin, self.missing_left, self.left, self.right, self.value, self.gain = [-1], [0], [False], [0], [0], [0.0], [0.0]

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float) -> tuple[int, int]:
        left = len(self.feature)
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = int(feature), int(at), bool(missing_left), float(gain)
        self.left[node], self.right[node] = left, left + 1
        return left, left + 1

    def arrays(self) -> tuple:
        return (np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.missing_left, bool),
                np.array(self.left, np.int32), np.array(self.right, np.int32), np.array(self.value))


class _Walk:
    """Rows to the leaves of a tree.  A table by (node, bin) holds the next node, so a level is one look-up a row; a leaf
    leads to itself."""

    def __init__(self, tree: tuple):
        feature, last, missing_left, left, right, _ = tree
        self.inner = feature >= 0
        self.column = np.where(self.inner, feature, 0).astype(np.intp)
        low = np.arange(MISSING + 1)[None, :] <= last[:, None]
        low[:, MISSING] = missing_left
        step = np.where(low, left[:, None], right[:, None])
        self.step = np.where(self.inner[:, None], step, np.arange(len(feature))[:, None]).astype(np.intp).ravel()

    def __call__(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """``x``: bins of a block, row by row; ``begins``: where the rows begin in it."""
        at = np.zeros(len(begins), np.intp)
        if not self.inner[0]:
            return at
        node, here, rows = at, begins, None  # all of them
        while True:
            for _ in range(WALK_LEVELS):
                place = self.column.take(node, mode="clip")
                place += here
                node = node << 8
                node += x.take(place, mode="clip")
                node = self.step.take(node, mode="clip")
            if rows is None:
                at = node
            else:
                at[rows] = node
            left = np.flatnonzero(self.inner.take(node, mode="clip"))
            if not len(left):
                return at
            rows = left if rows is None else rows[left]
            node, here = node[left], here[left]


def _gradients(y: np.ndarray, margin: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return margin - y, np.ones(len(y))
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _drawn(block: int, round_: int, seed: int, n: int, share: float) -> np.ndarray:
    """The rows of a block that a round uses: the same whenever and wherever it is asked."""
    return np.random.Generator(np.random.PCG64([seed, round_, block])).random(n) < share


class _Job:
    """What one model needs from a pass: its trees since the margins were written, the tree that grows, the open nodes' places."""

    def __init__(self, number, base, left_out, logistic, seed, share, round_, trees, tree, places):
        self.number, self.base, self.left_out, self.logistic = number, base, left_out, logistic
        self.seed, self.share, self.round, self.trees, self.tree, self.places = seed, share, round_, trees, tree, places


def _read_block(b: pa.RecordBatch, i: int, d: int, models: int):
    n = b.column("n")[i].as_py()
    get = lambda name, kind: np.frombuffer(b.column(name)[i].as_py(), kind)
    margin = get("margin", float).reshape(n, models) if models else None
    return b.column("block")[i].as_py(), get("x", np.uint8).reshape(n, d), get("y", float), get("fold", np.int32), margin


def _histograms(jobs: list[_Job], offsets: np.ndarray, width: int, models: int):
    """Sums (gradient, Hessian, rows) by (job, open node, bin); a task's are one row."""
    d = len(offsets)
    begins = np.concatenate([[0], np.cumsum([len(j.places) for j in jobs])])
    squares = not any(j.logistic for j in jobs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = np.zeros((3, int(begins[-1]) * width)), False
        walks = [(_Walk(j.tree), [(_Walk(t), t[5]) for t in j.trees]) for j in jobs]
        for b in batches:
            for i in range(b.num_rows):
                any_ = True
                block, x, y, fold, margin = _read_block(b, i, d, models)
                flat, first = x.ravel(), np.arange(len(x)) * d
                cells = offsets[None, :] + np.where(x == MISSING, offsets_end[None, :], x)
                for j, begin, (grown, trees) in zip(jobs, begins, walks):
                    where = np.full(len(j.tree[0]), -1)
                    where[list(j.places)] = np.arange(len(j.places))
                    slot = where[grown(flat, first)]
                    rows = (fold != j.left_out) & (slot >= 0)
                    if j.share < 1:
                        rows &= _drawn(block, j.round, j.seed, len(y), j.share)
                    rows = np.flatnonzero(rows)
                    if not len(rows):
                        continue
                    at = margin[rows, j.number] + j.base
                    for tree, value in trees:
                        at = at + value[tree(flat, first[rows])]
                    g, h = _gradients(y[rows], at, j.logistic)
                    lo, hi = int(begin) * width, (int(begin) + len(j.places)) * width
                    key = (slot[rows, None] * width + cells[rows]).ravel()
                    for k, v in enumerate((g, None if squares else h, None)):
                        if k < 2 or not squares:
                            sums[k, lo:hi] += np.bincount(key, None if v is None else np.repeat(v, d), hi - lo)
        if squares:  # the Hessian of a row is 1
            sums[2] = sums[1]
        sums = sums.T
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()),
                                              pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"])

    offsets_end = np.append(offsets[1:], width) - offsets - 1  # the missing bin comes last in a column
    return add


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table({"part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _moved(trees: dict[int, list], d: int, models: int):
    """Blocks with the trees added to their margins."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = {m: [(_Walk(t), t[5]) for t in grown] for m, grown in trees.items()}
        for b in batches:
            for i in range(b.num_rows):
                _, x, _, _, margin = _read_block(b, i, d, models)
                margin, flat, first = margin.copy(), x.ravel(), np.arange(len(x)) * d
                for m, grown in walks.items():
                    for tree, value in grown:
                        margin[:, m] += value[tree(flat, first)]
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in _BLOCK[:-1]], pa.array([margin.tobytes()], pa.binary())], names=_BLOCK)

    return move


# ----------------------------------------------------------------- split decisions (driver: histograms only)
class Splits:
    """The best split of each of some nodes from their histograms [node, column, bin, (G, H, rows)], the last bin for missing values."""

    def __init__(self, cells: np.ndarray, bins: np.ndarray, lam: float, columns: np.ndarray, least_weight: float, least_rows: float):
        total = cells[:, :1].sum(axis=2)[:, 0]  # every column holds all rows of the node
        self.total = total
        missing, present = cells[:, :, -1:], cells[:, :, :-1]
        below = np.cumsum(present, axis=2)
        can = (np.arange(present.shape[2])[None, :] < (bins - 1)[:, None]) & columns[:, None]
        best = None
        for missing_left in (False, True):
            left = below + missing if missing_left else below
            right = total[:, None, None] - left
            gain = _score(left, lam) + _score(right, lam) - _score(total, lam)[:, None, None]
            fine = can[None] & (np.minimum(left[..., 1], right[..., 1]) >= least_weight) & (np.minimum(left[..., 2], right[..., 2]) >= max(least_rows, 1))
            gain = np.where(fine, gain, -np.inf).reshape(len(cells), -1)
            at = gain.argmax(axis=1)
            found = gain[np.arange(len(cells)), at]
            if best is None:
                best = [found, at, np.zeros(len(cells), bool)]
            else:
                better = found > best[0]
                best = [np.where(better, found, best[0]), np.where(better, at, best[1]), better]
        self.gain, self.missing_left = best[0], best[2]
        self.feature, self.bin = np.divmod(best[1], present.shape[2])


def _score(sums: np.ndarray, lam: float) -> np.ndarray:
    return sums[..., 0] ** 2 / np.maximum(sums[..., 1] + lam, 1e-300)


class _Grower:
    """One model's tree of a round.  ``open`` nodes need a histogram from the next pass."""

    def __init__(self, params: dict, bins: np.ndarray, columns: np.ndarray):
        self.p, self.bins, self.columns = params, bins, columns
        self.tree, self.cells, self.depth = _Tree(), {}, {0: 0}
        self.open, self.sibling = [0], {}

    def take(self, found: dict[int, np.ndarray]) -> None:
        """Histograms of the open nodes arrive; siblings follow by subtraction."""
        for node, cells in found.items():
            self.cells[node] = cells
            if node in self.sibling:
                parent, other = self.sibling.pop(node)
                self.cells[other] = self.cells[parent] - cells
        self.open = []
        self.grow()

    def best(self, nodes: list[int]) -> Splits:
        return Splits(np.stack([self.cells[n] for n in nodes]), self.bins, self.p["lam"], self.columns, self.p["least_weight"], self.p["least_rows"])

    def divide(self, node: int, s: Splits, k: int, gain: float) -> tuple[int, int]:
        left, right = self.tree.split(node, s.feature[k], s.bin[k], s.missing_left[k], gain)
        self.depth[left] = self.depth[right] = self.depth[node] + 1
        return left, right

    def ask(self, node: int, left: int, right: int) -> None:
        """Of two children the one with fewer rows is counted."""
        cells, at, f = self.cells[node], self.tree.bin[node], self.tree.feature[node]
        rows = cells[f, :at + 1, 2].sum() + (cells[f, -1, 2] if self.tree.missing_left[node] else 0)
        few, many = (left, right) if 2 * rows <= cells[f, :, 2].sum() else (right, left)
        self.open.append(few)
        self.sibling[few] = (node, many)

    def weigh(self, node: int, sums: np.ndarray) -> None:
        self.tree.value[node] = float(-self.p["rate"] * sums[0] / max(sums[1] + self.p["lam"], 1e-300)) if sums[2] else 0.0

    def children(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        cells, f = self.cells[node], self.tree.feature[node]
        left = cells[f, :self.tree.bin[node] + 1].sum(axis=0) + (cells[f, -1] if self.tree.missing_left[node] else 0)
        return left, cells[f].sum(axis=0) - left


class _LevelGrower(_Grower):
    def grow(self) -> None:
        deepest = max(self.depth[n] for n in self.cells)
        level = [n for n in self.cells if self.depth[n] == deepest]
        s = self.best(level)
        for k, node in enumerate(level):
            self.weigh(node, s.total[k])
            gain = s.gain[k] / 2 - self.p["gamma"]
            if not gain > 1e-12:
                continue
            left, right = self.divide(node, s, k, gain)
            for child, sums in zip((left, right), self.children(node)):
                self.weigh(child, sums)
            if self.depth[left] < (self.p["depth"] or np.inf):
                self.ask(node, left, right)


class _LeafGrower(_Grower):
    """Best-first: ``known`` holds each counted leaf's split; a leaf is divided only when its turn has come.

    ``order`` lists the divided nodes.  The children of leaves whose turn may come are counted ahead.
    """

    def __init__(self, *args):
        super().__init__(*args)
        self.known, self.ahead, self.leaves, self.order = {}, {}, 1, []

    def grow(self) -> None:
        fresh = [n for n in self.cells if n not in self.known]
        s = self.best(fresh)
        for k, node in enumerate(fresh):
            self.known[node] = (float(s.gain[k]) / 2 - self.p["gamma"], s, k)
            self.weigh(node, s.total[k])
        deep = self.p["depth"] if self.p["depth"] > 0 else np.inf
        while True:
            # leaves of the tree as it stands: a node counted ahead is not in the tree before its parent is divided
            leaves = [n for n in self.known if self.in_tree(n) and n not in self.order and self.known[n][0] > 1e-12 and self.depth[n] < deep]
            if self.leaves >= self.p["leaves"] or not leaves:
                self.open = []
                self.finish()
                return
            top = sorted(leaves, key=lambda n: (-self.known[n][0], n))
            if top[0] in self.ahead:
                self.order.append(top[0])
                self.leaves += 1
                continue
            # the children of every leaf that could be among the next ones are counted in one pass
            for node in top[:self.p["leaves"] - self.leaves]:
                if node not in self.ahead:
                    gain, s, k = self.known[node]
                    self.ahead[node] = self.divide(node, s, k, gain)
                    self.ask(node, *self.ahead[node])
            return

    def in_tree(self, node: int) -> bool:
        return node == 0 or any(node in self.ahead[p] for p in self.order)

    def finish(self) -> None:
        """Nodes that were counted ahead and not reached are leaves again."""
        for node in self.ahead:
            if node not in self.order:
                self.tree.feature[node], self.tree.gain[node] = -1, 0.0


class _ObliviousGrower(_Grower):
    """All leaves of a level are divided by one (column, bin); missing values are below all others."""

    def grow(self) -> None:
        deepest = max(self.depth[n] for n in self.cells)
        level = sorted(n for n in self.cells if self.depth[n] == deepest)
        cells = np.stack([self.cells[n] for n in level])
        total = cells[:, :1].sum(axis=2)[:, 0]
        for node, sums in zip(level, total):
            self.weigh(node, sums)
        if deepest >= self.p["depth"]:
            return
        left = np.cumsum(cells[:, :, :-1], axis=2) + cells[:, :, -1:]
        right = total[:, None, None] - left
        lam = self.p["lam"]
        gain = (_score(left, lam) + _score(right, lam)).sum(axis=0) - _score(total, lam).sum()
        rows = np.minimum(left[..., 2], right[..., 2])
        can = (np.arange(gain.shape[1])[None, :] < (self.bins - 1)[:, None]) & self.columns[:, None] & (rows.max(axis=0) >= max(self.p["least_rows"], 1))
        gain = np.where(can, gain, -np.inf)
        f, at = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, at] > 1e-12:
            return
        for node in level:
            children = self.tree.split(node, f, at, True, float(gain[f, at]) / len(level))
            for child, sums in zip(children, self.children(node)):
                self.depth[child] = deepest + 1
                self.weigh(child, sums)
            if deepest + 1 < self.p["depth"]:
                self.ask(node, *children)


_GROWERS = {"level": _LevelGrower, "leaf": _LeafGrower, "oblivious": _ObliviousGrower}


# ----------------------------------------------------------------- fitting many models
def fit_together(df: DataFrame, features_col: str, label: str, specs: Sequence[dict], fold: str | None = None,
                 weight: str | None = None) -> list[dict]:
    """Fit several models in common passes.  A spec holds the model's parameters and ``left_out``, the fold it must not see
    (None: it sees all rows).  Returns, per spec: base, trees (arrays over bins), cuts and gains by column."""
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(vector_to_array(features_col).alias("x"), F.col(label).cast("double").alias("y"),
                    F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold") if fold else F.lit(-1).alias("fold")).where("y is not null")
    stats = src.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.max(F.size("x")).alias("d")).collect()  # one row a fold
    if not stats:
        raise ValueError("no rows to fit")
    d = max(r["d"] for r in stats)
    cuts = weighted_cuts(df.where(F.col(label).isNotNull()), features_col, d, max(s["bins"] for s in specs), weight)
    bins = np.array([len(c) + 1 for c in cuts])
    offsets = np.concatenate([[0], np.cumsum(bins + 1)])[:-1]
    width = int((bins + 1).sum())
    models = len(specs)
    left_out = [-2 if s.get("left_out") is None else int(s["left_out"]) for s in specs]
    bases = []
    for s, out in zip(specs, left_out):
        n, total = sum(r["n"] for r in stats if r["fold"] != out), sum(r["s"] for r in stats if r["fold"] != out)
        mean = total / n if n else 0.0
        bases.append(float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))) if s["logistic"] else mean)
    rows = sum(r["n"] for r in stats)
    if rows * (d + ROW_BYTES) <= WHOLE_BYTES:
        blocks = _written(src.mapInArrow(_blocks(cuts, 0), _BLOCK_KIND))
        grown, gains = _fit_whole(blocks, specs, bases, left_out, offsets, bins)
    else:
        grown, gains = [], []
        for at in range(0, models, MODELS):
            blocks = _written(src.mapInArrow(_blocks(cuts, min(MODELS, models - at)), _BLOCK_KIND))
            found = _fit_by_passes(blocks, specs[at:at + MODELS], bases[at:at + MODELS], left_out[at:at + MODELS], offsets, bins)
            grown, gains = grown + found[0], gains + found[1]
    return [dict(base=bases[m], trees=grown[m], cuts=cuts, gains=gains[m], logistic=specs[m]["logistic"]) for m in range(models)]


def _grower(spec: dict, round_: int, bins: np.ndarray) -> _Grower:
    columns = np.ones(len(bins), bool)
    if spec["columns"] < 1:
        some = np.random.default_rng([spec["seed"], round_, 1]).permutation(len(bins))[:max(1, int(round(spec["columns"] * len(bins))))]
        columns = np.isin(np.arange(len(bins)), some)
    return _GROWERS[spec["growth"]](spec, bins, columns)


def _fit_by_passes(blocks: DataFrame, specs: Sequence[dict], bases, left_out, offsets, bins) -> tuple[list, list]:
    """(trees, gains by column) of each model; the open nodes of all models are counted by passes over the rows."""
    d, models, width = len(bins), len(specs), int((bins + 1).sum())
    blocks = blocks.persist()
    tasks = blocks.select(F.spark_partition_id()).distinct().count()
    grown: list[list] = [[] for _ in specs]
    since: list[list] = [[] for _ in specs]
    gains = np.zeros((models, d))
    for round_ in range(max(s["rounds"] for s in specs)):
        growers = {m: _grower(s, round_, bins) for m, s in enumerate(specs) if round_ < s["rounds"]}
        while any(g.open for g in growers.values()):
            open_ = [m for m, g in growers.items() if g.open]
            at_once, turn = max(1, MOST_NUMBERS // (3 * width)), []
            for m in open_:
                turn.append(m)
                if sum(len(growers[k].open) for k in turn) >= at_once or m == open_[-1]:
                    jobs = [_Job(k, bases[k], left_out[k], specs[k]["logistic"], specs[k]["seed"], specs[k]["rows"], round_, since[k],
                                 growers[k].tree.arrays(), list(growers[k].open)) for k in turn]
                    sums = _run(blocks, jobs, offsets, width, models, tasks)
                    at = 0
                    for k, j in zip(turn, jobs):
                        growers[k].take({node: _cells(sums[at + i], offsets, bins) for i, node in enumerate(j.places)})
                        at += len(j.places)
                    turn = []
        for m, g in growers.items():
            since[m].append(g.tree.arrays())
            _add_gains(gains[m], g.tree)
        if (round_ + 1) % WRITE_EVERY == 0:
            last, blocks = blocks, _written(blocks.mapInArrow(_moved(dict(enumerate(since)), d, models), _BLOCK_KIND)).persist()
            last.unpersist()
            grown, since = [g + s for g, s in zip(grown, since)], [[] for _ in specs]
    blocks.unpersist()
    return [g + s for g, s in zip(grown, since)], list(gains)


def _add_gains(gains: np.ndarray, tree: _Tree) -> None:
    for f, gain in zip(tree.feature, tree.gain):
        if f >= 0:
            gains[f] += gain


# ----------------------------------------------------------------- a model in one task
ROW_BYTES = 60  # of a row beside its bins: label, fold, margins, gradients, its place in the lists of nodes


class _Held:
    """A block while one model grows: margins as passes have them, gradients, and the rows of each node."""

    def __init__(self, block: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, spec: dict, base: float, left_out: int):
        self.block, self.x, self.y, self.spec, self.base = block, x, y, spec, base
        self.flat, self.first, self.seen = x.ravel(), np.arange(len(x)) * x.shape[1], np.flatnonzero(fold != left_out)
        self.missing = bool((x == MISSING).any())
        self.margin, self.now = np.zeros(len(y)), np.full(len(y), base)

    def begin(self, round_: int) -> None:
        rows = self.seen
        if self.spec["rows"] < 1:
            rows = rows[_drawn(self.block, round_, self.spec["seed"], len(self.y), self.spec["rows"])[rows]]
        self.g, self.h = _gradients(self.y, self.now, self.spec["logistic"])
        self.rows = {0: rows}

    def divide(self, node: int, tree: _Tree) -> None:
        """The rows of a node to its children."""
        rows = self.rows.pop(node)
        value = self.x[rows, tree.feature[node]]
        low = value <= tree.bin[node]
        if self.missing:
            low = np.where(value == MISSING, tree.missing_left[node], low)
        self.rows[tree.left[node]], self.rows[tree.right[node]] = rows[low], rows[~low]

    def add(self, nodes: list[int], sums: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> None:
        """What a pass adds for this block, with the same order of rows."""
        d, width = len(offsets), sums.shape[1] // len(nodes)
        some = [self.rows[n] for n in nodes]
        rows = np.concatenate(some)
        if not len(rows):
            return
        x = self.x[rows]
        cells = x + offsets[None, :]
        if self.missing:
            cells = np.where(x == MISSING, (offsets + ends)[None, :], cells)
        if len(nodes) > 1:
            cells += np.repeat(np.arange(len(nodes)) * width, [len(r) for r in some])[:, None]
        key = cells.ravel()
        sums[0] += np.bincount(key, np.repeat(self.g[rows], d), sums.shape[1])
        if self.spec["logistic"]:
            sums[1] += np.bincount(key, np.repeat(self.h[rows], d), sums.shape[1])
        sums[2] += np.bincount(key, minlength=sums.shape[1])

    def grown(self, tree: tuple, write: bool) -> None:
        value = tree[5][_Walk(tree)(self.flat, self.first)]
        self.now += value
        self.margin += value
        if write:  # as passes add: the base comes after the margins that are written
            self.now = self.margin + self.base


def _grow_whole(blocks: list[tuple], spec: dict, base: float, left_out: int, offsets: np.ndarray, bins: np.ndarray) -> tuple[list, np.ndarray]:
    """(trees, gains by column) of one model from all blocks (number, bins, labels, folds)."""
    held = [_Held(*b, spec, base, left_out) for b in blocks]
    width = int((bins + 1).sum())
    ends = np.append(offsets[1:], width) - offsets - 1
    # [column, bin] -> place in a node's sums; the last place is always 0
    place = np.full((len(bins), int(bins.max()) + 1), width)
    for f, (begin, n) in enumerate(zip(offsets, bins)):
        place[f, :n], place[f, -1] = np.arange(begin, begin + n), begin + n
    trees, gains = [], np.zeros(len(bins))
    for round_ in range(spec["rounds"]):
        grower, parent = _grower(spec, round_, bins), {}
        for b in held:
            b.begin(round_)
        while grower.open:
            tree, at_once = grower.tree, max(1, MOST_NUMBERS // (3 * width))
            parent.update({c: n for n in range(len(tree.feature)) if tree.feature[n] >= 0 for c in (tree.left[n], tree.right[n])})
            found = {}
            for at in range(0, len(grower.open), at_once):
                nodes = grower.open[at:at + at_once]
                sums = np.zeros((3, len(nodes) * width))
                for b in held:
                    for n in nodes:
                        if n not in b.rows:
                            b.divide(parent[n], tree)
                    b.add(nodes, sums, offsets, ends)
                if not spec["logistic"]:  # the Hessian of a row is 1
                    sums[1] = sums[2]
                each = np.concatenate([sums.reshape(3, len(nodes), width), np.zeros((3, len(nodes), 1))], axis=2)[:, :, place]
                found |= {n: np.ascontiguousarray(np.moveaxis(each[:, i], 0, -1)) for i, n in enumerate(nodes)}
            grower.take(found)
        trees.append(grower.tree.arrays())
        _add_gains(gains, grower.tree)
        for b in held:
            b.grown(trees[-1], (round_ + 1) % WRITE_EVERY == 0)
    return trees, gains


_GROWN = {"feature": np.int32, "bin": np.int32, "missing_left": bool, "left": np.int32, "right": np.int32, "value": float}


def _fit_whole(blocks: DataFrame, specs: Sequence[dict], bases, left_out, offsets, bins) -> tuple[list, list]:
    """(trees, gains by column) of each model, each grown in one task that holds the blocks of all rows."""
    spark, d, models = blocks.sparkSession, len(bins), len(specs)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, rows in _by_model(batches):
            mine = []
            for b in rows:
                for i in range(b.num_rows):
                    mine.append(_read_block(b, i, d, 0)[:4])
            trees, gains = _grow_whole(mine, specs[model], bases[model], left_out[model], offsets, bins)
            for k, t in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([k], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (gains, *t)]],
                                                 names=["model", "tree", "gains", *_GROWN])

    # a partition a model; its blocks in order
    each = blocks.drop("margin").crossJoin(spark.range(models).select(F.col("id").cast("int").alias("model")))
    dealt = each.repartitionByRange(models, "model").sortWithinPartitions("model", "block")
    path = scratch_path(spark, "trees")
    kind = "model int, tree int, " + ", ".join(f"{c} binary" for c in ("gains", *_GROWN))
    dealt.mapInArrow(grow, kind).write.parquet(path)
    trees, gains = [[None] * s["rounds"] for s in specs], [np.zeros(d) for _ in specs]
    for r in spark.read.schema(kind).parquet(path).toLocalIterator():  # the models' trees
        trees[r["model"]][r["tree"]] = tuple(np.frombuffer(r[c], t) for c, t in _GROWN.items())
        gains[r["model"]] = np.frombuffer(r["gains"])
    return trees, gains


def _by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows sorted by model -> (model, its batches), one model after the other."""
    model, held = None, []
    for b in batches:
        numbers = b.column("model").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for begin, end in zip(edges[:-1], edges[1:]):
            if begin == end:
                continue
            if numbers[begin] != model and held:
                yield model, held
                held = []
            model = int(numbers[begin])
            held.append(b.slice(begin, end - begin))
    if held:
        yield model, held


def _written(blocks: DataFrame) -> DataFrame:
    path = scratch_path(blocks.sparkSession, "blocks")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(_BLOCK_KIND).parquet(path)


def _run(blocks: DataFrame, jobs: list[_Job], offsets, width: int, models: int, tasks: int) -> np.ndarray:
    kind = "part int, sums binary"
    found = blocks.mapInArrow(_histograms(jobs, offsets, width, models), kind)
    if tasks > DIRECT_TASKS:
        found = found.groupBy("part").applyInArrow(_total, kind)
    nodes = sum(len(j.places) for j in jobs)
    return sum((np.frombuffer(r["sums"]) for r in found.collect()), np.zeros(nodes * width * 3)).reshape(nodes, width, 3)  # a few sums


def _cells(sums: np.ndarray, offsets: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """[column, bin, 3] with room for the widest column; the missing bin is last."""
    out = np.zeros((len(bins), int(bins.max()) + 1, 3))
    for f, (begin, n) in enumerate(zip(offsets, bins)):
        out[f, :n] = sums[begin:begin + n]
        out[f, -1] = sums[begin + n]
    return out


# ----------------------------------------------------------------- estimators
def _param(name: str, doc: str, kind=TypeConverters.toFloat) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Columns(Params):
    featuresCol = _param("featuresCol", "vector of columns; NaN is a missing value", TypeConverters.toString)
    labelCol = _param("labelCol", "label", TypeConverters.toString)
    predictionCol = _param("predictionCol", "prediction", TypeConverters.toString)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)


class _Booster(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Parameters that all three have."""

    n_estimators = _param("n_estimators", "rounds", TypeConverters.toInt)
    learning_rate = _param("learning_rate", "factor of every leaf")
    max_depth = _param("max_depth", "depth of a tree at most (0: no bound)", TypeConverters.toInt)
    num_leaves = _param("num_leaves", "leaves of a tree at most", TypeConverters.toInt)
    reg_lambda = _param("reg_lambda", "weight of squared leaf values")
    gamma = _param("gamma", "least gain of a split")
    min_child_weight = _param("min_child_weight", "least sum of Hessians of a child")
    min_child_samples = _param("min_child_samples", "least rows of a child", TypeConverters.toInt)
    subsample = _param("subsample", "share of the rows that a round uses")
    colsample_bytree = _param("colsample_bytree", "share of the columns that a tree uses")
    max_bin = _param("max_bin", "bins of a column at most (255)", TypeConverters.toInt)
    classification = _param("classification", "two classes, by log loss", TypeConverters.toBoolean)
    seed = _param("seed", "seed of rows and columns", TypeConverters.toInt)

    growth = ""
    own: dict = {}

    def __init__(self, **params):
        super().__init__()
        common = dict(featuresCol="features", labelCol="label", predictionCol="prediction", classification=False, seed=0, max_bin=255,
                      gamma=0.0, subsample=1.0, colsample_bytree=1.0, min_child_weight=0.0, min_child_samples=1, num_leaves=31)
        self._setDefault(**(common | self.own))
        self._set(**{k: v for k, v in params.items() if v is not None})

    def spec(self, left_out: int | None = None) -> dict:
        g = self.getOrDefault
        return dict(rounds=g("n_estimators"), rate=g("learning_rate"), depth=g("max_depth"), leaves=g("num_leaves"), lam=g("reg_lambda"),
                    gamma=g("gamma"), least_weight=g("min_child_weight"), least_rows=g("min_child_samples"), rows=g("subsample"),
                    columns=g("colsample_bytree"), bins=min(g("max_bin"), 255), logistic=g("classification"), seed=g("seed"),
                    growth=self.growth, left_out=left_out)

    def model(self, fitted: dict) -> BoosterModel:
        out = BoosterModel()
        for c in ("featuresCol", "predictionCol"):
            out._set(**{c: self.getOrDefault(c)})
        trees = []
        for feature, last, missing_left, left, right, value in fitted["trees"]:
            threshold = [float(fitted["cuts"][f][b]) if f >= 0 else 0.0 for f, b in zip(feature, last)]
            trees.append(dict(feature=feature.tolist(), threshold=threshold, missing_left=missing_left.tolist(), left=left.tolist(),
                              right=right.tolist(), value=value.tolist()))
        out._set_state(dict(base=fitted["base"], trees=trees, gains=fitted["gains"].tolist(), classification=fitted["logistic"]))
        return out

    def _fit(self, dataset):
        return self.model(fit_together(dataset, self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"), [self.spec()])[0])


class SecondOrderBooster(_Booster):
    """M09/M10 (``xgb``): all nodes of a level are split, by regularised second-order gain."""

    growth = "level"
    own = dict(n_estimators=100, learning_rate=0.3, max_depth=6, reg_lambda=1.0, min_child_weight=1.0)


class LeafWiseBooster(_Booster):
    """M09/M10 (``lgbm``): the leaf of the largest gain is split next, up to ``num_leaves``."""

    growth = "leaf"
    own = dict(n_estimators=100, learning_rate=0.1, max_depth=0, reg_lambda=0.0, min_child_weight=1e-3, min_child_samples=20)


class ObliviousBooster(_Booster):
    """M09/M10 (``catboost``): symmetric trees, one split a level."""

    growth = "oblivious"
    own = dict(n_estimators=100, learning_rate=0.1, max_depth=6, reg_lambda=3.0)


class BoosterModel(Model, _Columns, HasState, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction; for two classes also ``probability``.  The state holds every tree, so a saved model is whole."""

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")

    @property
    def classification(self) -> bool:
        return self._state()["classification"]

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.array(self._state()["gains"])
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def boosted_trees(self) -> Trees:
        state = self._state()
        out = Trees(base=state["base"], link=1.0)
        for t in state["trees"]:
            begin = len(out.feature)
            out.roots.append(begin)
            out.weights.append(1.0)
            out.feature += t["feature"]
            out.threshold += t["threshold"]
            out.missing_left += t["missing_left"]
            out.left += [begin + k for k in t["left"]]
            out.right += [begin + k for k in t["right"]]
            out.value += t["value"]
        return out.frozen()

    def _transform(self, dataset):
        ship_package(dataset.sparkSession)
        trees = self.boosted_trees()

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.stack([np.asarray(v, float) for v in x])
            return pd.Series(staged_sums(trees, rows, [len(trees.roots)])[:, 0])

        prediction = self.getOrDefault("predictionCol")
        if not self.classification:
            return dataset.withColumn(prediction, margin(vector_to_array(self.getOrDefault("featuresCol"))))
        out = dataset.withColumn("__margin", margin(vector_to_array(self.getOrDefault("featuresCol"))))
        chance = 1 / (1 + F.exp(-F.col("__margin")))
        return out.withColumn("probability", array_to_vector(F.array(1 - chance, chance))).withColumn(
            prediction, (F.col("__margin") > 0).cast("double")).drop("__margin")


def fit_folds(estimators: Sequence[_Booster], df: DataFrame, folds: Sequence[int], fold: str, full: bool = False) -> list[dict[int | None, BoosterModel]]:
    """For each estimator, the model of each fold left out (and of all rows, under None); all in common passes."""
    asked = [(e, f) for e in estimators for f in [*folds, *([None] if full else [])]]
    e = estimators[0]
    fitted = fit_together(df.where(F.col(fold).isNotNull()), e.getOrDefault("featuresCol"), e.getOrDefault("labelCol"), [x.spec(f) for x, f in asked], fold)
    out: list[dict] = [{} for _ in estimators]
    for (x, f), found in zip(asked, fitted):
        out[estimators.index(x)][f] = x.model(found)
    return out


# ----------------------------------------------------------------- categories for the ordered booster
def ordered_target_statistics(df: DataFrame, cols: Sequence[str], target: str, key: Sequence[str], prior: float | None = None,
                              strength: float = 1.0, seed: int = 0, suffix: str = "_ts") -> DataFrame:
    """For each column c, ``c_ts``: the mean target of the rows of the same level that come before in a permutation by hash.

    ``(sum before + strength * prior) / (rows before + strength)``; prior: the mean target unless given.  A row's own
    target is never in its statistic.  Prefix sums come from one distributed sort by
    (level, hash), so a level with a third of all rows is spread over tasks.  A missing level is a level; rows without a
    target count for nobody and still get their statistic.  ``key`` identifies a row.
    """
    if prior is None:
        prior = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0  # one number
    out = df
    for c in cols:
        y = F.col(target).cast("double")
        rows = out.select("*", F.coalesce(y, F.lit(0.0)).alias("__y"), y.isNotNull().cast("long").alias("__one"),
                          F.col(c).isNull().alias("__none"), F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])).alias("__h"))
        placed = running_sums(rows, ["__none", c, "__h", *key], ["__y", "__one"], name="__place")
        first = placed.groupBy("__none", F.col(c).alias("__level")).agg(F.min_by(F.struct("__y_before", "__one_before"), "__place").alias("__start"))
        first = first.withColumnRenamed("__none", "__nolevel")
        same = (F.col("__none") == F.col("__nolevel")) & F.col(c).eqNullSafe(F.col("__level"))
        stat = (F.col("__y_before") - F.col("__start.__y_before") + strength * prior) / (F.col("__one_before") - F.col("__start.__one_before") + strength)
        out = placed.join(first, same).select(*out.columns, stat.alias(f"{c}{suffix}"))
    return out


def level_statistics(df: DataFrame, col: str, target: str, prior: float, strength: float = 1.0, suffix: str = "_ts") -> DataFrame:
    """(col, col_ts): the statistic over all rows of a level, for rows to score."""
    y = F.col(target).cast("double")
    return df.groupBy(col).agg(((F.coalesce(F.sum(y), F.lit(0.0)) + strength * prior) / (F.count(y) + strength)).alias(f"{col}{suffix}"))


class OrderedTargetEncoder:
    """Categories as numbers: ordered statistics for the rows of a fit, the level's statistic (or the prior) for others."""

    def __init__(self, cols: Sequence[str], target: str, key: Sequence[str], strength: float = 1.0, seed: int = 0):
        self.cols, self.target, self.key, self.strength, self.seed = list(cols), target, list(key), strength, seed
        self.prior, self.tables = None, {}

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.prior = float(df.agg(F.avg(F.col(self.target).cast("double"))).first()[0] or 0.0)
        for c in self.cols:
            path = scratch_path(df.sparkSession, "levels")
            level_statistics(df, c, self.target, self.prior, self.strength).write.parquet(path)
            self.tables[c] = path
        return ordered_target_statistics(df, self.cols, self.target, self.key, self.prior, self.strength, self.seed)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            table = df.sparkSession.read.parquet(self.tables[c]).select(F.col(c).alias("__level"), f"{c}_ts")
            out = out.join(table, F.col(c).eqNullSafe(F.col("__level")), "left").drop("__level")
            out = out.withColumn(f"{c}_ts", F.coalesce(f"{c}_ts", F.lit(self.prior)))
        return out


__all__ = ["SecondOrderBooster", "LeafWiseBooster", "ObliviousBooster", "BoosterModel", "fit_together", "fit_folds", "weighted_cuts",
           "Splits", "ordered_target_statistics", "level_statistics", "OrderedTargetEncoder"]
