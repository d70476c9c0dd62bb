"""Trees and forests without a depth bound (M06, M07): grown until leaves are pure.

1. *Top.*  While a node holds more than ``finish_rows`` rows it is divided by histograms: a pass over
   the rows adds up, for all such nodes of all trees, the sums of each bin of each column
   (``learn/boosters.py`` has the bins and the split search).  With many nodes a node's sums meet in
   a task that finds its split, so the driver sees eight numbers a node.  A node that the common bins cannot divide
   gets bins of its own rows.
2. *Finish.*  Rows of the other nodes are grouped by (tree, node), at most ``finish_rows`` rows a group, and
   each group's subtree is grown to the end on the values themselves.

A forest draws each row for each tree Poisson(1) times, by a hash of the row's number, so a task that
runs again draws the same; ``max_features`` columns are drawn for each node.

The top trees have about ``rows / finish_rows`` nodes and are kept as numbers.  The subtrees are a table
in the shared folder (a saved model holds it): with up to ``SMALL_NODES`` nodes they travel to the
tasks that predict, beyond that rows and subtrees are joined by (tree, node).

Classification is of labels 0 and 1: dividing by squared error is then dividing by the Gini index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.learn.boosters import Splits, _bins_of, _cells, weighted_cuts
from tabulon.learn.staged import Trees
from tabulon.operators._mlbase import WithParts
from tabulon.session import scratch_path, ship_package

FINISH_ROWS = 20_000
SMALL_NODES = 1 << 20
MOST_NUMBERS = 6 << 20
DRIVER_SUMS = 64  # histograms of tasks that one pass brings to the driver; of more, the splits are found in tasks
BATCH_NUMBERS = 1 << 16  # numbers of the nodes that are divided together
# chances of 0, 1, 2, ... draws, added up
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def draws(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a tree uses each row."""
    if not bootstrap:
        return np.ones(len(ids))
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    h = h ^ (h >> np.uint64(31))
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(float) / (1 << 53), side="right").astype(float)


def _columns(d: int, most: int, *key: int) -> np.ndarray:
    """The columns in the order in which a node tries them; the first ``most`` are its own."""
    return np.random.Generator(np.random.PCG64(list(key))).permutation(d) if most < d else np.arange(d)


def grow_exact(x: np.ndarray, y: np.ndarray, w: np.ndarray, most: int, key: tuple, min_split: int = 2, min_leaf: int = 1):
    """(feature, threshold, left, right, value, gain by column) of a tree grown to the end on some rows."""
    if most >= x.shape[1]:
        return _grow_by_size(x, y, w, min_split, min_leaf)
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
    gains = np.zeros(x.shape[1])
    todo = [(0, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        yy, ww = y[rows], w[rows]
        total, weight = (ww * yy).sum(), ww.sum()
        value[node] = float(total / weight)
        if len(rows) < min_split or yy.min() == yy.max():
            continue
        order = _columns(x.shape[1], most, *key, node)
        best = None
        for at in range(0, len(order), most):  # more columns only if the node's own divide nothing
            cols = np.sort(order[at:at + most])
            part = x[np.ix_(rows, cols)]
            by = np.argsort(part, axis=0, kind="stable")
            xs = np.take_along_axis(part, by, axis=0)
            wl, sl = np.cumsum(ww[by], axis=0)[:-1], np.cumsum((ww * yy)[by], axis=0)[:-1]
            gain = sl ** 2 / wl + (total - sl) ** 2 / (weight - wl) - total ** 2 / weight
            size = np.arange(1, len(rows))[:, None]
            gain[(xs[1:] <= xs[:-1]) | (size < min_leaf) | (len(rows) - size < min_leaf)] = -np.inf
            k, c = np.unravel_index(int(gain.argmax()), gain.shape)
            if np.isfinite(gain[k, c]):
                best = (float(gain[k, c]), int(cols[c]), float(xs[k, c]), float(xs[k + 1, c]))
                break
        if best is None:
            continue
        gain, f, low, high = best
        middle = (low + high) / 2
        threshold[node], feature[node] = (middle if middle < high else low), f
        gains[f] += max(gain, 0.0)
        go = x[rows, f] <= threshold[node]
        left[node], right[node] = len(feature), len(feature) + 1
        for _ in range(2):
            for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                column.append(empty)
        todo += [(left[node], rows[go]), (right[node], rows[~go])]
    return feature, threshold, left, right, value, gains


def _grow_by_size(x: np.ndarray, y: np.ndarray, w: np.ndarray, min_split: int, min_leaf: int):
    """``grow_exact`` where every node tries all columns: nodes of one number of rows are divided together, the largest first."""
    n, d = x.shape
    # a value's place among its column's values: rows are sorted by it and by their place in the node, as one number
    rank = np.stack([np.unique(x[:, c], return_inverse=True)[1].reshape(-1) for c in range(d)]).astype(np.int64)
    wy = w * y
    feature, left, right = (np.full(2 * n, k, np.int32) for k in (-1, 0, 0))
    threshold, value, gains, nodes = np.zeros(2 * n), np.zeros(2 * n), np.zeros(d), 1
    held = np.arange(n)  # the rows of a node lie together
    todo = {n: [(np.zeros(1, np.int64), np.zeros(1, np.int64))]}  # rows -> nodes and where their rows begin
    for size in range(n, 0, -1):
        if size not in todo:
            continue
        waiting = [np.concatenate(v) for v in zip(*todo.pop(size))]
        at_once = max(1, BATCH_NUMBERS // (size * d))
        for first in range(0, len(waiting[0]), at_once):
            node, begin = (v[first:first + at_once] for v in waiting)
            rows = held[begin[:, None] + np.arange(size)]
            total, weight = wy[rows].sum(axis=1), w[rows].sum(axis=1)
            value[node] = total / weight
            mixed = np.flatnonzero(y[rows].min(axis=1) != y[rows].max(axis=1)) if size >= max(min_split, 2) else np.zeros(0, np.int64)
            if not len(mixed):
                continue
            node, begin, rows, total, weight = node[mixed], begin[mixed], rows[mixed], total[mixed], weight[mixed]
            bits = size.bit_length()
            key = np.sort((rank[:, rows] << bits) | np.arange(size), axis=-1)  # column, node, row
            by = rows[np.arange(len(rows))[:, None], key & ((1 << bits) - 1)]
            wl, sl = np.cumsum(w[by], axis=-1)[..., :-1], np.cumsum(wy[by], axis=-1)[..., :-1]
            t, full = total[:, None], weight[:, None]
            gain = sl ** 2 / wl + (t - sl) ** 2 / (full - wl) - t ** 2 / full
            key >>= bits
            gain[key[..., 1:] == key[..., :-1]] = -np.inf
            if min_leaf > 1:
                taken = np.arange(1, size)
                gain[..., (taken < min_leaf) | (size - taken < min_leaf)] = -np.inf
            gain = gain.transpose(1, 2, 0).reshape(len(rows), -1)
            best = gain.argmax(axis=1)
            most = gain[np.arange(len(rows)), best]
            good = np.flatnonzero(np.isfinite(most))
            if not len(good):
                continue
            k, f = np.divmod(best[good], d)
            low, high = x[by[f, good, k], f], x[by[f, good, k + 1], f]
            middle = (low + high) / 2
            node, begin, rows = node[good], begin[good], rows[good]
            cut = np.where(middle < high, middle, low)
            feature[node], threshold[node] = f, cut
            gains += np.bincount(f, np.maximum(most[good], 0.0), d)
            go = x[rows, f[:, None]] <= cut[:, None]
            held[begin[:, None] + np.arange(size)] = np.take_along_axis(rows, np.argsort(~go, axis=1, kind="stable"), axis=1)
            left[node] = nodes + 2 * np.arange(len(node))
            right[node] = left[node] + 1
            nodes += 2 * len(node)
            many = go.sum(axis=1)
            child, start = np.concatenate([left[node], right[node]]), np.concatenate([begin, begin + many])
            many = np.concatenate([many, size - many])
            order = np.argsort(many, kind="stable")
            edges = np.flatnonzero(np.diff(many[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                todo.setdefault(int(many[order[a]]), []).append((child[order[a:b]], start[order[a:b]]))
    return (*(v[:nodes].tolist() for v in (feature, threshold, left, right, value)), gains)


class _Top:
    """The top of one tree; ``open`` nodes need a histogram, ``finish`` nodes a subtree."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [-1], [0.0], [0], [0], [0.0]
        self.open, self.finish, self.cuts = [], [], {}

    def arrays(self):
        return np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int32), np.array(self.right, np.int32)

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]


def _nodes(top: tuple, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right = top
    at = np.zeros(len(x), np.int32)
    rows = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, int)
    while len(rows):
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        rows = rows[feature[at[rows]] >= 0]
    return at


def _batch(b: pa.RecordBatch):
    x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
    return b.column("id").to_numpy(), x, b.column("y").to_numpy(zero_copy_only=False).astype(float)


class FullForest(Estimator):
    """A tree (``n_estimators`` 1 and no ``bootstrap``) or a forest; ``max_features`` is a number of columns (0: all)."""

    def __init__(self, n_estimators: int = 1, bootstrap: bool = False, max_features: int = 0, min_samples_split: int = 2, min_samples_leaf: int = 1,
                 classification: bool = False, seed: int = 0, featuresCol: str = "features", labelCol: str = "label", finish_rows: int = FINISH_ROWS):
        super().__init__()
        self.trees, self.bootstrap, self.max_features, self.classification, self.seed = n_estimators, bootstrap, max_features, classification, seed
        self.min_split, self.min_leaf = min_samples_split, min_samples_leaf
        self.featuresCol, self.labelCol, self.finish_rows = featuresCol, labelCol, finish_rows

    def _fit(self, dataset):
        spark = dataset.sparkSession
        ship_package(spark)
        path = scratch_path(spark, "tree-rows")
        # numbered in a written table, so that every pass draws the same rows
        dataset.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y")).where("y is not null").withColumn(
            "id", F.monotonically_increasing_id()).select("id", "x", "y").write.parquet(path)
        rows = spark.read.parquet(path)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        if not size["n"]:
            raise ValueError("no rows to fit")
        d = size["d"]
        most = min(self.max_features or d, d)
        tops = [_Top() for _ in range(self.trees)]
        gains = np.zeros(d)
        if size["n"] <= self.finish_rows:
            for t in tops:
                t.finish = [0]
        else:
            gains += self._grow_tops(rows, tops, d, most)
        table = self._finish(rows, tops, d, most)
        gains += np.array(table.agg(*[F.coalesce(F.sum(F.col("gains")[i]), F.lit(0.0)).alias(f"g{i}") for i in range(d)]).first())  # d numbers
        state = [dict(feature=t.feature, threshold=t.threshold, left=t.left, right=t.right, value=t.value) for t in tops]
        return FullForestModel(state, gains.tolist(), self.classification, self.featuresCol, table)

    def _grow_tops(self, rows: DataFrame, tops: list[_Top], d: int, most: int) -> np.ndarray:
        root = weighted_cuts(rows.withColumn("features", array_to_vector("x")), "features", d, 255)
        gains = np.zeros(d)
        for t in tops:
            t.open = [0]
        tasks = rows.select(F.spark_partition_id()).distinct().count()
        while any(t.open for t in tops):
            # (tree, node, its bins): nodes of common bins, or one node with its own
            asked = [(i, n) for i, t in enumerate(tops) for n in t.open]
            own = [(i, n) for i, n in asked if n in tops[i].cuts]
            turns = [(root, [a for a in asked if a not in own])] + [(tops[i].cuts[n], [(i, n)]) for i, n in own]
            for t in tops:
                t.open = []
            for cuts, nodes in turns:
                bins = np.array([len(c) + 1 for c in cuts])
                width = int((bins + 1).sum())
                at_once = max(1, MOST_NUMBERS // (4 * width))
                for begin in range(0, len(nodes), at_once):
                    some = nodes[begin:begin + at_once]
                    for (i, n), found in zip(some, self._splits(rows, tops, some, cuts, bins, width, tasks, most)):
                        self._divide(rows, tops[i], n, found, cuts, d, gains)
        return gains

    def _splits(self, rows, tops, nodes, cuts, bins, width, tasks, most):
        """What ``best`` returns for each node, from one pass over the rows."""
        offsets = np.concatenate([[0], np.cumsum(bins + 1)])[:-1]
        arrays = {i: tops[i].arrays() for i in {i for i, _ in nodes}}
        places: dict[int, dict[int, int]] = {}
        for k, (i, n) in enumerate(nodes):
            places.setdefault(i, {})[n] = k
        seed, bootstrap, finish_rows, min_leaf, d = self.seed, self.bootstrap, self.finish_rows, self.min_leaf, len(bins)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, squares = np.zeros((len(nodes) * width, 3)), np.zeros(len(nodes))
            for b in batches:
                ids, x, y = _batch(b)
                if not len(ids):
                    continue
                binned = _bins_of(x, cuts)
                cells = offsets[None, :] + np.where(binned == 255, bins[None, :], binned)
                for i, top in arrays.items():
                    w = draws(ids, i, seed, bootstrap)
                    where = np.full(len(top[0]), -1)
                    where[list(places[i])] = list(places[i].values())
                    place = where[_nodes(top, x)]
                    use = np.flatnonzero((place >= 0) & (w > 0))
                    key = (place[use, None] * width + cells[use]).ravel()
                    for k, v in enumerate((-w[use] * y[use], w[use], np.ones(len(use)))):
                        sums[:, k] += np.bincount(key, np.repeat(v, x.shape[1]), len(sums))
                    squares += np.bincount(place[use], w[use] * y[use] ** 2, len(nodes))
            sums = sums.reshape(len(nodes), -1)
            seen, part = np.flatnonzero(sums[:, 2::3].any(axis=1)), TaskContext.get().partitionId()
            for at in range(0, len(seen), 64):
                some = seen[at:at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), part, np.int32)),
                                                  pa.array([np.append(sums[k], squares[k]).tobytes() for k in some.tolist()], pa.binary())], names=["k", "part", "sums"])

        def best(k: int, found: list) -> tuple:
            """(k, G, H, rows, squares, gain, column, bin); the column is -1 where no bin divides the node or it is to be finished."""
            total = sum((np.frombuffer(v) for _, v in sorted(found)), np.zeros(3 * width + 1))  # in the order of the tasks
            cells, squares = _cells(total[:-1].reshape(width, 3), offsets, bins), float(total[-1])
            g, h, count = (float(v) for v in cells[0].sum(axis=0))
            if count > finish_rows and squares - g * g / h > 1e-12 * max(squares, 1e-300):  # not pure
                order = _columns(d, most, seed, *nodes[k])
                for at in range(0, d, most):
                    s = Splits(cells[None], bins, 0.0, np.isin(np.arange(d), order[at:at + most]), 0.0, min_leaf)
                    if np.isfinite(s.gain[0]):
                        return k, g, h, count, squares, float(s.gain[0]), int(s.feature[0]), int(s.bin[0])
            return k, g, h, count, squares, 0.0, -1, 0

        def split(table: pa.Table) -> pa.Table:
            out = best(table["k"][0].as_py(), list(zip(table["part"].to_pylist(), table["sums"].to_pylist())))
            return pa.table([pa.array([v], pa.float64()) for v in out], _SPLIT)

        found = rows.mapInArrow(add, "k int, part int, sums binary")
        if len(nodes) * tasks > DRIVER_SUMS:
            kind = ", ".join(f"{c} double" for c in _SPLIT)
            some = {int(r["k"]): tuple(r) for r in found.groupBy("k").applyInArrow(split, kind).collect()}  # eight numbers a node
        else:
            by: dict[int, list] = {}
            for r in found.collect():  # a few sums
                by.setdefault(r["k"], []).append((r["part"], bytes(r["sums"])))
            some = {k: best(k, v) for k, v in by.items()}
        return [some.get(k, (k, 0.0, 0.0, 0.0, 0.0, 0.0, -1, 0)) for k in range(len(nodes))]

    def _divide(self, rows, top: _Top, node: int, found: tuple, cuts, d: int, gains) -> None:
        _, g, h, count, squares, gain, f, k = found
        top.value[node] = -g / h if h else 0.0
        if count <= self.finish_rows:
            top.finish.append(node)
            return
        if squares - g * g / h <= 1e-12 * max(squares, 1e-300):
            return  # pure
        if f >= 0:
            gains[int(f)] += max(gain, 0.0)
            top.open += top.split(node, int(f), float(cuts[int(f)][int(k)]))
            return
        if node in top.cuts:
            return  # bins of its own rows divide nothing: the rows are equal
        arrays, target = top.arrays(), node

        def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x, _ = _batch(b)
                yield b.filter(pa.array(_nodes(arrays, x) == target))

        kept = rows.select("id", "x", "y").mapInArrow(mine, "id long, x array<double>, y double")
        top.cuts[node] = weighted_cuts(kept.withColumn("features", array_to_vector("x")), "features", d, 255)
        top.open.append(node)

    def _finish(self, rows: DataFrame, tops: list[_Top], d: int, most: int) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, gains): a subtree for each node to finish, as a written table."""
        arrays, wanted = [t.arrays() for t in tops], [np.isin(np.arange(len(t.feature)), t.finish) for t in tops]
        seed, bootstrap, min_split, min_leaf = self.seed, self.bootstrap, self.min_split, self.min_leaf

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x, y = _batch(b)
                for i, top in enumerate(arrays):
                    w, node = draws(ids, i, seed, bootstrap), _nodes(top, x)
                    use = np.flatnonzero((w > 0) & wanted[i][node])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(use), i, np.int32)), pa.array(node[use]), b.column("id").take(pa.array(use)), b.column("x").take(pa.array(use)),
                         pa.array(y[use]), pa.array(w[use])], names=["tree", "node", "id", "x", "y", "w"])

        def finish(table: pa.Table) -> pa.Table:
            order = np.argsort(table["id"].to_numpy())  # the same tree in whatever order rows come
            x = np.asarray(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1)[order]
            y, w = table["y"].to_numpy()[order], table["w"].to_numpy()[order]
            tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
            *grown, gain = grow_exact(x, y, w, most, (seed, tree, node, 1), min_split, min_leaf)
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                             **{n: pa.array([v], pa.list_(k)) for n, v, k in zip(_GROWN, grown, kinds)}, "gains": pa.array([gain.tolist()], pa.list_(pa.float64()))})

        dealt = rows.select("id", "x", "y").mapInArrow(deal, "tree int, node int, id long, x array<double>, y double, w double")
        path = scratch_path(rows.sparkSession, "subtrees")
        dealt.groupBy("tree", "node").applyInArrow(finish, _SUBTREE).write.parquet(path)
        return rows.sparkSession.read.schema(_SUBTREE).parquet(path)


_SPLIT = ["k", "G", "H", "rows", "squares", "gain", "column", "bin"]
_GROWN = ["feature", "threshold", "left", "right", "value"]
_SUBTREE = "tree int, node int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gains array<double>"


class FullForestModel(WithParts, Model):
    """Adds the mean of the trees' leaf values; for two classes ``probability`` and the more likely class."""

    def __init__(self, tops, gains, classification, featuresCol, table: DataFrame):
        super().__init__()
        self.tops, self.gains, self.classification, self.featuresCol, self.table, self.predictionCol = tops, gains, classification, featuresCol, table, "prediction"

    def _parts(self):
        return dict(tops=self.tops, gains=self.gains, classification=self.classification, featuresCol=self.featuresCol), {"subtrees": self.table}, {}

    @classmethod
    def _from_parts(cls, values, tables, children):
        return cls(**values, table=SparkSession.getActiveSession().read.schema(_SUBTREE).parquet(tables["subtrees"]))

    def setPredictionCol(self, value):
        self.predictionCol = value
        return self

    @property
    def featureImportances(self) -> DenseVector:
        gains = np.array(self.gains)
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def _whole(self) -> Trees:
        """All trees as arrays, subtrees hung below the tops."""
        out, place = Trees(), []
        for top in self.tops:
            place.append(len(out.feature))
            out.roots.append(place[-1])
            self._hang(out, top, place[-1])
        for r in self.table.drop("gains").toLocalIterator():  # SMALL_NODES nodes at most
            begin, at = len(out.feature), place[r["tree"]] + r["node"]
            self._hang(out, r.asDict(), begin)
            # the subtree's root takes the place of the top's leaf
            for column in (out.feature, out.threshold, out.left, out.right, out.value):
                column[at] = column[begin]
        out.weights = [1.0 / len(self.tops)] * len(self.tops)
        return out.frozen()

    @staticmethod
    def _hang(out: Trees, nodes: dict, begin: int) -> None:
        out.feature += nodes["feature"]
        out.threshold += nodes["threshold"]
        out.value += nodes["value"]
        out.left += [begin + k for k in nodes["left"]]
        out.right += [begin + k for k in nodes["right"]]
        out.missing_left += [False] * len(nodes["feature"])

    def _transform(self, dataset):
        ship_package(dataset.sparkSession)
        nodes = self.table.agg(F.coalesce(F.sum(F.size("feature")), F.lit(0))).first()[0]
        scored = self._by_udf(dataset) if nodes <= SMALL_NODES else self._by_join(dataset)
        if not self.classification:
            return scored.withColumnRenamed("__mean", self.predictionCol)
        chance = array_to_vector(F.array(1 - F.col("__mean"), F.col("__mean")))
        return scored.withColumn("probability", chance).withColumn(self.predictionCol, (F.col("__mean") > 0.5).cast("double")).drop("__mean")

    def _by_udf(self, dataset: DataFrame) -> DataFrame:
        trees = self._whole()

        @F.pandas_udf("double")
        def mean(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            rows = np.stack([np.asarray(v, float) for v in x])
            return pd.Series(sum(trees.values(k, rows) for k in range(len(trees.roots))) / len(trees.roots))

        return dataset.withColumn("__mean", mean(vector_to_array(self.featuresCol)))

    def _by_join(self, dataset: DataFrame) -> DataFrame:
        """Rows meet their subtrees by (tree, node), in parts of a bounded number of rows."""
        spark, tops = dataset.sparkSession, [(np.array(t["feature"], np.int32), np.array(t["threshold"]), np.array(t["left"], np.int32), np.array(t["right"], np.int32)) for t in self.tops]
        values = [np.array(t["value"]) for t in self.tops]
        path = scratch_path(spark, "to-score")
        numbered = dataset.withColumn("__row", F.monotonically_increasing_id())
        numbered.write.parquet(path)
        numbered = spark.read.schema(numbered.schema).parquet(path)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [np.zeros(len(v), np.int64) for v in values]
            for b in batches:
                ids, x, _ = _batch(b)
                for i, top in enumerate(tops if len(ids) else []):
                    rows[i] += np.bincount(_nodes(top, x), minlength=len(rows[i]))
            for i, n in enumerate(rows):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["tree", "node", "n"])

        src = numbered.select(F.col("__row").alias("id"), vector_to_array(self.featuresCol).alias("x"), F.lit(0.0).alias("y"))
        counted = src.mapInArrow(count, "tree int, node int, n long").groupBy("tree", "node").agg(F.ceil(F.sum("n") / FINISH_ROWS).cast("int").alias("parts"))
        path = scratch_path(spark, "parts")
        counted.write.parquet(path)
        counted = spark.read.schema("tree int, node int, parts int").parquet(path)
        parts = [np.ones(len(v), np.int64) for v in values]
        for r in counted.where("parts > 1").toLocalIterator():  # leaves of the tops, which are here already
            parts[r["tree"]][r["node"]] = r["parts"]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x, _ = _batch(b)
                for i, top in enumerate(tops if len(ids) else []):
                    node = _nodes(top, x)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(ids), i, np.int32)), pa.array(node), b.column("x"), pa.array(values[i][node]),
                                                      pa.array((ids % parts[i][node]).astype(np.int32))], names=["id", "tree", "node", "x", "top", "part"])

        dealt = src.mapInArrow(place, "id long, tree int, node int, x array<double>, top double, part int")
        subtrees = self.table.join(counted, ["tree", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def walk(rows: pa.Table, subtree: pa.Table) -> pa.Table:
            value = rows["top"].to_numpy()
            if rows.num_rows and subtree.num_rows:
                one = Trees()
                FullForestModel._hang(one, {n: subtree[n][0].as_py() for n in _GROWN}, 0)
                one.roots = [0]
                x = np.asarray(rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(rows.num_rows, -1)
                value = one.frozen().values(0, x)
            return pa.table({"id": rows["id"], "value": pa.array(value, pa.float64())})

        found = dealt.groupBy("tree", "node", "part").cogroup(subtrees.groupBy("tree", "node", "part")).applyInArrow(walk, "id long, value double")
        mean = found.groupBy(F.col("id").alias("__id")).agg(F.avg("value").alias("__mean"))
        return numbered.join(mean, F.col("__row") == F.col("__id"), "left").drop("__row", "__id")


__all__ = ["FullForest", "FullForestModel", "grow_exact", "draws"]
