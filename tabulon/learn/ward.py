"""Ward's hierarchical clustering of any number of rows (K04), by summaries.

The exact tree needs the distance of all pairs.  Here a row first joins a summary
(rows, sum, mean square: a clustering feature), and the tree is built over the summaries:

1. a task holds at most ``most`` summaries.  A batch of rows joins the nearest ones, within a
   radius; where there are too many, the radius grows and summaries that lie within it
   are merged.  The tasks' summaries are merged in the same way, in groups, and then on the driver;
2. the summaries are merged by Ward's criterion, the pair of least growth of the sum of squares
   first, by the nearest-neighbour chain; distances to a merged pair follow by the Lance-Williams formula;
3. ``labels`` cuts the tree at k clusters and gives each row the cluster of its nearest summary.

With up to ``most`` different rows every row is its own summary, and the tree is the
exact one.  The driver holds ``most`` summaries and their distances, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.moments import GROUPS
from tabulon.session import ship_package

MOST = 1000
_KIND = "part int, n binary, sums binary, squares binary"


class Summaries:
    """Clustering features: rows ``n``, ``sums`` of columns and sum of ``squares`` of each group, up to ``most`` of them."""

    def __init__(self, d: int, most: int):
        self.most, self.radius = most, 0.0
        self.n, self.sums, self.squares = np.zeros(0), np.zeros((0, d)), np.zeros(0)

    @property
    def centres(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def add(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        """Take more groups (rows are groups of one).  Equal centres become one group at once."""
        centre, inverse = np.unique(np.concatenate([self.centres, sums / n[:, None]]), axis=0, return_inverse=True)
        self._merge(inverse.ravel(), np.concatenate([self.n, n]), np.concatenate([self.sums, sums]), np.concatenate([self.squares, squares]))
        while len(self.n) > self.most:
            self._absorb()

    def _merge(self, group: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        many = int(group.max(initial=-1)) + 1
        self.n, self.squares = np.bincount(group, n, many), np.bincount(group, squares, many)
        self.sums = np.stack([np.bincount(group, sums[:, j], many) for j in range(sums.shape[1])], axis=1)

    def _absorb(self) -> None:
        """Merge groups within the radius of leaders, the largest groups leading; the radius grows until ``most`` are left."""
        centre = self.centres
        order = np.argsort(-self.n, kind="stable")
        if self.radius == 0.0:
            some = centre[order[:200]]
            gap = _squared(some, some)
            gap[np.arange(len(some)), np.arange(len(some))] = np.inf
            least = np.sqrt(np.maximum(gap.min(axis=1), 0))
            self.radius = float(np.median(least[least > 0])) if (least > 0).any() else 1e-12
        else:
            self.radius *= 1.3
        group, leaders = np.full(len(centre), -1), 0
        left = order
        while len(left):
            if leaders == self.most:  # still too many: the next radius is tried on what there is
                group[left] = np.arange(leaders, leaders + len(left))
                break
            near = _squared(centre[left], centre[left[:1]])[:, 0] <= self.radius ** 2
            near[0] = True
            group[left[near]] = leaders
            leaders += 1
            left = left[~near]
        self._merge(group, self.n, self.sums, self.squares)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0)


def _row(part: int, s: Summaries) -> dict:
    return {"part": pa.array([part], pa.int32()), "n": pa.array([s.n.tobytes()], pa.binary()),
            "sums": pa.array([s.sums.tobytes()], pa.binary()), "squares": pa.array([s.squares.tobytes()], pa.binary())}


def _of(n: bytes, sums: bytes, squares: bytes, d: int):
    return np.frombuffer(n), np.frombuffer(sums).reshape(-1, d), np.frombuffer(squares)


def summaries(df: DataFrame, features: Sequence[str], most: int = MOST) -> Summaries:
    """At most ``most`` summaries of the rows of ``df``; rows with a missing feature are left out."""
    ship_package(df.sparkSession)
    d = len(features)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summaries(d, most)
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            for at in range(0, len(x), 4 * most):
                rows = x[at:at + 4 * most]
                held.add(np.ones(len(rows)), rows, (rows * rows).sum(axis=1))
        if len(held.n):
            yield pa.RecordBatch.from_pydict(_row(TaskContext.get().partitionId() % GROUPS, held))

    def merged(table: pa.Table) -> pa.Table:
        held = Summaries(d, most)
        for r in table.to_pylist():
            held.add(*_of(r["n"], r["sums"], r["squares"], d))
        return pa.table(_row(table["part"][0].as_py(), held))

    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]).dropna()
    total = Summaries(d, most)
    for r in src.mapInArrow(within, _KIND).groupBy("part").applyInArrow(merged, _KIND).collect():  # GROUPS rows of bounded size
        total.add(*_of(r["n"], r["sums"], r["squares"], d))
    return total


def ward_merges(n: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[step] = (one, other, height, rows) of Ward's merges over groups of ``n`` rows, lowest first.

    Groups are numbered 0 to m - 1, the group of step k is m + k.  A height is
    ``sqrt(2 a b / (a + b)) * distance`` of two groups of a and b rows, as is usual.
    """
    m = len(n)
    if m < 2:
        return np.zeros((0, 4))
    size = n.astype(float).copy()
    far = _squared(centres, centres) * (2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(far, np.inf)
    alive = np.ones(m, bool)
    found, chain = [], []
    while len(found) < m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            last = chain[-1]
            near = int(far[last].argmin())
            # of equal distances the one before in the chain, so that the chain ends
            if len(chain) > 1 and far[last, chain[-2]] <= far[last, near]:
                near = chain.pop(-2)
                chain.pop()
                break
            chain.append(near)
        i, j = min(last, near), max(last, near)
        height = far[i, j]
        found.append((i, j, height, size[i] + size[j]))
        others = alive.copy()
        others[[i, j]] = False
        k = np.flatnonzero(others)
        new = ((size[i] + size[k]) * far[i, k] + (size[j] + size[k]) * far[j, k] - size[k] * height) / (size[i] + size[j] + size[k])
        far[i, k] = far[k, i] = new
        far[j, :] = far[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
    # a chain finds merges out of order; heights never fall along the tree, so sorting gives the tree
    order = sorted(range(m - 1), key=lambda s: (found[s][2], s))
    of, out = {}, np.zeros((m - 1, 4))
    for step, s in enumerate(order):
        i, j, height, rows = found[s]
        a, b = _top(of, i), _top(of, j)
        of[a] = of[b] = m + step
        out[step] = (min(a, b), max(a, b), np.sqrt(max(height, 0.0)), rows)
    return out


def _top(of: dict[int, int], group: int) -> int:
    while group in of:
        group = of[group]
    return group


def cut(merges: np.ndarray, m: int, k: int) -> np.ndarray:
    """The cluster (0 to k - 1, in order of the first group) of each of ``m`` groups after all but k - 1 merges."""
    of = {}
    for step in range(max(0, m - k)):
        of[int(merges[step, 0])] = of[int(merges[step, 1])] = m + step
    tops = [_top(of, g) for g in range(m)]
    number = {t: i for i, t in enumerate(dict.fromkeys(tops))}
    return np.array([number[t] for t in tops], int)


class WardTree:
    """``merges`` over the summaries of a table; ``table`` is the dendrogram, ``labels`` the clusters of rows."""

    def __init__(self, df: DataFrame, features: Sequence[str], most: int = MOST):
        self.features, found = list(features), summaries(df, features, most)
        order = np.lexsort(found.centres.T[::-1]) if len(found.n) else np.zeros(0, int)
        self.n, self.centres = found.n[order], found.centres[order] if len(found.n) else np.zeros((0, len(self.features)))
        self.merges = ward_merges(self.n, self.centres)
        self._spark = df.sparkSession

    def table(self) -> DataFrame:
        """(step, one, other, height, rows): at most as many rows as summaries."""
        rows = [(k, int(a), int(b), float(h), int(n)) for k, (a, b, h, n) in enumerate(self.merges)]
        return self._spark.createDataFrame(rows, "step int, one int, other int, height double, rows long")

    def labels(self, df: DataFrame, k: int, name: str = "cluster") -> DataFrame:
        """``df`` with the cluster of each row; null where a feature is missing."""
        of, centres = cut(self.merges, len(self.n), k), self.centres
        ship_package(df.sparkSession)

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype="Int32")
            known = np.flatnonzero(x.notna())
            for at in range(0, len(known), 4096):
                some = known[at:at + 4096]
                rows = np.stack([np.asarray(v, float) for v in x.iloc[some]])
                out.iloc[some] = of[_squared(rows, centres).argmin(axis=1)]
            return out

        cols = [F.col(f"`{c}`").cast("double") for c in self.features]
        there = cols[0].isNotNull()
        for c in cols[1:]:
            there = there & c.isNotNull()
        return df.withColumn(name, nearest(F.when(there, F.array(*cols))))


__all__ = ["WardTree", "Summaries", "summaries", "ward_merges", "cut"]
