"""Sums of products of many columns in one pass, as blocks of numbers instead of one expression a pair.

A task adds up matrices for its rows (Arrow batches, numpy products); the
tasks' matrices are added in groups before the driver adds the last few.  What
reaches the driver is a few matrices of columns x columns, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_package

GROUPS = 8  # sums that reach the driver for each key

# expressions of one aggregation beyond which its plan gets too large
MOST_EXPRESSIONS = 300


def _partial(d: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(float)
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(keys).tolist():
                rows = x[keys == key]
                there = ~np.isnan(rows)
                value = np.where(there, rows, 0.0)
                there = there.astype(float)
                mine = np.stack([there.T @ there, value.T @ there, (value * value).T @ there, value.T @ value])
                sums[key] = sums[key] + mine if key in sums else mine
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([part] * len(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())],
            names=["key", "part", "sums"])

    return add


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table({"key": table["key"][:1], "part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def pairwise_sums(df: DataFrame, cols: Sequence[str], key: str | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(means, {key: [n, x, xx, xy]}), each d x d over the rows where both columns are present:
    ``n`` rows, ``x`` sum of the first column, ``xx`` of its squares, ``xy`` of products; values less their means."""
    ship_package(df.sparkSession)
    kind = "key long, part int, sums binary"
    means = []
    for k in range(0, len(cols), MOST_EXPRESSIONS):
        means += list(df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(cols[k:k + MOST_EXPRESSIONS])]).first())
    means = np.array([0.0 if m is None else m for m in means])
    src = df.select((F.col(f"`{key}`").cast("long") if key else F.lit(0).cast("long")).alias("__key"),
                    *[(F.col(f"`{c}`").cast("double") - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(cols, means))])
    src = src.where(F.col("__key").isNotNull())
    rows = src.mapInArrow(_partial(len(cols)), kind).groupBy("key", "part").applyInArrow(_total, kind).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        m = np.frombuffer(r["sums"]).reshape(4, len(cols), len(cols))
        out[r["key"]] = out[r["key"]] + m if r["key"] in out else m
    return means, out


def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson r of every pair over the rows where both are present; NaN where a column does not vary."""
    _, sums = pairwise_sums(df, cols)
    n, x, xx, xy = sums.get(0, np.zeros((4, len(cols), len(cols))))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = xy - x * x.T / n
        var = xx - x * x / n
        scale = np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0))
        return np.where(scale > 0, np.clip(cov / scale, -1, 1), np.nan)
