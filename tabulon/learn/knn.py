"""Exact k-nearest-neighbour prediction (M05) without comparing all pairs.

Pivot-based pruning (metric-space indexing):

1. ``P`` pivots are drawn from the training rows (smallest seeded hash: a
   top-P, a proven bound) and every training row is assigned to its nearest
   pivot ("cell"); each cell keeps its radius (largest distance to its pivot)
   and size -- a ``P``-row table.
2. For a query q, the cells sorted by their pivot distance give an upper
   bound ``tau_q`` on the k-th neighbour distance (enough rows within
   ``d(q, pivot) + radius``), and the triangle inequality rules out every cell
   with ``d(q, pivot) - radius > tau_q``.
3. Cells are packed into bins of bounded rows, neighbours together.  A block of
   queries (those of one bin's cells) meets each bin that one of them reaches, so a
   query is sent once a bin and not once a cell or shell.  There it is
   compared with the rows whose distance to their pivot lies close enough to its
   own, by matrix products; what may be near is measured again exactly, and
   the k nearest of each bin are ranked by ``row_number() <= k``.

The answer equals brute force (ties broken by training id); the work shrinks
with how clustered the data are.  Prediction is the majority label (smallest
label among equal counts) or the mean label.

``approximate_neighbours`` is the mode for large tables whose vectors cannot be pruned:
several trees of random projections.  A tree divides the training rows at medians (of a bounded
sample) along random directions, so its leaves hold about equally many rows also where a few columns
have all the distance; a query looks into its own leaf and into those behind the limits that it is
closest to.  Distances are exact, recall is a measured figure (``recall``), every row is in a leaf, and a group
of leaves of any size is dealt into parts, so nothing is capped.

``KNN`` is the Estimator over either mode, for folds and comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators._mlbase import WithParts
from tabulon.session import scratch_path, ship_package


def _as_doubles(col: str) -> Column:
    return F.transform(F.col(col), lambda x: x.cast("double"))


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def knn_neighbours(train: DataFrame, query: DataFrame, id_col: str, vec_col: str, label_col: str,
                   k: int = 5, n_pivots: int | None = None, exclude_self: bool = False, seed: int = 42,
                   rings: int = 8, part_rows: int = 50_000) -> DataFrame:
    """(qid, tid, tlabel, dist, rank) for the k nearest training rows of every query row.

    Pivots grow with the square root of the training rows (32 to 256) unless given.
    Bins hold up to about ``part_rows`` rows; a larger cell is dealt into several by a hash of the id, so
    a dense cluster is many groups of bounded size.
    """
    tr = train.select(F.col(id_col).alias("tid"), _as_doubles(vec_col).alias("tv"),
                      F.col(label_col).alias("tlabel"))
    qu = query.select(F.col(id_col).alias("qid"), _as_doubles(vec_col).alias("qv"))
    if n_pivots is None:
        n_pivots = max(32, min(256, int(tr.count() ** 0.5)))
    piv_rows = (tr.orderBy(F.xxhash64("tid", F.lit(seed)), "tid").limit(n_pivots)
                .select("tv").collect())  # n_pivots vectors: bounded
    pivots = F.array(*[F.array(*[F.lit(float(v)) for v in r["tv"]]) for r in piv_rows])

    def pivot_dists(v):
        return F.transform(pivots, lambda p: F.sqrt(sq_dist(p, v)))

    cells = tr.withColumn("_pd", pivot_dists(F.col("tv"))) \
        .withColumn("cell", (F.array_position(F.col("_pd"), F.array_min("_pd")) - 1).cast("int")) \
        .withColumn("_r", F.element_at("_pd", F.col("cell") + 1)).drop("_pd")
    stats = cells.groupBy("cell").agg(F.max("_r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radius = [0.0] * len(piv_rows)
    sizes = [0] * len(piv_rows)
    for r in stats:  # one row per pivot
        radius[r["cell"]], sizes[r["cell"]] = float(r["radius"]), int(r["n"])
    # rings: each cell cut into equal-width shells of distance to its pivot; a shell's
    # [rmin, rmax] gives the lower bound max(d(q,p) - rmax, rmin - d(q,p)) on d(q, t)
    rad_arr = F.array(*[F.lit(x) for x in radius])
    cells = cells.withColumn("ring", F.least(F.lit(rings - 1), F.floor(
        F.try_divide(F.col("_r"), F.element_at(rad_arr, F.col("cell") + 1)) * rings)).cast("int"))
    cells = cells.withColumn("ring", F.coalesce(F.col("ring"), F.lit(0)))
    shells = cells.groupBy("cell", "ring").agg(F.min("_r").alias("rmin"), F.max("_r").alias("rmax")).collect()
    shell_c = [int(r["cell"]) for r in shells]  # at most pivots x rings rows
    shell_lo = [float(r["rmin"]) for r in shells]
    shell_hi = [float(r["rmax"]) for r in shells]
    # bins of whole cells, of neighbours by their place along the pivots' widest direction; a large cell is several
    points = np.array([[float(v) for v in r["tv"]] for r in piv_rows])
    first, many = _binned(points, sizes, part_rows)
    firsts, manys = F.array(*[F.lit(x) for x in first]), F.array(*[F.lit(x) for x in many])

    def bin_of(id_name):
        return (F.element_at(firsts, F.col("cell") + 1) + F.pmod(F.xxhash64(id_name), F.element_at(manys, F.col("cell") + 1))).cast("int")

    if exclude_self:  # as a null id differs from nothing
        cells, qu = cells.where("tid is not null"), qu.where("qid is not null")
    cells = cells.withColumn("bin", bin_of("tid"))
    spark = train.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "cells")  # read by both phases
    cells.where("cell is not null").select("bin", "cell", F.col("_r").alias("r"), "tid", "tv", "tlabel").write.parquet(path)
    cells = spark.read.parquet(path)
    need = k + (1 if exclude_self else 0)
    info = F.arrays_zip(F.col("_qd").alias("d"), F.array(*[F.lit(x) for x in radius]).alias("r"),
                        F.array(*[F.lit(x) for x in sizes]).alias("n"),
                        F.sequence(F.lit(0), F.lit(len(piv_rows) - 1)).alias("c"))
    srt = F.array_sort(F.col("_info"), lambda a, b: F.when(a["d"] < b["d"], -1).when(a["d"] > b["d"], 1)
                       .otherwise(F.when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(0)))
    bound = F.aggregate(srt, F.struct(F.lit(0).cast("long").alias("cnt"), F.lit(0.0).alias("tau")),
                        lambda acc, s: F.when(acc["cnt"] >= need, acc).otherwise(
                            F.struct((acc["cnt"] + s["n"]).alias("cnt"),
                                     F.greatest(acc["tau"], s["d"] + s["r"]).alias("tau"))))
    types = {f.name: f.dataType.simpleString() for f in [*tr.schema, *qu.schema]}

    # phase 1: the k-th distance among the rows of the query's own bin -> a tight upper bound
    path = scratch_path(spark, "asked")
    (qu.withColumn("_qd", pivot_dists(F.col("qv"))).withColumn("_info", info)
     .withColumn("cell", (F.array_position(F.col("_qd"), F.array_min("_qd")) - 1).cast("int"))
     .withColumn("home", bin_of("qid")).where("home is not null")
     .select(F.monotonically_increasing_id().alias("row"), "home", "cell", "qid", "qv", "_qd", bound["tau"].alias("tau"))).write.parquet(path)
    q0 = spark.read.parquet(path)
    one = q0.select("row", "home", "qid", "qv", "cell", "tau").groupBy("home").cogroup(cells.groupBy("bin")).applyInArrow(
        _own_bound(k, exclude_self), "row long, bound double")
    q = q0.join(one, "row", "left").withColumn("_tau", F.coalesce("bound", "tau") * (1 + 1e-9) + 1e-12)
    shell_info = F.arrays_zip(F.array(*[F.lit(x) for x in shell_c]).alias("c"),
                              F.array(*[F.lit(x) for x in shell_lo]).alias("lo"),
                              F.array(*[F.lit(x) for x in shell_hi]).alias("hi"))
    keep = F.filter(shell_info, lambda sh: F.greatest(F.element_at(F.col("_qd"), sh["c"] + 1) - sh["hi"],
                                                      sh["lo"] - F.element_at(F.col("_qd"), sh["c"] + 1))
                    <= F.col("_tau"))
    reach = F.array_distinct(F.flatten(F.transform(keep, lambda sh: F.sequence(
        F.element_at(firsts, sh["c"] + 1), F.element_at(firsts, sh["c"] + 1) + F.element_at(manys, sh["c"] + 1) - 1))))
    path = scratch_path(spark, "bins")
    q.select("home", "qid", "qv", F.col("_tau").alias("tau"), reach.alias("bins")).write.parquet(path)
    q = spark.read.parquet(path)

    # phase 2: a block of queries of one home meets each bin that one of them reaches, whole
    ask = q.select("home", "qid", "qv", "tau", F.explode("bins").alias("bin"))
    met = ask.select(F.col("home").alias("block"), F.col("bin").alias("of")).distinct()  # at most bins x bins rows
    put = cells.join(met, F.col("bin") == F.col("of")).drop("of")
    found = ask.groupBy("home", "bin").cogroup(put.groupBy("block", "bin")).applyInArrow(
        _within(points, k, exclude_self), f"qid {types['qid']}, tid {types['tid']}, tlabel {types['tlabel']}, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


BIN_ROWS = 2_000  # rows of a bin at least, where there are few
LEAST_BINS = 8
AT_ONCE = 2_000_000  # distances in memory
IN_CACHE = 1 << 16  # the same, where each is looked at once
EXACT_PAIRS = 50_000


def _binned(points: np.ndarray, sizes: list[int], part_rows: int) -> tuple[list[int], list[int]]:
    """(first bin, number of bins) of each cell: bins of up to ``part_rows`` rows about, of whole cells or of a part of one."""
    total = sum(sizes)
    most = -(-total // max(1, -(-total // part_rows), min(LEAST_BINS, -(-total // BIN_ROWS)))) or 1
    centred = points - points.mean(axis=0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    first, many, at, filled = [0] * len(sizes), [1] * len(sizes), 0, 0
    for c in np.argsort(along, kind="stable").tolist():
        if filled and filled + sizes[c] > most:
            at, filled = at + 1, 0
        first[c], many[c] = at, max(1, -(-sizes[c] // most))
        if many[c] > 1:
            at += many[c]
        else:
            filled += sizes[c]
    return first, many


def _vectors(col: pa.ChunkedArray) -> np.ndarray:
    n = len(col)
    return np.asarray(col.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def _distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of rows to rows, summed eight columns at a time: equal vectors have equal distances."""
    total = None
    for low in range(0, q.shape[1], 8):
        part = None
        for c in range(low, min(low + 8, q.shape[1])):
            d = q[:, c] - t[:, c]
            part = d * d if part is None else part + d * d
        total = part if total is None else total + part
    return np.sqrt(total)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of both sides as numbers that are equal where the ids are."""
    both = pa.chunked_array([*a.chunks, *b.cast(a.type).chunks], a.type).combine_chunks().dictionary_encode()
    code = both.indices.to_numpy(zero_copy_only=False)
    return code[:len(a)], code[len(a):]


def _best(line: np.ndarray, col: np.ndarray, dist: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are the k first of their line by distance and place."""
    order = np.lexsort((place[col], dist, line))
    sorted_ = line[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[rank < k]


def _near_pairs(q, tau, t, place, k, same=None):
    """(line, col, dist) of the k nearest rows of each query within its ``tau``; the pairs of ``same`` (codes) take no part."""
    qq, tt = (q * q).sum(axis=1), (t * t).sum(axis=1)
    step = max(1, AT_ONCE // max(len(t), 1))
    out = []
    for at in range(0, len(q), step):
        lines = slice(at, at + step)
        far = qq[lines, None] + tt[None] - 2 * q[lines] @ t.T
        # a difference of squares loses digits: what may lie within the limit is measured again
        far -= 1e-9 * (qq[lines, None] + tt[None])
        ok = far <= (tau[lines] ** 2)[:, None]
        if same is not None:
            ok &= same[0][lines, None] != same[1][None, :]
        line, col = np.nonzero(ok)
        line += at
        dist = np.concatenate([np.zeros(0), *[_distances(q[line[i:i + EXACT_PAIRS]], t[col[i:i + EXACT_PAIRS]]) for i in range(0, len(line), EXACT_PAIRS)]])
        some = _best(line, col, dist, place, k)
        some = some[dist[some] <= tau[line[some]]]
        out.append((line[some], col[some], dist[some]))
    return [np.concatenate([o[i] for o in out]) for i in range(3)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The order of the ids, nulls first."""
    order = pc.array_sort_indices(ids.combine_chunks(), null_placement="at_start").to_numpy()
    place = np.zeros(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _own_bound(k: int, exclude_self: bool):
    """The k-th distance of each query among the rows of its own bin, cell by cell where its own cell has enough."""

    def find(key, asked: pa.Table, train: pa.Table) -> pa.Table:
        rows, bounds = [], []
        if asked.num_rows and train.num_rows:
            q, t = _vectors(asked["qv"]), _vectors(train["tv"])
            mine, theirs = _codes(asked["qid"], train["tid"]) if exclude_self else (None, None)
            row, home, cell = asked["row"].to_numpy(), asked["cell"].to_numpy(), train["cell"].to_numpy()
            tt = (t * t).sum(axis=1)
            for c in np.unique(home):
                cols = np.flatnonzero(cell == c)
                if len(cols) <= k:
                    continue
                lines = np.flatnonzero(home == c)
                step = max(1, AT_ONCE // len(cols))
                for at in range(0, len(lines), step):
                    some = lines[at:at + step]
                    qq = (q[some] * q[some]).sum(axis=1)
                    far = qq[:, None] + tt[None, cols] - 2 * q[some] @ t[cols].T
                    far += 1e-9 * (qq[:, None] + tt[None, cols])  # never below the distance
                    if exclude_self:
                        far[mine[some, None] == theirs[None, cols]] = np.inf
                    kth = np.partition(far, k - 1, axis=1)[:, k - 1]
                    fine = np.isfinite(kth)
                    rows.append(row[some][fine])
                    bounds.append(np.sqrt(np.maximum(kth[fine], 0.0)))
        return pa.table({"row": pa.array(np.concatenate([np.zeros(0, np.int64), *rows])), "bound": pa.array(np.concatenate([np.zeros(0), *bounds]))})

    return find


def _within(points: np.ndarray, k: int, exclude_self: bool):
    """The k nearest rows of a bin for each query of a block, of those whose distance to their pivot lies close enough to the query's."""

    def find(key, asked: pa.Table, train: pa.Table) -> pa.Table:
        lines, cols, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asked.num_rows and train.num_rows:
            q, t, tau = _vectors(asked["qv"]), _vectors(train["tv"]), asked["tau"].to_numpy()
            cell, r, place = train["cell"].to_numpy(), train["r"].to_numpy(), _places(train["tid"])
            codes = _codes(asked["qid"], train["tid"]) if exclude_self else None
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                rows = rows[np.argsort(r[rows], kind="stable")]
                rs = r[rows]
                d = np.sqrt(((q - points[c]) ** 2).sum(axis=1))
                slack = 1e-9 * (1 + d)
                low, high = np.searchsorted(rs, d - tau - slack), np.searchsorted(rs, d + tau + slack, side="right")
                who = np.flatnonzero(high > low)
                who = who[np.argsort(d[who], kind="stable")]
                for at in range(0, len(who), 128):
                    some = who[at:at + 128]
                    part = rows[low[some].min():high[some].max()]
                    line, col, dist = _near_pairs(q[some], tau[some], t[part], place[part], k, None if codes is None else (codes[0][some], codes[1][part]))
                    lines.append(some[line])
                    cols.append(part[col])
                    dists.append(dist)
            line, col, dist = np.concatenate(lines), np.concatenate(cols), np.concatenate(dists)
            best = _best(line, col, dist, place, k)
            lines, cols, dists = [line[best]], [col[best]], [dist[best]]
        line, col = pa.array(np.concatenate(lines)), pa.array(np.concatenate(cols))
        return pa.table({"qid": asked["qid"].take(line), "tid": train["tid"].take(col), "tlabel": train["tlabel"].take(col), "dist": pa.array(np.concatenate(dists))})

    return find


def knn_classify(train: DataFrame, query: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5,
                 **kw) -> DataFrame:
    """Majority label of the k nearest neighbours; smallest label among equal counts."""
    nb = knn_neighbours(train, query, id_col, vec_col, label_col, k, **kw)
    votes = nb.groupBy("qid", "tlabel").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("c")).alias("neg"), F.col("tlabel"))).alias("b"))
    return best.select(F.col("qid").alias(id_col), F.col("b.tlabel").alias("prediction"))


def knn_regress(train: DataFrame, query: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5,
                **kw) -> DataFrame:
    """Mean label of the k nearest neighbours."""
    nb = knn_neighbours(train, query, id_col, vec_col, label_col, k, **kw)
    return nb.groupBy("qid").agg(F.avg(F.col("tlabel").cast("double")).alias("prediction")) \
        .withColumnRenamed("qid", id_col)


# ----------------------------------------------------------------- approximate: several trees of random projections
SAMPLE_NUMBERS = 4 << 20  # of the training rows that the limits of the trees are medians of
LEAF_SAMPLE = 32  # rows of the sample for each leaf, if there are so many; a quarter of them at least
GROUP_LEAVES = 32  # neighbouring leaves of a tree that are searched by one group
PART_BUCKETS = 8  # buckets of ``part_rows`` rows that a group holds on either side


class _Leaves:
    """Trees of one depth.  A tree has a direction a level; each node has its own limit, the median of its rows of the sample."""

    def __init__(self, sample: np.ndarray, dim: int, tables: int, depth: int, seed: int):
        self.depth, self.planes = depth, np.random.default_rng(seed).normal(size=(tables, dim, depth))
        self.limits = np.full((tables, 1 << depth), np.inf)  # a node's children are 2 * node and 2 * node + 1
        for planes, limits in zip(self.planes, self.limits):
            along, node = sample @ planes, np.ones(len(sample), np.int64)
            for level in range(depth):
                order = np.lexsort((along[:, level], node))
                begins = np.flatnonzero(np.diff(node[order], prepend=0))
                ends = np.append(begins[1:], len(order))
                limits[node[order[begins]]] = along[order[(begins + ends - 1) // 2], level]
                node = 2 * node + (along[:, level] > limits[node])

    def probe(self, x: np.ndarray, table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): for each row its own leaf and those behind the limits that it is closest to, ``probes`` at most."""
        along, n = x @ self.planes[table], len(x)
        node, far = np.ones((n, 1), np.int64), np.zeros((n, 1))  # far: squared steps over limits
        for level in range(self.depth):
            step = along[:, level, None] - self.limits[table][node]
            own = 2 * node + (step > 0)
            node, far = np.concatenate([own, own ^ 1], axis=1), np.concatenate([far, far + step * step], axis=1)
            if node.shape[1] > probes:
                some = np.argsort(far, axis=1, kind="stable")[:, :probes]
                node, far = np.take_along_axis(node, some, axis=1), np.take_along_axis(far, some, axis=1)
        row, at = np.nonzero(np.isfinite(far))  # behind a limit without rows there is nothing
        return row, node[row, at] - (1 << self.depth)


_FOUND = "found array<struct<dist: double, tid: bigint, tlabel: double>>"


def _dealt(trees: _Leaves, probes: int, grouped: int):
    """Rows -> rows for each group of leaves that they look into, with those leaves; ``probes`` 1 gives a row's own leaf of each tree."""
    most = max(0, trees.depth - grouped)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x = _vectors(pa.chunked_array([b.column("v")]))
                for t in range(len(trees.planes)):
                    row, leaf = trees.probe(x, t, probes)
                    group = leaf >> min(grouped, trees.depth)
                    order = np.lexsort((leaf, group, row))
                    row, leaf, group = row[order], leaf[order], group[order]
                    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                    rows = b.take(pa.array(row[new]))
                    leaves = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(((t << most) + group[new]).astype(np.int64)), leaves], names=[*b.schema.names, "key", "leaves"])

    return emit


def _nearest(k: int, exclude_self: bool):
    """The ``k`` nearest training rows of each query in the leaves that it looks into, a row a query; rows of one fold do not meet."""

    def find(key, queries: pa.Table, train: pa.Table) -> pa.Table:
        lines, cols, dists, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(0, np.int64)
        if queries.num_rows and train.num_rows:
            train = train.sort_by("id")  # the same answer in whatever order rows come
            q, t, place = _vectors(queries["v"]), _vectors(train["v"]), _places(train["id"])
            q_fold, t_fold = queries["fold"].to_numpy(), train["fold"].to_numpy()
            mine, theirs = _codes(queries["id"], train["id"]) if exclude_self else (None, None)
            middle = t.mean(axis=0)  # a difference of squares loses few digits about it
            # squared distances less the query's own square, as one product
            qc, tc = np.column_stack([q - middle, np.ones(len(q))]), t - middle
            square, tc = (qc * qc).sum(axis=1), np.column_stack([-2 * tc, (tc * tc).sum(axis=1)])
            asked = queries["leaves"].combine_chunks()
            who, leaf = np.repeat(np.arange(len(q)), pc.list_value_length(asked).to_numpy()), asked.flatten().to_numpy()
            own = train["leaves"].combine_chunks().flatten().to_numpy()  # one leaf a row
            by, to = np.argsort(leaf, kind="stable"), np.argsort(own, kind="stable")
            for one in np.unique(own):
                rows = to[np.searchsorted(own[to], one):np.searchsorted(own[to], one, side="right")]
                some = who[by[np.searchsorted(leaf[by], one):np.searchsorted(leaf[by], one, side="right")]]
                step, there, folds = max(1, IN_CACHE // len(rows)), tc[rows].T.copy(), t_fold[rows]
                for at in range(0, len(some), step):
                    part = some[at:at + step]
                    far = qc[part] @ there
                    np.putmask(far, q_fold[part, None] == folds[None], np.inf)
                    if exclude_self:
                        np.putmask(far, mine[part, None] == theirs[None, rows], np.inf)
                    kth = np.partition(far, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
                    # all that may be as near as the k-th, so that ids decide among equals
                    line, col = np.nonzero((far <= (kth + 1e-12 * (square[part] + there[-1].max()))[:, None]) & np.isfinite(far))
                    lines.append(part[line])
                    cols.append(rows[col])
                    # the few chosen are measured again
                    dists.append(_distances(q[lines[-1]], t[cols[-1]]))
        line, col, dist = np.concatenate(lines), np.concatenate(cols), np.concatenate(dists)
        best = _best(line, col, dist, place, k)  # by query and distance
        line, col, dist = line[best], col[best], dist[best]
        begins = np.flatnonzero(np.diff(line, prepend=-1))
        found = pa.StructArray.from_arrays([pa.array(dist), train["id"].take(pa.array(col)).combine_chunks(), train["label"].take(pa.array(col)).combine_chunks()], names=["dist", "tid", "tlabel"])
        return pa.table({"qid": queries["id"].take(pa.array(line[begins])), "found": pa.ListArray.from_arrays(pa.array(np.append(begins, len(line)).astype(np.int32)), found)})

    return find


def approximate_neighbours(train: DataFrame, query: DataFrame, id_col: str, vec_col: str, label_col: str, k: int = 5, exclude_self: bool = False,
                           tables: int = 8, flips: int = 4, bucket_rows: int = 500, part_rows: int = 5_000, seed: int = 42, fold: str | None = None) -> DataFrame:
    """(qid, tid, tlabel, dist, rank): the k nearest of the training rows that share a probed leaf with the query.

    Leaves have ``bucket_rows`` rows on average, whatever the scales of the columns; more tables, flips or rows a leaf
    raise recall and work.  ``id_col`` is a long and label a number.  Of equal training rows only those of the smallest
    ids can be among the nearest, so the others are left out first.  A group of leaves with more rows than
    ``PART_BUCKETS`` times ``part_rows`` on either side is dealt into parts of both.  With ``fold``, a query's neighbours are of
    other folds only (rows without one take no part): all folds of a cross-validation in one search.
    """
    spark = train.sparkSession
    ship_package(spark)

    def rows(df):
        if fold:
            df = df.where(F.col(fold).isNotNull())
        return df.select(F.col(id_col).cast("long").alias("id"), _as_doubles(vec_col).alias("v"), F.col(label_col).cast("double").alias("label"),
                         F.col(fold).cast("int").alias("fold") if fold else F.lit(-1).alias("fold"))

    path = scratch_path(spark, "different")
    place = F.dense_rank().over(Window.partitionBy("v", "fold").orderBy("id"))
    kind = rows(train).schema
    rows(train).withColumn("__place", place).where(F.col("__place") <= k + int(exclude_self)).groupBy("v", "fold", "id").agg(
        F.min("label").alias("label")).select("id", "v", "label", "fold").write.parquet(path)
    tr, qu = spark.read.schema(kind).parquet(path), rows(query if label_col in query.columns else query.withColumn(label_col, F.lit(0.0)))
    if not fold:  # queries and training rows always meet
        qu = qu.withColumn("fold", F.lit(-2))
    head = tr.select(F.size("v").alias("d")).first()
    if head is None:
        raise ValueError("no training rows")
    dim, n = head["d"], tr.count()
    most = max(1, SAMPLE_NUMBERS // dim)
    depth = max(0, min(math.ceil(math.log2(max(n / bucket_rows, 1))), int(math.log2(max(most // (LEAF_SAMPLE // 4), 1)))))
    share = min(1.0, LEAF_SAMPLE * (1 << depth) / n, most / n)
    drawn = F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = _vectors(tr.where(drawn).orderBy("id", "v").select("v").toArrow()["v"]) if depth else np.zeros((0, dim))  # ``most`` rows about
    trees = _Leaves(sample.reshape(len(sample), dim), dim, tables if depth else 1, depth, seed)
    grouped = int(math.log2(GROUP_LEAVES))
    kind = "id long, v array<double>, label double, fold int, key long, leaves array<int>"
    put = tr.mapInArrow(_dealt(trees, 1, grouped), kind)
    ask = qu.mapInArrow(_dealt(trees, 1 + flips + math.comb(flips, 2), grouped), kind)

    def parts(df, name):
        return df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (PART_BUCKETS * part_rows)).cast("int").alias(name))

    path = scratch_path(spark, "groups")  # read twice: dealing the rows costs more than writing them
    put.write.parquet(f"{path}/put")
    ask.write.parquet(f"{path}/ask")
    put, ask = spark.read.schema(kind).parquet(f"{path}/put"), spark.read.schema(kind).parquet(f"{path}/ask")
    counts = parts(put, "t_parts").join(parts(ask, "q_parts"), "key")
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.schema("key long, t_parts int, q_parts int").parquet(f"{path}/counts")

    def dealt(df, own, other):
        mine = F.pmod(F.xxhash64("id", "v"), F.col(f"{own}_parts")).cast("int").alias(own)
        return df.join(counts, "key").select("key", "id", "v", "label", "fold", "leaves", mine, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(other))

    left, right = dealt(ask, "q", "t"), dealt(put, "t", "q")
    met = left.groupBy("key", "q", "t").cogroup(right.groupBy("key", "q", "t")).applyInArrow(_nearest(k + int(exclude_self), exclude_self), f"qid long, {_FOUND}")
    # a pair found in several trees is one
    each = met.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).select("qid", F.inline("found"))
    once = each.groupBy("qid", "tid").agg(F.min("tlabel").alias("tlabel"), F.min("dist").alias("dist"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "tid"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, hits, recall): the share of the exact neighbours that were found."""
    pairs = exact.select("qid", "tid").join(found.select("qid", "tid", F.lit(1).alias("hit")), ["qid", "tid"], "left")
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return out.withColumn("recall", F.try_divide("hits", "n"))


class KNN(Estimator):
    """M05 as an Estimator: ``fit`` writes the training rows, ``transform`` adds the prediction (and, for two classes,
    ``probability``: the share of the votes).  ``mode``: ``exact`` or ``approximate``."""

    def __init__(self, k: int = 5, classification: bool = False, mode: str = "exact", featuresCol: str = "features", labelCol: str = "label", **options):
        super().__init__()
        self.k, self.classification, self.mode, self.featuresCol, self.labelCol, self.options = k, classification, mode, featuresCol, labelCol, options

    def _fit(self, dataset):
        path = scratch_path(dataset.sparkSession, "neighbours")
        rows = dataset.select(vector_to_array(self.featuresCol).alias("v"), F.col(self.labelCol).cast("double").alias("label"))
        rows.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
        return KNNModel(path, self.k, self.classification, self.mode, self.featuresCol, self.options)

    def out_of_fold(self, dataset: DataFrame, fold: str) -> DataFrame:
        """Approximate mode: each row predicted from the rows of other folds, all folds in one search."""
        asked, numbered = _numbered(dataset.where(F.col(fold).isNotNull()), self.featuresCol, self.labelCol, fold)
        found = approximate_neighbours(asked, asked, "id", "v", "label", self.k, fold="fold", **self.options)
        return _predicted(numbered, found, self.classification)


def _numbered(dataset: DataFrame, features: str, label: str | None = None, fold: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, v, label, fold) of rows that are written with a number, as their neighbours come back by number, and these rows."""
    path = scratch_path(dataset.sparkSession, "queries")
    numbered = dataset.withColumn("__row", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    numbered = dataset.sparkSession.read.schema(numbered.schema).parquet(path)
    return numbered.select(F.col("__row").alias("id"), vector_to_array(features).alias("v"), F.col(label).cast("double").alias("label") if label else F.lit(0.0).alias("label"),
                           *([F.col(fold).cast("int").alias("fold")] if fold else [])), numbered


def _predicted(numbered: DataFrame, found: DataFrame, classification: bool) -> DataFrame:
    """The rows with the mean of their neighbours' labels, or with the label of most of them and the share of 1."""
    if not classification:
        per = found.groupBy(F.col("qid").alias("__qid")).agg(F.avg("tlabel").alias("prediction"))
        return numbered.join(per, F.col("__row") == F.col("__qid"), "left").drop("__row", "__qid")
    votes = found.groupBy("qid", "tlabel").agg(F.count(F.lit(1)).alias("c"))
    per = votes.groupBy("qid").agg(F.min(F.struct((-F.col("c")).alias("less"), F.col("tlabel"))).alias("best"),
                                   F.coalesce(F.sum(F.when(F.col("tlabel") == 1, F.col("c"))), F.lit(0)).alias("ones"), F.sum("c").alias("all"))
    share = F.coalesce(F.col("ones") / F.col("all"), F.lit(0.0))
    per = per.select(F.col("qid").alias("__qid"), F.col("best.tlabel").alias("prediction"), array_to_vector(F.array(1 - share, share)).alias("probability"))
    return numbered.join(per, F.col("__row") == F.col("__qid"), "left").drop("__row", "__qid")


class KNNModel(WithParts, Model):
    """Saved with its training rows."""

    def __init__(self, path, k, classification, mode, featuresCol, options):
        super().__init__()
        self.path, self.k, self.classification, self.mode, self.featuresCol, self.options = path, k, classification, mode, featuresCol, options

    def _parts(self):
        from pyspark.sql import SparkSession
        values = dict(k=self.k, classification=self.classification, mode=self.mode, featuresCol=self.featuresCol, options=self.options)
        return values, {"rows": SparkSession.getActiveSession().read.parquet(self.path)}, {}

    @classmethod
    def _from_parts(cls, values, tables, children):
        return cls(tables["rows"], **values)

    def _transform(self, dataset):
        asked, numbered = _numbered(dataset, self.featuresCol)
        near = knn_neighbours if self.mode == "exact" else approximate_neighbours
        found = near(dataset.sparkSession.read.parquet(self.path), asked, "id", "v", "label", self.k, **self.options)
        return _predicted(numbered, found, self.classification)
