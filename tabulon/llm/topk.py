"""Exact top-k search by inner product with a pivot-distance index.

Components become integers, ``floor(scale * x)``, and one more component makes
all vectors equally long, so the largest inner product is the smallest distance.
Every vector is stored under its nearest pivot and keyed by its distance to it.
A cell (pivot) is cut into annuli of bounded size.

A query first searches the annuli around its own distance in its nearest cells,
outwards, which bounds its k-th best distance.  By the triangle inequality a
vector of cell p can only be better if its distance to p lies within that bound
of the query's; so the query then visits just the annuli that reach into this
interval, and inside an annulus just that stretch of the sorted distances.
Scores are exact integers; distances only decide what to skip, with a margin for
rounding.  Results are those of a scan whatever the pivots are.

Pivots come from a bounded sample (``SAMPLE`` rows by hash of the id); every row
is indexed.  ``PIVOTS`` grows with the square root of the rows up to ``MAX_PIVOTS``.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, neither do rows without an id; vectors meet only those
of their own length; a query is not its own candidate, nor is any row with its
id; repeated rows of another id are candidates each; ties go to the smaller id;
an empty table gives an empty result; other columns do not take part.  Scores
are exact while sums of products stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import read_table, written
from tabulon.session import ship_package

SAMPLE = 8192
MAX_PIVOTS = 256
ANNULUS_ROWS = 2000   # vectors of an annulus, about
CHUNK_QUERIES = 512   # queries that meet an annulus at once
FIRST_CELLS = 3       # cells in which a query's bound is found


def _matrix(col: pa.Array) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def _lift(x: np.ndarray, radius2: float) -> np.ndarray:
    """One more component, so that every vector has length sqrt(radius2)."""
    rest = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", x, x), 0.0))
    return np.hstack([x, rest[:, None]])


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, v array<double> of integers, norm2) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    ok = (F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
          & F.forall(F.col(vec_col), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))))
    kept = df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vec_col).alias("dim"), v.alias("v"))
    return kept.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample that lie far apart, then moved to the mean of what is nearest to them."""
    sample = np.unique(sample, axis=0)
    picked = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(picked) < min(count, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[picked[-1]], axis=1))
    pivots = sample[picked].astype(float)
    for _ in range(5):
        cell = _far(sample, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            mine = sample[cell == p]
            if len(mine):
                pivots[p] = mine.mean(axis=0)
    return pivots


class _Model:
    """Pivots of each vector length, and the common length of the lifted vectors."""

    def __init__(self, pivots: dict[int, np.ndarray], radius2: float):
        self.pivots, self.radius2 = pivots, radius2

    def place(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _far(_lift(x, self.radius2), self.pivots[dim])
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(x)), cell]

    def query_far(self, dim: int, q: np.ndarray) -> np.ndarray:
        return _far(np.hstack([q, np.zeros((len(q), 1))]), self.pivots[dim])

    def reach(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from a query of this squared length to a candidate with this score, and a margin for rounding."""
        d2 = norm2 + self.radius2 - 2 * score
        return np.sqrt(np.maximum(d2, 0.0)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(self.radius2))


def fit(vectors: DataFrame) -> _Model:
    rows = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m")).collect()  # a row a length
    pivots, radius2 = {}, max([float(r["m"]) for r in rows], default=0.0)
    for r in rows:
        share = min(1.0, SAMPLE / r["n"])
        mine = vectors.where(F.col("dim") == r["dim"])
        some = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).collect()
        some = some or mine.select("v").limit(SAMPLE).collect()  # ids that all hash alike
        count = int(min(MAX_PIVOTS, max(1, np.sqrt(r["n"]))))
        pivots[r["dim"]] = choose_pivots(_lift(np.array([x["v"] for x in some]), radius2), count)
    return _Model(pivots, radius2)


def _placer(model: _Model):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                cell, far = model.place(dim, _matrix(rows.column("v")))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "dim", "v")), pa.array(cell.astype(np.int32)), pa.array(far)],
                                                 names=["vec_id", "dim", "v", "cell", "far"])

    return place


def build_index(vectors: DataFrame, model: _Model, annulus_rows: int = ANNULUS_ROWS) -> tuple[DataFrame, DataFrame]:
    """(vectors with cell, far and annulus; annuli with dim, cell, annulus, part, low, high).

    A cell is cut at quantiles of its distances.  Where one distance holds more
    than an annulus (equal vectors), the annulus is cut into parts by a hash of the id.
    """
    placed = written(vectors.select("vec_id", "dim", "v").mapInArrow(_placer(model), "vec_id long, dim int, v array<double>, cell int, far double"), "placed")
    cuts = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [k / 64 for k in range(1, 64)], 10000).alias("q"))
    # as many of the 63 quantiles as the cell has annuli; at most MAX_PIVOTS rows a vector length
    step = F.greatest(F.lit(1), F.floor(F.lit(64) * annulus_rows / F.col("n")).cast("int"))
    cuts = cuts.select("dim", "cell", F.filter(F.array_distinct("q"), lambda x, i: F.pmod(i + 1, step) == 0).alias("edges"))
    ringed = placed.join(F.broadcast(cuts), ["dim", "cell"]).withColumn(
        "ring", F.size(F.filter("edges", lambda e: e < F.col("far")))).drop("edges")
    ringed = written(ringed, "rings")
    parts = ringed.groupBy("dim", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * annulus_rows)).cast("int").alias("parts"))
    index = written(ringed.join(F.broadcast(parts), ["dim", "cell", "ring"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts"), "index")
    annuli = written(index.groupBy(*ANNULUS).agg(F.min("far").alias("low"), F.max("far").alias("high")), "annuli")
    return index, annuli


ANNULUS = ["dim", "cell", "ring", "part"]
ROUTE = "query_id long, dim int, v array<double>, chunk int, bound double, cell int, qfar double"


def _router(model: _Model, cells: int | None):
    """Each query with the cells it may visit (its nearest ``cells``, or all) and its distance to their pivots."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == dim))
                far = model.query_far(dim, _matrix(rows.column("v")))
                order = np.argsort(far, axis=1)[:, :cells]
                r = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
                taken = rows.select(["query_id", "dim", "v", "chunk", "bound"]).take(r)
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(far, order, axis=1).ravel())],
                    names=["query_id", "dim", "v", "chunk", "bound", "cell", "qfar"])

    return route


def _searcher(k: int):
    """Best k of an annulus for each query that visits it."""

    def search(visits: pa.Table, stored: pa.Table) -> pa.Table:
        if visits.num_rows and stored.num_rows:
            visits, stored = visits.combine_chunks(), stored.combine_chunks().sort_by("vec_id")
            bound, qfar = visits["bound"].to_numpy(), visits["qfar"].to_numpy()
            far = stored["far"].to_numpy()
            stored = stored.filter(pa.array((far >= (qfar - bound).min()) & (far <= (qfar + bound).max())))
        if not visits.num_rows or not stored.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, queries = stored["vec_id"].to_numpy(), visits["query_id"].to_numpy()
        score = _matrix(visits["v"].combine_chunks()) @ _matrix(stored["v"].combine_chunks()).T
        score[queries[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids are in order, so ties go to the smaller
        value = np.take_along_axis(score, best, axis=1)
        r, c = np.nonzero(np.isfinite(value))
        return pa.table({"query_id": queries[r], "vec_id": ids[best[r, c]], "score": value[r, c].astype(np.int64)})

    return search


def _visit(routes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Visits (query, annulus, chunk of queries) met with the vectors of the annulus, k rows each."""
    routes = written(routes, "visits")
    meetings = routes.select(*[F.col(c).alias(c) for c in (*ANNULUS, "chunk")]).distinct()
    stored = index.join(meetings, ANNULUS)
    key = [*ANNULUS, "chunk"]
    return routes.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(
        lambda left, right: _searcher(k)(left, right), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          annulus_rows: int = ANNULUS_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each id of ``queries``.

    Of query rows that repeat an id the smallest vector is taken.
    """
    ship_package(vectors.sparkSession)
    ints = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(queries, id_col, vec_col, scale)
    model = fit(ints)
    index, annuli = build_index(ints, model, annulus_rows)
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v")).alias("x"))
    asked = written(asked.select("query_id", "x.dim", "x.v").join(index.select("dim").distinct(), "dim", "left_semi"), "queries")
    chunks = asked.count() // chunk_queries + 1
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))

    # the annulus nearest to the query's own distance, in its nearest cells
    near = asked.withColumn("bound", F.lit(float("inf"))).mapInArrow(_router(model, FIRST_CELLS), ROUTE).hint("merge").join(annuli, ["dim", "cell"])
    gap = F.greatest(F.col("low") - F.col("qfar"), F.col("qfar") - F.col("high"), F.lit(0.0))
    nearest = Window.partitionBy("query_id", "cell").orderBy(gap, "ring", "part")
    near = near.withColumn("nth", F.row_number().over(nearest)).where("nth = 1").drop("nth", "low", "high")
    first = _ranked(_visit(near, index, k), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))

    bounded = asked.join(first, "query_id", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("kth"))).drop("n")
    bounded = bounded.mapInArrow(_bounder(model), "query_id long, dim int, v array<double>, chunk int, bound double")
    reach = (F.col("low") <= F.col("qfar") + F.col("bound")) & (F.col("high") >= F.col("qfar") - F.col("bound"))
    routes = bounded.mapInArrow(_router(model, None), ROUTE).hint("merge").join(annuli, ["dim", "cell"]).where(reach).drop("low", "high")
    return _ranked(_visit(routes, index, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounder(model: _Model):
    """The distance within which anything better than the query's k-th candidate lies."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kth = b.column("kth").cast(pa.float64()).to_numpy(zero_copy_only=False)
            norm2 = np.array([float(np.dot(v, v)) for v in map(np.asarray, b.column("v").to_pylist())])
            far = np.where(np.isnan(kth), np.inf, model.reach(norm2, np.nan_to_num(kth)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("query_id", "dim", "v", "chunk")] + [pa.array(far)],
                                             names=["query_id", "dim", "v", "chunk", "bound"])

    return bound


def op2_pivot_topk(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
