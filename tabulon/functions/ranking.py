"""Distributed order statistics: row positions, running sums, exact quantiles, modes.

A global window (``Window.orderBy`` without ``partitionBy``) moves every row to
one task.  These helpers get the same answers from a range-partitioned sort
whose result is first written as a table in the shared folder
(``spark.checkpoint.dir``):

1. ``repartitionByRange`` on the sort key (plus a row tiebreak, so that a value
   that holds a third of the rows is still spread over many tasks), sorted
   inside each range, with the range's number and the row's number in it;
2. the written table is what both later steps read, so positions do not depend
   on whether Spark reuses an exchange, samples the same boundaries twice or
   runs a task again;
3. a per-(range, group) table of counts turns numbers in a range into global
   ones.  A range holds a contiguous stretch of keys, so that table has at most
   ``ranges + groups`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import scratch_path

_LOCAL_BITS = 33


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _frozen_sort(df: DataFrame, keys: Sequence[str], num_partitions: int | None, tiebreak: bool) -> DataFrame:
    """``df`` in key order as a written table: ``_pid`` numbers the range, ``_mid`` the row."""
    keys = list(keys)
    d = df
    if tiebreak:
        d = d.withColumn("_tb", F.monotonically_increasing_id())
        keys = keys + ["_tb"]
    d = (d.repartitionByRange(_num_partitions(df, num_partitions), *keys).sortWithinPartitions(*keys)
         .withColumn("_mid", F.monotonically_increasing_id())
         .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)))
    if tiebreak:
        d = d.drop("_tb")
    path = scratch_path(df.sparkSession, "sorted")
    d.write.parquet(path)
    return df.sparkSession.read.schema(d.schema).parquet(path)


def _ranked(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str],
            name: str, num_partitions: int | None, tiebreak: bool) -> DataFrame:
    groups = list(group_cols)
    d = _frozen_sort(df, groups + list(order_cols), num_partitions, tiebreak)
    stats = d.groupBy("_pid", *groups).agg(F.min("_mid").alias("_first"),
                                          F.count(F.lit(1)).alias("_cnt"))
    spec = Window.partitionBy(*groups) if groups else Window.partitionBy()
    before = spec.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    same = F.lit(True)
    side = stats.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_first", "_off")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = d.join(side, (F.col("_pid") == F.col("_p")) & same, "inner")
    out = out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first"))
    return out.select(*df.columns, name)


def running_sums(df: DataFrame, order_cols: Sequence[str], sums: Sequence[str], name: str = "_rn",
                 num_partitions: int | None = None) -> DataFrame:
    """0-based position ``name`` and, for each column s of ``sums``, ``{s}_before``: the sum of the rows before.

    ``order_cols`` should identify a row; rows equal in all of them follow one another in some order.
    """
    d = _frozen_sort(df, order_cols, num_partitions, False)
    per = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    off = per.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                     *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums])
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("_in", F.row_number().over(Window.partitionBy("_pid").orderBy("_mid")) - 1)
    for s in sums:
        out = out.withColumn(f"_in_{s}", F.coalesce(F.sum(s).over(inside), F.lit(0)))
    out = out.join(off, F.col("_pid") == F.col("_p"))
    return out.select(*df.columns, (F.col("_off") + F.col("_in")).alias(name),
                      *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"{s}_before") for s in sums])


def row_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
              name: str = "_rn", num_partitions: int | None = None,
              tiebreak: bool = True) -> DataFrame:
    """0-based position of each row within its group in ``order_cols`` order.

    Ties in ``order_cols`` are broken by a per-row id; callers that need tie
    groups (average ranks) aggregate the positions afterwards.
    """
    return _ranked(df, order_cols, group_cols, name, num_partitions, tiebreak)


def unpivot_values(df: DataFrame, cols: Sequence[str], value_type: str = "double",
                   keep: Sequence[str] = (), var: str = "feature", val: str = "v",
                   drop_null: bool = True) -> DataFrame:
    """Long form (column, v) of the given columns cast to one type."""
    cast = df.select(*keep, *[F.col(x).cast(value_type).alias(x) for x in cols])
    long = cast.unpivot(list(keep), list(cols), var, val)
    return long.where(F.col(val).isNotNull()) if drop_null else long


class _Bracket:
    """Limits that hold the ranks of one (column, prob), and the rows below and inside them."""

    def __init__(self, col: str, prob: float, n: int):
        self.col, self.prob = col, prob
        h = (n - 1) * prob
        self.low_rank, self.high_rank, self.fraction = math.floor(h), math.ceil(h), h - math.floor(h)
        self.lo, self.hi, self.below, self.inside = -math.inf, math.inf, 0, n

    def holds(self, below: int, inside: int) -> bool:
        return below <= self.low_rank and self.high_rank < below + inside


def _value(col: str):
    """The column as double; NaN counts as missing."""
    v = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(v), v)


def _aggregated(df: DataFrame, exprs: list, at_once: int = 64) -> list:
    """Values of many aggregates, some at a time so that each plan stays small."""
    out = []
    for k in range(0, len(exprs), at_once):
        out += list(df.agg(*[e.alias(f"a{j}") for j, e in enumerate(exprs[k:k + at_once])]).first())
    return out


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """One sketch pass proposes narrower limits, one counting pass accepts those that hold the ranks."""
    margin = 2.0 / accuracy
    asked = []
    for b in brackets:
        v = _value(b.col)
        span = max(b.inside - 1, 1)
        probs = [max(0.0, (b.low_rank - b.below) / span - margin), min(1.0, (b.high_rank - b.below) / span + margin)]
        asked.append(F.percentile_approx(F.when(v.between(b.lo, b.hi), v), probs, accuracy))
    limits = _aggregated(df, asked)
    counts = []
    for b, (lo, hi) in zip(brackets, limits, strict=True):
        v = _value(b.col)
        counts += [F.count_if(v < lo), F.count_if(v.between(lo, hi))]
    found = _aggregated(df, counts)
    for b, (lo, hi), below, inside in zip(brackets, limits, found[::2], found[1::2], strict=True):
        if b.holds(below, inside):
            b.lo, b.hi, b.below, b.inside = lo, hi, below, inside


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    approx: bool = False, accuracy: int = 10000, inside_rows: int = 100_000) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``) of many columns.

    Result: one row per (column, prob) with ``value``.  Exact without sorting the
    column: a sketch brackets each quantile, a count of the rows below and inside
    checks that the bracket holds its ranks (else the wider one stays), which
    repeats until few rows are inside; only their distinct values are then grouped
    and read off by rank.  ``approx=True`` returns the sketch's value.
    """
    probs = [float(q) for q in probs]
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(x).cast("double"), probs, accuracy).alias(x)
                       for x in cols])
        long = row.unpivot([], list(cols), "feature", "vals")
        return long.select("feature", F.posexplode("vals").alias("i", "value")).select(
            "feature", F.element_at(F.array(*[F.lit(q) for q in probs]), F.col("i") + 1).alias("prob"),
            "value")
    sizes = _aggregated(df, [F.count(_value(x)) for x in cols])
    brackets = [_Bracket(x, q, n) for x, n in zip(cols, sizes, strict=True) if n for q in probs]
    for _ in range(6):
        wide = [b for b in brackets if b.inside > inside_rows and b.lo < b.hi]
        if not wide:
            break
        _narrow(df, wide, accuracy)
    spark = df.sparkSession
    limits = spark.createDataFrame([(b.col, b.prob, b.lo, b.hi, b.low_rank - b.below, b.high_rank - b.below, b.fraction) for b in brackets],
                                   "feature string, prob double, lo double, hi double, r_lo long, r_hi long, fraction double")
    long = df.select(*[_value(x).alias(x) for x in dict.fromkeys(cols)]).unpivot([], list(dict.fromkeys(cols)), "feature", "v")
    # columns x probs rows: bounded by the call
    inside = long.where(F.col("v").isNotNull()).join(F.broadcast(limits), "feature").where("v between lo and hi")
    key = ["feature", "prob", "r_lo", "r_hi", "fraction"]
    counts = inside.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature", "prob").orderBy("v"))
    ranked = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))

    def at(rank: str):
        return F.max(F.when((F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    ends = ranked.groupBy(*key).agg(at("r_lo").alias("low"), at("r_hi").alias("high"))
    return ends.select("feature", "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("fraction")).alias("value"))


def column_modes(df: DataFrame, cols: Sequence[str], value_type: str = "string") -> DataFrame:
    """Most frequent non-null value per column, smallest value on ties (``mode()[0]``).

    Counting is a partial+final aggregation on (column, value), so a hot value
    never lands in one task as rows, only as one count.
    """
    long = unpivot_values(df, cols, value_type=value_type)
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("v"))).alias("m"))
    return best.select("feature", F.col("m.v").alias("mode"), (-F.col("m.neg")).alias("count"))


__all__ = ["row_index", "running_sums", "unpivot_values", "exact_quantiles", "column_modes"]
