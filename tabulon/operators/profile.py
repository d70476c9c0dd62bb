"""Profiling operators.

Every operator folds all requested columns into one aggregation pass (or one
unpivot + grouped aggregation) and returns a small report DataFrame.  Nothing
is collected: reports are lazy and can be joined, filtered or written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.exprs import skew_g1_to_G1, skewtest_z
from tabulon.functions.ranking import exact_quantiles, unpivot_values

# The quantile list of the numeric summary.
SUMMARY_QUANTILES = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]


def qname(p: float) -> str:
    """Column name of a quantile: 0.05 -> q05, 0.5 -> q50, 0.99 -> q99."""
    return f"q{int(round(p * 100)):02d}"


def _long_stats(df: DataFrame, cols: Sequence[str], aggs: dict) -> DataFrame:
    """One wide ``agg`` of ``{stat: fn(col)}`` for every column, returned one row per column."""
    exprs = [fn(F.col(x)).alias(f"{x}__{name}") for x in cols for name, fn in aggs.items()]
    row = df.agg(*exprs)
    structs = [F.struct(F.lit(x).alias("feature"),
                        *[F.col(f"`{x}__{name}`").alias(name) for name in aggs]) for x in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def n_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery (one value; no join, no driver round trip)."""
    return df.select(F.count(F.lit(1))).scalar()


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# ----------------------------------------------------------------- D01
def table_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with type, row count, missing count and distinct count.

    Exact distinct counts expand every row once a column; with ``approx`` a sketch a column (2 % off) does without.
    """
    cols = df.columns
    dtypes = dict(df.dtypes)
    stats = _long_stats(df, cols, {
        "n_rows": lambda x: F.count(F.lit(1)),
        "n_missing": lambda x: F.count_if(x.isNull()),
        "n_distinct": lambda x: F.approx_count_distinct(x, 0.02) if approx else F.count_distinct(x),
    })
    types = df.sparkSession.createDataFrame([(x, dtypes[x], i) for i, x in enumerate(cols)],
                                            "feature string, dtype string, position int")
    return types.join(F.broadcast(stats), "feature")


# ----------------------------------------------------------------- D02 / D03
def num_summary(df: DataFrame, cols: Sequence[str], quantiles: Sequence[float] = SUMMARY_QUANTILES,
                approx: bool = False) -> DataFrame:
    """Count, mean, sample std, min, quantiles, max per numeric column."""
    mom = _long_stats(df, cols, {
        "count": lambda x: F.count(x),
        "mean": lambda x: F.avg(x.cast("double")),
        "std": lambda x: F.stddev_samp(x.cast("double")),
        "min": lambda x: F.min(x.cast("double")),
        "max": lambda x: F.max(x.cast("double")),
    })
    q = exact_quantiles(df, cols, quantiles, approx=approx)
    names = [qname(p) for p in quantiles]
    wide = (q.withColumn("_k", F.element_at(F.array(*[F.lit(n) for n in names]),
                                             F.array_position(F.array(*[F.lit(float(p)) for p in quantiles]),
                                                              F.col("prob")).cast("int")))
            .groupBy("feature").pivot("_k", names).agg(F.first("value")))
    return mom.join(wide, "feature", "left").select("feature", "count", "mean", "std", "min", *names, "max")


def describe(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """``describe().T`` -- quartiles only."""
    return num_summary(df, cols, [0.25, 0.5, 0.75], approx=approx)


# ----------------------------------------------------------------- D04 / D05
def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with any missing value, ``n_miss`` and ``ratio`` (% of all rows, 2 decimals half-even)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(x).isNull()).alias(x) for x in cols])
    long = row.unpivot(["__n"], cols, "feature", "n_miss")
    return (long.where(F.col("n_miss") > 0)
            .select("feature", "n_miss", F.bround(F.col("n_miss") / F.col("__n") * 100.0, 2).alias("ratio"))
            .orderBy(F.desc("n_miss"), "feature"))


def missing_vs_target(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Mean and non-null count of the target by the missing flag of each column."""
    flags = df.select(F.col(target).cast("double").alias("__t"),
                      *[F.when(F.col(x).isNull(), 1).otherwise(0).alias(x) for x in cols])
    long = flags.unpivot(["__t"], list(cols), "feature", "na_flag")
    return long.groupBy("feature", "na_flag").agg(F.avg("__t").alias("target_mean"),
                                                 F.count("__t").alias("count"))


# ----------------------------------------------------------------- D06 - D10
def _levels_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, level) with every level cast to string; null levels dropped."""
    return unpivot_values(df, cols, value_type="string", keep=keep, val="level")


def cat_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count and percentage of **all** rows per level; the missing level is not listed."""
    counts = _levels_long(df, cols).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("feature", "level", "count", (F.col("count") * 100.0 / n_rows(df)).alias("ratio"))


def target_by_category(df: DataFrame, target: str, cols: Sequence[str], wide: bool = False) -> DataFrame:
    """D07 (``wide=False``): target mean per level.  D08 (``wide=True``): plus target
    count and the share of all rows in percent."""
    long = _levels_long(df.withColumn("__t", F.col(target).cast("double")), cols, keep=["__t"])
    aggs = [F.avg("__t").alias("target_mean")]
    if not wide:
        return long.groupBy("feature", "level").agg(*aggs)
    g = long.groupBy("feature", "level").agg(*aggs, F.count("__t").alias("count"),
                                            F.count(F.lit(1)).alias("__rows"))
    return g.select("feature", "level", "target_mean", "count",
                    (F.col("__rows") * 100.0 / n_rows(df)).alias("ratio"))


def numeric_by_target(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per target class (missing class dropped)."""
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(
        *[F.avg(F.col(x).cast("double")).alias(x) for x in cols])


def rare_analysis(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Per level COUNT, RATIO of all rows (0-1), TARGET_MEAN and the column's level count."""
    long = _levels_long(df.withColumn("__t", F.col(target).cast("double")), cols, keep=["__t"])
    g = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("count"),
                                            F.avg("__t").alias("target_mean"))
    # one row per column: bounded by len(cols)
    nl = g.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"))
    return g.join(F.broadcast(nl), "feature").select(
        "feature", "n_levels", "level", "count", (F.col("count") / n_rows(df)).alias("ratio"), "target_mean")


# ----------------------------------------------------------------- D11
def column_kinds(df: DataFrame, cat_th: int = 10, car_th: int = 20, approx: bool = False) -> DataFrame:
    """Classify each column as ``cat``, ``num`` or ``cardinal``.

    string -> cat; non-string with fewer than ``cat_th`` distinct values -> cat
    (``num_but_cat``); string with more than ``car_th`` distinct -> cardinal.
    One aggregation computes every distinct count (HLL sketch with ``approx``).
    """
    cols = df.columns
    cd = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[cd(F.col(x)).alias(x) for x in cols])
    long = row.unpivot([], cols, "feature", "n_distinct")
    types = df.sparkSession.createDataFrame(
        [(x, is_string(df, x), i) for i, x in enumerate(cols)], "feature string, is_string boolean, position int")
    j = types.join(F.broadcast(long), "feature")
    kind = (F.when(F.col("is_string") & (F.col("n_distinct") > car_th), "cardinal")
            .when(F.col("is_string"), "cat")
            .when(F.col("n_distinct") < cat_th, "cat")
            .otherwise("num"))
    num_but_cat = (~F.col("is_string")) & (F.col("n_distinct") < cat_th)
    return j.select("feature", "position", "n_distinct", kind.alias("kind"),
                    num_but_cat.cast("int").alias("num_but_cat"))


# ----------------------------------------------------------------- D12 / D13 / D14
def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max, last bin closed, empty bins listed."""
    long = unpivot_values(df, cols)
    rng = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(b).cast("int")
    counted = (long.join(F.broadcast(rng), "feature")  # columns rows: bounded
               .select("feature", b.alias("bin")).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counted, ["feature", "bin"], "left")
            .select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("left"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def category_counts_by_source(df: DataFrame, col: str, source: str, sources: Sequence[str]) -> DataFrame:
    """Level counts side by side per source (e.g. train vs test)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).pivot(source, list(sources))
            .agg(F.count(F.lit(1))).na.fill(0, list(sources)))


def sigma_bands(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Mean +- k sample std per column and how many rows fall outside."""
    st = _long_stats(df, cols, {"mean": lambda x: F.avg(x.cast("double")),
                                "std": lambda x: F.stddev_samp(x.cast("double"))})
    st = st.select("feature", "mean", "std", (F.col("mean") - k * F.col("std")).alias("lower"),
                   (F.col("mean") + k * F.col("std")).alias("upper"))
    long = unpivot_values(df, cols)
    out = long.join(F.broadcast(st.select("feature", "lower", "upper")), "feature").groupBy("feature").agg(
        F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("n_outside"))
    return st.join(out, "feature", "left").select("feature", "mean", "std", "lower", "upper",
                                                 F.coalesce("n_outside", F.lit(0)).alias("n_outside"))


# ----------------------------------------------------------------- D16
def skew_test(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Biased skewness g1 (``scipy.stats.skew``), D'Agostino z and two-sided p (``erfc(|z| / sqrt 2)``).

    The p-value is one number a column, taken from ``math.erfc`` after the aggregation.
    """
    st = _long_stats(df, cols, {"n": lambda x: F.count(x), "g1": lambda x: F.skewness(x.cast("double"))})
    rows = st.select("feature", "n", F.col("g1").alias("skew"), skewtest_z(F.col("g1"), F.col("n")).alias("z")).collect()
    return df.sparkSession.createDataFrame(
        [(*r, None if r["z"] is None else math.erfc(abs(r["z"]) / math.sqrt(2.0))) for r in rows],
        "feature string, n long, skew double, z double, p_value double")


def skew_G1(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness G1 (``DataFrame.skew``) per column; 0 for a constant column."""
    st = _long_stats(df, cols, {"n": lambda x: F.count(x), "g1": lambda x: F.skewness(x.cast("double")),
                                "sd": lambda x: F.stddev_pop(x.cast("double"))})
    g = F.when(F.col("sd") == 0, F.lit(0.0)).otherwise(skew_g1_to_G1(F.col("g1"), F.col("n")))
    return st.select("feature", g.alias("skew"))


# ----------------------------------------------------------------- D24
def kde(df: DataFrame, col: str, grid_size: int = 200, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an equal grid over [min, max].

    Bandwidth defaults to Scott's rule ``std * n^(-1/5)`` (the seaborn default).
    Two aggregations: four numbers (n, std, min, max), then one wide aggregation
    with a kernel sum per grid point -- each row feeds ``grid_size`` sums in place,
    so nothing is exploded or shuffled beyond one partial row per task.
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"),
                F.max(x).alias("hi")).first()  # four numbers
    n, lo, hi = st["n"], st["lo"], st["hi"]
    h = float(bandwidth) if bandwidth else st["sd"] * n ** -0.2
    step = (hi - lo) / (grid_size - 1)
    grid = [lo + i * step for i in range(grid_size)]
    sums = df.where(x.isNotNull()).agg(*[
        F.sum(F.exp(F.lit(-0.5 / (h * h)) * (F.lit(g) - x) * (F.lit(g) - x))).alias(f"k{i}")
        for i, g in enumerate(grid)])
    pts = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(g).alias("x"), F.col(f"k{i}").alias("k"))
                    for i, g in enumerate(grid)])
    norm = n * h * (2 * 3.141592653589793) ** 0.5
    return sums.select(F.explode(pts).alias("p")).select(
        "p.point", "p.x", (F.col("p.k") / F.lit(norm)).alias("density"))
