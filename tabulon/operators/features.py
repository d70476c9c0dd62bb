"""Feature construction.

Row-wise features are generated as one list of Catalyst expressions and
appended in a single projection.  Group means are a grouped aggregation
(map-side partial sums, so a hot key is one partial row per task) joined back
on the keys: AQE broadcasts the aggregate when it measures small and otherwise
splits a skewed key on the streamed side of the sort-merge join.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.exprs import (c, count_equal, product, row_max, row_mean, row_median, row_min,
                                     row_std, row_sum, safe_ratio, seconds_between)
from tabulon.functions.ranking import exact_quantiles
from tabulon.session import scratch_path


# ----------------------------------------------------------------- F01 - F03
def group_means(df: DataFrame, target: str, key_sets: Sequence[Sequence[str]],
                names: Sequence[str] | None = None, out_of_fold: bool = False, fold: str = "fold") -> DataFrame:
    """for each key set, the target mean of the row's group (``transform('mean')``).

    A row whose key has a missing value gets NULL (pandas drops such groups).
    Several key sets are one aggregation with grouping sets, written once; each
    set's slice of it is then joined.

    With ``out_of_fold`` a row gets the mean of its group's rows in the other folds
    (column ``fold``), so that its own target is not in its feature: the group's sum
    and count less those of its fold.  NULL where the other folds have no target in
    the group; rows without a fold are a fold of their own.
    """
    value = F.col(target).cast("double")
    sums = [F.sum(value).alias("__sum"), F.count(value).alias("__n")]
    every = list(dict.fromkeys(k for keys in key_sets for k in keys))
    folds = [fold] if out_of_fold else []
    if len(key_sets) > 1:
        path = scratch_path(df.sparkSession, "group-means")
        df.groupingSets([[F.col(k) for k in [*keys, *folds]] for keys in key_sets], *[F.col(k) for k in [*every, *folds]]).agg(
            F.grouping_id().alias("__set"), *sums).write.parquet(path)
        table = df.sparkSession.read.parquet(path)
    out = df
    for i, keys in enumerate(key_sets):
        keys = list(keys)
        name = names[i] if names else "mean_" + "_".join(keys) + f"_{target}"
        valid = reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
        if len(key_sets) > 1:
            left_out = int("".join("0" if k in keys else "1" for k in every) + "0" * len(folds), 2)
            g = table.where(valid & (F.col("__set") == left_out)).select(*keys, *folds, "__sum", "__n").distinct()
        else:
            g = df.where(valid).groupBy(*keys, *folds).agg(*sums)
        if not out_of_fold:
            out = out.join(g.select(*keys, F.try_divide("__sum", "__n").alias(name)), keys, "left")
            continue
        # a row for each (group, fold): a hot group is as many keys as there are folds
        whole = Window.partitionBy(*keys)
        others = g.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col(fold).alias("__fold"),
                          (F.coalesce(F.sum("__sum").over(whole), F.lit(0.0)) - F.coalesce("__sum", F.lit(0.0))).alias("__s"),
                          (F.sum("__n").over(whole) - F.col("__n")).alias("__c"))
        others = others.select(*[f"__k{j}" for j in range(len(keys))], "__fold", F.try_divide("__s", "__c").alias("__mean"))
        same = reduce(operator.and_, [F.col(k) == F.col(f"__k{j}") for j, k in enumerate(keys)]) & F.col(fold).eqNullSafe(F.col("__fold"))
        out = out.join(others, same, "left").select(*out.columns, F.col("__mean").alias(name))
    return out


def group_mean(df: DataFrame, target: str, keys: str | Sequence[str], name: str | None = None, out_of_fold: bool = False,
               fold: str = "fold") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return group_means(df, target, [keys], [name] if name else None, out_of_fold, fold)


def cross_group_means(df: DataFrame, target: str, important: Sequence[str], low: Sequence[str], out_of_fold: bool = False,
                      fold: str = "fold") -> DataFrame:
    """group mean for every (1 important + 2 low) column combination."""
    sets = [[i, a, b] for i in important for a, b in combinations(low, 2)]
    return group_means(df, target, sets, [f"{i}_{a}_{b}_mean_{target}" for i, a, b in sets], out_of_fold, fold)


# ----------------------------------------------------------------- F04 / F05
def row_stats(df: DataFrame, cols: Sequence[str], stats: Iterable[str] = ("mean",),
              prefix: str = "") -> DataFrame:
    """row-wise mean/std/min/max/sum/median, missing values skipped."""
    fns = {"mean": row_mean, "std": row_std, "min": row_min, "max": row_max, "sum": row_sum,
           "median": row_median}
    return df.select("*", *[fns[s](list(cols)).alias(f"{prefix}{s}") for s in stats])


# ----------------------------------------------------------------- F06 - F09
def products(df: DataFrame, groups: Sequence[Sequence[str]], names: Sequence[str] | None = None) -> DataFrame:
    """product of 2 or 3 columns each (in double)."""
    return df.select("*", *[product(g).alias(names[i] if names else "_x_".join(g)) for i, g in enumerate(groups)])


def ratio(a: str | Column, b: str | Column, eps: float = 0.0) -> Column:
    """``a / (b + eps)`` (NULL instead of inf when the denominator is 0)."""
    return safe_ratio(a, b, eps)


def chained_ratio(a, b, cc, eps: float = 1e-5) -> Column:
    """``a / (b + eps) / (c + eps)``."""
    return F.try_divide(safe_ratio(a, b, eps), c(cc).cast("double") + F.lit(eps))


# ----------------------------------------------------------------- F10 - F13
def pair_features(df: DataFrame, cols: Sequence[str], methods: Sequence[str] = ("mul", "add", "sub"),
                  prefix: str = "", both_directions: bool = False, eps: float = 1e-5) -> DataFrame:
    """for every pair (i < j): ``_x_`` product, ``_plus_`` sum, ``_minus_`` difference
    and, with ``div``, ``_div_`` ratios; ``both_directions`` adds j-i and j/i."""
    exprs = []
    for a, b in combinations(cols, 2):
        A, B = F.col(a).cast("double"), F.col(b).cast("double")
        for m in methods:
            if m == "mul":
                exprs.append((A * B).alias(f"{prefix}{a}_x_{b}"))
            elif m == "add":
                exprs.append((A + B).alias(f"{prefix}{a}_plus_{b}"))
            elif m == "sub":
                exprs.append((A - B).alias(f"{prefix}{a}_minus_{b}"))
                if both_directions:
                    exprs.append((B - A).alias(f"{prefix}{b}_minus_{a}"))
            elif m == "diff":
                exprs.append((A - B).alias(f"{prefix}{a}_{b}_diff"))
            elif m == "div":
                exprs.append(safe_ratio(A, B, eps).alias(f"{prefix}{a}_div_{b}"))
                if both_directions:
                    exprs.append(safe_ratio(B, A, eps).alias(f"{prefix}{b}_div_{a}"))
            else:
                raise ValueError(m)
    return df.select("*", *exprs)


def triple_features(df: DataFrame, cols: Sequence[str], methods: Sequence[str] = ("mean",),
                    eps: float = 1e-5) -> DataFrame:
    """for every triple (i < j < k): row mean, product, chained ratios, chained differences."""
    exprs = []
    for a, b, d in combinations(cols, 3):
        A, B, D = (F.col(x).cast("double") for x in (a, b, d))
        for m in methods:
            if m == "mean":
                exprs.append(row_mean([a, b, d]).alias(f"{a}_{b}_{d}_mean"))
            elif m == "prod":
                exprs.append((A * B * D).alias(f"{a}_{b}_{d}_prod"))
            elif m == "div":
                exprs.append(chained_ratio(A, B, D, eps).alias(f"{a}_div_{b}_div_{d}"))
                exprs.append(chained_ratio(D, B, A, eps).alias(f"{d}_div_{b}_div_{a}"))
            elif m == "sub":
                exprs.append((A - B - D).alias(f"{a}_minus_{b}_minus_{d}"))
                exprs.append((D - B - A).alias(f"{d}_minus_{b}_minus_{a}"))
            elif m == "mul":
                exprs.append((A * B * D).alias(f"{a}_times_{b}_times_{d}"))
            else:
                raise ValueError(m)
    return df.select("*", *exprs)


# ----------------------------------------------------------------- F14 / F15
def range_bins(x: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True) -> Column:
    """right-closed bins ``(e_i, e_i+1]`` (first bin closed on the left); NULL outside."""
    col = c(x)
    out = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((col >= lo) if (i == 0 and include_lowest) else (col > lo)) & (col <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def quantile_bins(df: DataFrame, col: str, q: int, labels: Sequence[str] | None = None,
                  name: str | None = None) -> DataFrame:
    """``qcut`` -- equal-frequency bins from interpolated quantile edges, right-closed,
    lowest edge included.  The q-1 edges come from one distributed sort; duplicate
    edges raise like pandas."""
    probs = [i / q for i in range(1, q)]
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, [col], probs).collect()}  # q-1 numbers
    edges = [got[p] for p in probs]
    if len(set(edges)) < len(edges):
        raise ValueError(f"Bin edges must be unique: {edges}")
    x = F.col(col)
    bucket = None
    for i, e in enumerate(edges):
        bucket = F.when(x <= F.lit(e), F.lit(i)) if bucket is None else bucket.when(x <= F.lit(e), F.lit(i))
    bucket = bucket.when(x.isNotNull(), F.lit(q - 1))
    name = name or f"{col}_qbin"
    out = df.select("*", bucket.cast("int").alias(name))
    if labels:
        out = out.withColumn(f"{name}_label", F.element_at(F.array(*[F.lit(v) for v in labels]), F.col(name) + 1))
    return out


# ----------------------------------------------------------------- F16 - F19
def flag(cond: Column) -> Column:
    """F16: 1 if the condition holds else 0; a missing operand counts as not holding."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_equal_to(cols: Sequence[str], value) -> Column:
    """how many of ``cols`` equal ``value``."""
    return count_equal(cols, value)


def map_codes(x: str | Column, codes: Sequence, inside: str, outside: str) -> Column:
    """a label for membership in a code list, another label for the rest."""
    return F.when(c(x).isin(list(codes)), F.lit(inside)).otherwise(F.lit(outside))


def concat_codes(a: str | Column, b: str | Column, sep: str = "_") -> Column:
    """``a.astype(str) + '_' + b``; NULL when either side is missing."""
    return F.concat(c(a).cast("string"), F.lit(sep), c(b).cast("string"))


# ----------------------------------------------------------------- F20 - F22
def rfm(df: DataFrame, first: str, last: str, orders: Sequence[str], values: Sequence[str],
        days_after: int = 2) -> DataFrame:
    """recency = (latest ``last`` + days_after) - last, tenure = last - first (both in
    seconds and whole days), frequency = sum of ``orders``, monetary = sum of ``values``.

    The latest date is a scalar subquery, so no join or driver round trip.
    """
    latest = df.select(F.max(F.col(last))).scalar()
    analysis = latest + F.expr(f"INTERVAL {int(days_after)} DAYS")
    rec = seconds_between(analysis, F.col(last))
    ten = seconds_between(F.col(last), F.col(first))
    return df.select(
        "*",
        rec.alias("recency_seconds"), F.floor(rec / 86400).cast("int").alias("recency"),
        ten.alias("tenure_seconds"), F.floor(ten / 86400).cast("int").alias("tenure"),
        reduce(operator.add, [F.col(x) for x in orders]).alias("frequency"),
        reduce(operator.add, [F.col(x) for x in values]).alias("monetary"))


def log1p_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``np.log1p`` in place."""
    return df.select(*[F.log1p(F.col(x)).alias(x) if x in cols else F.col(f"`{x}`") for x in df.columns])


def expm1_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``np.expm1`` in place."""
    return df.select(*[F.expm1(F.col(x)).alias(x) if x in cols else F.col(f"`{x}`") for x in df.columns])
