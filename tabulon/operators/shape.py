"""Projection, filters, joins, set operations and reshaping."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.exprs import any_null, ne_keep_null


# ----------------------------------------------------------------- B01 - B05, B08
def cast_columns(df: DataFrame, cols: Sequence[str], to: str = "string") -> DataFrame:
    """Cast columns in place (e.g. int codes to string categories)."""
    return df.select(*[F.col(x).cast(to).alias(x) if x in cols else F.col(f"`{x}`") for x in df.columns])


def fill_then_cast(df: DataFrame, col: str, other: str, to: str = "int") -> DataFrame:
    """``a.fillna(b).astype(int)``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.col(other)).cast(to))


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lenient parse; text that is not a number becomes NULL (``errors='coerce'``)."""
    return df.select(*[F.trim(F.col(x)).try_cast("double").alias(x) if x in cols else F.col(f"`{x}`")
                       for x in df.columns])


def to_timestamp(df: DataFrame, name_part: str = "date", fmt: str | None = None) -> DataFrame:
    """Every column whose name holds ``name_part`` parsed leniently to a timestamp."""
    def parse(x):
        c = F.col(x).cast("string")
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.select(*[parse(x).alias(x) if name_part in x else F.col(f"`{x}`") for x in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop by list; unknown names are ignored."""
    return df.drop(*cols)


def append_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Many computed columns in one projection (never a ``withColumn`` loop)."""
    return df.select("*", *[e.alias(n) for n, e in exprs.items()])


# ----------------------------------------------------------------- B09 - B15
def filter_equal(df: DataFrame, col: str, value, select: Sequence[str] | None = None) -> DataFrame:
    """Rows where ``col == value`` (then optionally a few columns)."""
    out = df.where(F.col(col) == F.lit(value))
    return out.select(*select) if select else out


def not_equal_keep_null(df: DataFrame, col: str, value) -> DataFrame:
    """``df[df[c] != v]`` -- rows with a missing ``c`` are kept."""
    return df.where(ne_keep_null(col, value))


def rows_with_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with any missing value."""
    return df.where(any_null(cols or df.columns))


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``dropna()``."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a target, rows to score)."""
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())


def filter_isin(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Membership; a literal list becomes ``isin``, a DataFrame of values a semi join."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias("__v")).distinct()
        return df.join(v, F.col(col) == F.col("__v"), "left_semi")
    return df.where(F.col(col).isin(list(values)))


def head(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """First n rows by key order (``TakeOrderedAndProject``, a top-n, not a global sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def tail(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """Last n rows by key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


# ----------------------------------------------------------------- C01 / C02
def outer_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join in which missing keys match each other; keys coalesced.

    Planned as ``a LEFT JOIN b`` plus ``b LEFT ANTI a``: both are shuffle joins
    whose streamed side AQE can split when one key holds a large share of the
    rows (a plain full outer join cannot be split), and both reuse the same
    key partitioning of ``b``.
    """
    keys = list(keys)
    rb = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c) for c in b.columns if c not in keys])
    cond = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    a_cols = [c for c in a.columns if c not in keys]
    b_cols = [c for c in b.columns if c not in keys]
    left = a.join(rb, cond, "left").select(*keys, *a_cols, *b_cols)
    only_b = rb.join(a.select(*keys), reduce(operator.and_, [F.col(f"__r_{k}").eqNullSafe(F.col(k)) for k in keys]),
                     "left_anti")
    right = only_b.select(*[F.col(f"__r_{k}").alias(k) for k in keys],
                          *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a_cols], *b_cols)
    return left.unionByName(right)


def concat_rows(*frames: DataFrame, source_col: str | None = None,
                sources: Sequence[str] | None = None) -> DataFrame:
    """Union by column name; columns missing on one side are NULL (bag semantics).

    ``source_col`` tags each row with the name of its input (for D13).
    """
    out = None
    for i, f in enumerate(frames):
        if source_col:
            f = f.withColumn(source_col, F.lit(sources[i] if sources else str(i)))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


# ----------------------------------------------------------------- C03, C05 - C07
def pivot_mean(df: DataFrame, index: Sequence[str], columns: str, values: str,
               levels: Sequence) -> DataFrame:
    """Mean of ``values`` per index keys x ``columns`` level, one column per level
    (named by the level as a string).  Groups with a missing index key are dropped."""
    keep = reduce(operator.and_, [F.col(k).isNotNull() for k in index])
    names = [str(v) for v in levels]
    return (df.where(keep).withColumn("__c", F.col(columns).cast("string"))
            .groupBy(*index).pivot("__c", names).agg(F.avg(F.col(values).cast("double"))))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var_name, value_name)


def crosstab_normalized(df: DataFrame, a: str, b: str, b_levels: Sequence) -> DataFrame:
    """Row-normalised contingency table (``crosstab(normalize='index')``)."""
    names = [str(v) for v in b_levels]
    t = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
         .withColumn("__b", F.col(b).cast("string")).groupBy(a).pivot("__b", names).count().na.fill(0, names))
    total = reduce(operator.add, [F.col(f"`{n}`") for n in names])
    return t.select(a, *[(F.col(f"`{n}`") / total).alias(n) for n in names])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts behind a mosaic plot, with the share of all counted rows."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))
    total = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.count(F.lit(1))).scalar()
    return g.select(a, b, "count", (F.col("count") / total).alias("share"))


# ----------------------------------------------------------------- H01 - H04
def window_mean(df: DataFrame, target: str, keys: Sequence[str], name: str) -> DataFrame:
    """Whole-partition window mean (``transform('mean')``) as an aggregation joined back
    on the keys (see :func:`tabulon.operators.features.group_means`)."""
    from tabulon.operators.features import group_means
    return group_means(df, target, [list(keys)], [name])


def sort_report(df: DataFrame, value: str, name: str, ascending: bool = False) -> DataFrame:
    """A report sorted by value, the name as tie-break (a total, repeatable order)."""
    return df.orderBy(F.col(value).asc() if ascending else F.col(value).desc(), F.col(name).asc())


def top_k(df: DataFrame, value: str, n: int, tie: str | None = None) -> DataFrame:
    """The n rows with the largest value (``TakeOrderedAndProject``: per-task top-n, then merged)."""
    order = [F.col(value).desc()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*order).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Levels by descending frequency (missing level dropped), level as tie-break."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), col))
