"""Outliers and missing-value treatment.

Statistics are computed once for all columns (one distributed sort for the
quantiles, one aggregation for means, one grouped count for modes and level
shares) and applied back as literal expressions (numbers per column) or as
bounded level lists; nothing grows with the row count on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.exprs import trunc_to_int
from tabulon.functions.ranking import column_modes, exact_quantiles
from tabulon.operators._mlbase import ColumnsEstimator, ColumnsModel
from tabulon.operators.profile import n_rows


# ----------------------------------------------------------------- E01 - E04
def outlier_limits(df: DataFrame, cols: Sequence[str], q1: float = 0.25, q3: float = 0.75,
                   k: float = 1.5, approx: bool = False) -> DataFrame:
    """(feature, low, up) with low = q1 - k*IQR, up = q3 + k*IQR (interpolated quantiles)."""
    q = exact_quantiles(df, cols, [q1, q3], approx=approx)
    w = q.groupBy("feature").agg(F.max(F.when(F.col("prob") == q1, F.col("value"))).alias("qa"),
                                 F.max(F.when(F.col("prob") == q3, F.col("value"))).alias("qb"))
    iqr = F.col("qb") - F.col("qa")
    return w.select("feature", (F.col("qa") - k * iqr).alias("low"), (F.col("qb") + k * iqr).alias("up"))


def _long_with_limits(df: DataFrame, cols: Sequence[str], limits: DataFrame, keep: Sequence[str] = ()):
    from tabulon.functions.ranking import unpivot_values
    long = unpivot_values(df, cols, keep=keep)
    # limits: one row per column, the bound of this broadcast
    return long.join(F.broadcast(limits), "feature")


def has_outliers(df: DataFrame, cols: Sequence[str], q1: float = 0.25, q3: float = 0.75,
                 k: float = 1.5, limits: DataFrame | None = None) -> DataFrame:
    """Per column whether any row lies outside the limits, and how many."""
    lim = limits if limits is not None else outlier_limits(df, cols, q1, q3, k)
    j = _long_with_limits(df, cols, lim)
    out = (F.col("v") > F.col("up")) | (F.col("v") < F.col("low"))
    g = j.groupBy("feature").agg(F.count_if(out).alias("n_outside"))
    names = df.sparkSession.createDataFrame([(x,) for x in cols], "feature string")
    return names.join(g, "feature", "left").select(
        "feature", (F.coalesce("n_outside", F.lit(0)) > 0).cast("int").alias("has_outliers"),
        F.coalesce("n_outside", F.lit(0)).alias("n_outside"))


def outlier_columns(df: DataFrame, cols: Sequence[str], q1: float = 0.25, q3: float = 0.75,
                    k: float = 1.5) -> DataFrame:
    """Names of the columns with outliers."""
    return has_outliers(df, cols, q1, q3, k).where(F.col("has_outliers") == 1).select("feature")


def outlier_rows(df: DataFrame, col: str, key: str, q1: float = 0.25, q3: float = 0.75,
                 k: float = 1.5) -> DataFrame:
    """The rows outside the limits of ``col`` (key + value); the key replaces the pandas index."""
    lim = outlier_limits(df, [col], q1, q3, k).first()  # two numbers from one distributed sort
    return df.where((F.col(col) < F.lit(lim["low"])) | (F.col(col) > F.lit(lim["up"]))).select(key, col)


# ----------------------------------------------------------------- E05 / E06
class _CapParams(Params):
    q1 = Param(Params._dummy(), "q1", "lower quantile", typeConverter=TypeConverters.toFloat)
    q3 = Param(Params._dummy(), "q3", "upper quantile", typeConverter=TypeConverters.toFloat)
    k = Param(Params._dummy(), "k", "IQR multiplier", typeConverter=TypeConverters.toFloat)
    mode = Param(Params._dummy(), "mode", "'both' (int-truncated bounds) or 'upper' (half-even rounded bound)",
                 typeConverter=TypeConverters.toString)


class OutlierCapperModel(ColumnsModel, _CapParams):
    def _transform(self, dataset):
        lim = self._state()
        mode = self.getOrDefault(self.mode)
        exprs = []
        for f in dataset.schema.fields:
            name = f.name
            if name in lim:
                lo, up = lim[name]
                x = F.col(name)
                if mode == "upper":
                    e = F.when(x > F.lit(up), F.bround(F.lit(up), 0)).otherwise(x)
                else:
                    e = (F.when(x < F.lit(lo), trunc_to_int(F.lit(lo)))
                         .when(x > F.lit(up), trunc_to_int(F.lit(up))).otherwise(x))
                exprs.append(e.cast(f.dataType).alias(name))
            else:
                exprs.append(F.col(f"`{name}`"))
        return dataset.select(*exprs)


class OutlierCapper(ColumnsEstimator, _CapParams):
    """E05 (``mode='both'``): clip both sides to ``int(limit)``; E06 (``mode='upper'``):
    clip the upper side to ``round(limit)``.  Missing values stay missing."""

    model_class = OutlierCapperModel

    def _defaults(self):
        return dict(q1=0.25, q3=0.75, k=1.5, mode="both")

    def _extra_params(self):
        return ["q1", "q3", "k", "mode"]

    def _fit_state(self, df):
        lim = outlier_limits(df, self.getInputCols(), self.getOrDefault(self.q1), self.getOrDefault(self.q3),
                             self.getOrDefault(self.k))
        return {r["feature"]: [r["low"], r["up"]] for r in lim.collect()}  # one row per column


def cap_outliers(df: DataFrame, cols: Sequence[str], q1: float = 0.25, q3: float = 0.75, k: float = 1.5,
                 mode: str = "both") -> DataFrame:
    return OutlierCapper(inputCols=list(cols), q1=q1, q3=q3, k=k, mode=mode).fit(df).transform(df)


# ----------------------------------------------------------------- E07, E08, E10, E12 - E14
def fill_constant(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """Fill missing with a constant (e.g. 'No' for "feature absent" columns)."""
    return df.na.fill(value, list(cols))


def fill_from_column(df: DataFrame, col: str, other: str) -> DataFrame:
    """``a.fillna(b)``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.col(other).cast(df.schema[col].dataType)))


def fill_median_of_other(df: DataFrame, col: str, other: str) -> DataFrame:
    """Missing ``col`` gets the median of ``other``."""
    med = exact_quantiles(df, [other], [0.5]).first()["value"]  # one number from one distributed sort
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(med).cast(df.schema[col].dataType)))


def value_to_null(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """A sentinel value becomes missing."""
    return df.select(*[F.nullif(F.col(x), F.lit(value)).alias(x) if x in cols else F.col(f"`{x}`")
                       for x in df.columns])


def conditional(cond, a, b):
    """``np.where(cond, a, b)``."""
    return F.when(cond, a).otherwise(b)


def add_constant(df: DataFrame, cols: Sequence[str], eps: float = 1e-10) -> DataFrame:
    """Add a small constant to numeric columns."""
    return df.select(*[(F.col(x) + F.lit(eps)).alias(x) if x in cols else F.col(f"`{x}`") for x in df.columns])


# ----------------------------------------------------------------- E09 / E11 as Estimators
class MeanImputerModel(ColumnsModel):
    def _transform(self, dataset):
        means = self._state()
        return dataset.select(*[
            F.coalesce(F.col(x), F.lit(means[x]).cast(dataset.schema[x].dataType)).alias(x) if x in means
            else F.col(f"`{x}`") for x in dataset.columns])


class MeanImputer(ColumnsEstimator):
    """Fill numeric columns with their mean (one aggregation for all columns)."""

    model_class = MeanImputerModel

    def _fit_state(self, df):
        cols = self.getInputCols()
        row = df.agg(*[F.avg(F.col(x).cast("double")).alias(x) for x in cols]).first()
        return {x: row[x] for x in cols}


class ModeImputerModel(ColumnsModel):
    def _transform(self, dataset):
        modes = self._state()
        return dataset.select(*[
            F.coalesce(F.col(x), F.lit(modes[x]).cast(dataset.schema[x].dataType)).alias(x)
            if x in modes and modes[x] is not None else F.col(f"`{x}`") for x in dataset.columns])


class ModeImputer(ColumnsEstimator):
    """Fill with the most frequent value, smallest on ties (``mode()[0]``)."""

    model_class = ModeImputerModel

    def _fit_state(self, df):
        cols = self.getInputCols()
        out = {x: None for x in cols}
        by_type: dict[str, list[str]] = {}
        for x in cols:
            t = df.schema[x].dataType
            key = "string" if isinstance(t, T.StringType) else "double"
            by_type.setdefault(key, []).append(x)
        for vt, group in by_type.items():
            for r in column_modes(df, group, value_type=vt).collect():  # one row per column
                out[r["feature"]] = r["mode"]
        return out


# ----------------------------------------------------------------- E15
class _RareParams(Params):
    rarePerc = Param(Params._dummy(), "rarePerc", "share of all rows below which a level is rare",
                     typeConverter=TypeConverters.toFloat)


class RareEncoderModel(ColumnsModel, _RareParams):
    def _transform(self, dataset):
        keep = self._state()
        exprs = []
        for x in dataset.columns:
            if x in keep:
                c = F.col(x)
                exprs.append(F.when(c.isNull(), c).when(c.isin(keep[x]), c).otherwise(F.lit("Rare")).alias(x))
            else:
                exprs.append(F.col(f"`{x}`"))
        return dataset.select(*exprs)


class RareEncoder(ColumnsEstimator, _RareParams):
    """String levels whose share of **all** rows is below ``rarePerc`` become 'Rare'.

    The state is the list of *frequent* levels per column, at most ``1/rarePerc``
    of them, so it stays small however many rare levels there are.  Columns
    without a rare level are left alone.
    """

    model_class = RareEncoderModel

    def _defaults(self):
        return dict(rarePerc=0.01)

    def _extra_params(self):
        return ["rarePerc"]

    def _fit_state(self, df):
        from tabulon.functions.ranking import unpivot_values
        p = self.getOrDefault(self.rarePerc)
        cols = [x for x in self.getInputCols() if isinstance(df.schema[x].dataType, T.StringType)]
        long = unpivot_values(df, cols, value_type="string", val="level")
        counts = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("cnt"))
        share = F.col("cnt") / n_rows(df)
        per = counts.groupBy("feature").agg(
            F.collect_list(F.when(share >= p, F.col("level"))).alias("frequent"),
            F.count_if(share < p).alias("n_rare"))
        # one row per column, at most 1/rarePerc frequent levels each
        return {r["feature"]: sorted(r["frequent"]) for r in per.collect() if r["n_rare"] > 0}


def rare_encode(df: DataFrame, cols: Sequence[str], rare_perc: float = 0.01) -> DataFrame:
    return RareEncoder(inputCols=list(cols), rarePerc=rare_perc).fit(df).transform(df)
