"""Encoding and scaling as fit/transform Estimators.

MLlib's own stages differ from the reference in ways that change results
(``StandardScaler`` divides by the sample std, ``MinMaxScaler`` maps a constant
column to 0.5, ``OneHotEncoder`` drops the last level, ``StringIndexer`` orders
by frequency), so these are small Estimators of their own.  Fitting is one
aggregation (scalers) or a distinct (encoders); transforming is a projection, or
for label codes a join with their table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.ranking import row_index
from tabulon.operators._mlbase import ColumnsEstimator, ColumnsModel, WithParts
from tabulon.session import scratch_path


def _levels(df: DataFrame, col: str) -> list[str]:
    """Distinct non-null levels of a column as text, in the order of the column's own type."""
    rows = df.select(F.col(col).alias("v")).where("v is not null").distinct().orderBy("v")
    return [r[0] for r in rows.select(F.col("v").cast("string")).collect()]  # as many as the result has columns


# ----------------------------------------------------------------- G01
class LabelEncoderModel(WithParts, ColumnsModel):
    """The codes of a column are a written table (level, code); transforming joins it.  A saved model holds the tables."""

    def _parts(self):
        columns = list(self._state())
        spark = SparkSession.getActiveSession()
        return {"columns": columns}, {f"codes-{i}": spark.read.parquet(self._state()[c]) for i, c in enumerate(columns)}, {}

    @classmethod
    def _from_parts(cls, values, tables, children):
        model = cls()
        model._set_state({c: tables[f"codes-{i}"] for i, c in enumerate(values["columns"])})
        return model

    def _transform(self, dataset):
        out, tables = dataset, self._state()
        for x in dataset.columns:
            if x in tables:
                codes = dataset.sparkSession.read.parquet(tables[x]).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
                out = out.join(codes, F.col(f"`{x}`") == F.col("_level"), "left").drop("_level").withColumn(x, F.col("_code")).drop("_code")
        return out.select(*[F.col(f"`{x}`") for x in dataset.columns])


class LabelEncoder(ColumnsEstimator):
    """Levels in their own order -> 0..n-1 in place (``LabelEncoder``); missing stays missing.

    Any number of levels: they are numbered by the distributed row numbering and
    kept as a table in the shared folder, never as a list.
    """

    model_class = LabelEncoderModel

    def _fit_state(self, df):
        tables = {}
        for x in self.getInputCols():
            levels = df.select(F.col(f"`{x}`").alias("level")).where("level is not null").distinct()
            tables[x] = scratch_path(df.sparkSession, f"levels-{len(tables)}")
            row_index(levels, ["level"], name="code", tiebreak=False).withColumn("code", F.col("code").cast("int")).write.parquet(tables[x])
        return tables


def binary_string_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Non-numeric columns with exactly two distinct values (the reference's label-encoding target)."""
    from tabulon.operators.profile import is_string
    cand = [x for x in (cols or df.columns) if is_string(df, x)]
    if not cand:
        return []
    row = df.agg(*[F.count_distinct(x).alias(x) for x in cand]).first()
    return [x for x in cand if row[x] == 2]


# ----------------------------------------------------------------- G02
class _OneHotParams(Params):
    dropFirst = Param(Params._dummy(), "dropFirst", "drop the first sorted level",
                      typeConverter=TypeConverters.toBoolean)


def dummy_name(col: str, level: str) -> str:
    return f"{col}_{level}"


class OneHotModel(ColumnsModel, _OneHotParams):
    def _transform(self, dataset):
        lv = self._state()
        drop_first = self.getOrDefault(self.dropFirst)
        exprs = []
        for x in dataset.columns:
            if x not in lv:
                exprs.append(F.col(f"`{x}`"))
                continue
            levels = lv[x][1:] if drop_first else lv[x]
            s = F.col(x).cast("string")
            for v in levels:
                exprs.append(F.when(s == F.lit(v), 1).otherwise(0).alias(dummy_name(x, v)))
        return dataset.select(*exprs)


class OneHotEncoder(ColumnsEstimator, _OneHotParams):
    """One 0/1 column ``col_level`` per level in the order of its own type (first dropped by default);
    a missing value gives an all-zero row, like ``get_dummies``.  The levels are the result's columns, so
    their list is as long as the schema the caller asks for."""

    model_class = OneHotModel

    def _defaults(self):
        return dict(dropFirst=True)

    def _extra_params(self):
        return ["dropFirst"]

    def _fit_state(self, df):
        return {x: _levels(df, x) for x in self.getInputCols()}


# ----------------------------------------------------------------- G03 / G04
class StandardScalerModel(ColumnsModel):
    def _transform(self, dataset):
        st = self._state()
        return dataset.select(*[
            ((F.col(x).cast("double") - F.lit(st[x][0])) / F.lit(st[x][1])).alias(x) if x in st
            else F.col(f"`{x}`") for x in dataset.columns])


class StandardScaler(ColumnsEstimator):
    """(x - mean) / population std; a constant column is divided by 1 (sklearn)."""

    model_class = StandardScalerModel

    def _fit_state(self, df):
        cols = self.getInputCols()
        row = df.agg(*[F.struct(F.avg(F.col(x).cast("double")).alias("m"),
                                F.stddev_pop(F.col(x).cast("double")).alias("s")).alias(x) for x in cols]).first()
        return {x: [row[x]["m"], row[x]["s"] if row[x]["s"] else 1.0] for x in cols}


class MinMaxScalerModel(ColumnsModel):
    def _transform(self, dataset):
        st = self._state()
        return dataset.select(*[
            ((F.col(x).cast("double") - F.lit(st[x][0])) / F.lit(st[x][1])).alias(x) if x in st
            else F.col(f"`{x}`") for x in dataset.columns])


class MinMaxScaler(ColumnsEstimator):
    """(x - min) / (max - min) into [0, 1]; a constant column maps to 0 (sklearn)."""

    model_class = MinMaxScalerModel

    def _fit_state(self, df):
        cols = self.getInputCols()
        row = df.agg(*[F.struct(F.min(F.col(x).cast("double")).alias("lo"),
                                F.max(F.col(x).cast("double")).alias("hi")).alias(x) for x in cols]).first()
        out = {}
        for x in cols:
            lo, hi = row[x]["lo"], row[x]["hi"]
            rng = (hi - lo) if lo is not None and hi is not None and hi != lo else 1.0
            out[x] = [lo, rng]
        return out
