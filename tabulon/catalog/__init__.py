"""Query catalog: every operator of the inventory run on the driver tables.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` registered under
``<id>_<name>`` together with its DuckDB twin SQL (``None`` for fitted models
and other rows-only checks).  Doubles are rounded to 4 decimals on both sides
so that summation order does not change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def round_binary(x, scale: int):
    """Round a double the way the DuckDB twin does: half away from zero on ``x * 10^s`` in
    binary floating point, then divide (``F.round`` rounds the decimal text instead,
    which breaks exact ties such as 134.0215625 the other way).  ``+ 0.0`` folds -0.0."""
    m = F.lit(float(10 ** scale))
    return F.signum(x) * F.floor(F.abs(x * m) + F.lit(0.5)) / m + F.lit(0.0)


def rounded(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every floating column as the DuckDB twins do (see :func:`round_binary`)."""
    return df.select(*[
        round_binary(F.col(f"`{f.name}`"), scale).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def R(expr: str, scale: int = 6) -> str:
    """DuckDB side of :func:`rounded`: ``round`` plus ``0.0`` so -0.0 prints as 0.0 like Spark."""
    return f"(round({expr}, {scale}) + 0.0)"


def _load_all():
    from tabulon.catalog import (  # noqa: F401
        q_profile, q_select, q_clean, q_shape, q_features, q_encode, q_evaluate, q_learn,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
