"""Sources and sinks (A01-A03) plus the null rule of the library.

Rule: missing values are NULL.  NaN never enters a table (pandas folds NaN and
NULL together, Spark keeps them apart), so every reader passes doubles through
:func:`nan_to_null`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens a CSV reader treats as missing (pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (one projection)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def _string_na_to_null(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    toks = list(tokens)
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            exprs.append(F.when(F.col(f.name).isin(toks), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               sep: str = ",", na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Header CSV with missing-value tokens folded to NULL.

    Pass ``schema`` in production; without it the reader infers types (one
    extra pass, exploration only).  Numeric columns go through the reader's
    ``nullValue``/lenient parsing; string columns get the full token list.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "NA")
    reader = reader.option("nanValue", "NaN").option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    return nan_to_null(_string_na_to_null(df, na_tokens))


def read_semicolon_table(spark: SparkSession, path: str,
                         schema: T.StructType | str | None = None) -> DataFrame:
    """``;``-separated file; Spark drops a UTF-8 BOM from the header."""
    return read_table(spark, path, schema=schema, sep=";")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, register: bool = False) -> dict[str, DataFrame]:
    """All driver tables; optionally registered as temp views of the same name."""
    out = {}
    for name in DRIVER_TABLES:
        df = table(spark, sf_dir, name)
        if register:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def write_predictions(df: DataFrame, path: str, key: str, prediction: str,
                      mode: str = "overwrite") -> None:
    """Key + prediction as header CSV, no index column.

    Written in parallel part files; a consumer that needs a single file can
    concatenate them (the header is repeated only if it is asked for).
    """
    df.select(key, prediction).write.mode(mode).option("header", True).csv(path)
