"""Encoding and scaling queries G01-G04 with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, rounded
from tabulon.operators import encode as G
from tabulon.sources.io import table

# The six p_type levels of the driver tables (sorted); the first is dropped.
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("g01_label_encoder", """select l_orderkey, l_linenumber,
  cast(dense_rank() over (order by l_linestatus) - 1 as integer) as l_linestatus,
  cast(dense_rank() over (order by l_returnflag) - 1 as integer) as l_returnflag,
  cast(dense_rank() over (order by l_quantity) - 1 as integer) as l_quantity,
  cast(dense_rank() over (order by l_partkey) - 1 as integer) as l_partkey from lineitem""")
def g01_label_encoder(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag",
                                             "l_quantity", "l_partkey")
    return G.LabelEncoder(inputCols=["l_linestatus", "l_returnflag", "l_quantity", "l_partkey"]).fit(li).transform(li)


@query("g02_one_hot", "select p_partkey, " + ", ".join(
    [f"case when p_type = '{v}' then 1 else 0 end as p_type_{v}" for v in P_TYPES[1:]]
    + [f"case when p_size % 12 = {v} then 1 else 0 end as p_size_{v}" for v in range(1, 12)]) + " from part")
def g02_one_hot(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_size") % 12).alias("p_size"))
    return G.OneHotEncoder(inputCols=["p_type", "p_size"]).fit(p).transform(p)


@query("g03_standard_scaler", f"""select l_orderkey, l_linenumber,
  {R("(l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem)")}
    as l_quantity,
  {R("(l_extendedprice - (select avg(l_extendedprice) from lineitem)) / (select stddev_pop(l_extendedprice) from lineitem)")}
    as l_extendedprice from lineitem""")
def g03_standard_scaler(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(G.StandardScaler(inputCols=["l_quantity", "l_extendedprice"]).fit(li).transform(li))


@query("g04_minmax_scaler", f"""select l_orderkey, l_linenumber,
  {R("(l_quantity - (select min(l_quantity) from lineitem)) / ((select max(l_quantity) - min(l_quantity) from lineitem))")}
    as l_quantity,
  {R("(l_extendedprice - (select min(l_extendedprice) from lineitem)) / ((select max(l_extendedprice) - min(l_extendedprice) from lineitem))")}
    as l_extendedprice from lineitem""")
def g04_minmax_scaler(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(G.MinMaxScaler(inputCols=["l_quantity", "l_extendedprice"]).fit(li).transform(li))
