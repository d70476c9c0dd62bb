"""Driver-table stand-ins for the reference's inputs (FIXTURES.md section 3).

Each builder returns a lazy DataFrame derived from the driver tables, and the
module keeps the equivalent SQL text for the DuckDB twins next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.io import table


def money_sum(x) -> "F.Column":
    """Exact sum of a 2-decimal amount (decimal arithmetic), returned as double.

    Float sums depend on the order of addition; the exact decimal sum does not,
    so every engine and every partitioning gives the same double.
    """
    return F.sum(x.cast("decimal(18,2)")).cast("double")

# ------------------------------------------------------------------ lineitem with missing values
# House-price stand-in: zero discount / tax become missing, the odd half of the
# orders is the unlabelled part (target missing).


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
        "l_returnflag", "l_linestatus")


LINEITEM_NULLS_SQL = """(select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax, l_returnflag, l_linestatus
  from lineitem)"""


def house(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows have ``price``; rows of odd orders are to be scored (price missing)."""
    li = lineitem_nulls(spark, sf)
    return li.withColumn("price", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_extendedprice"))) \
             .withColumn("source", F.when(F.col("l_orderkey") % 2 == 0, "train").otherwise("test"))


HOUSE_SQL = f"""(select *, case when l_orderkey % 2 = 0 then l_extendedprice end as price,
  case when l_orderkey % 2 = 0 then 'train' else 'test' end as source
  from {LINEITEM_NULLS_SQL})"""


# ------------------------------------------------------------------ customer history (RFM input)
def customer_history(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: first/last order date, and counts / value split into two channels
    (urgent+high priorities = "online", the rest = "offline")."""
    o = table(spark, sf, "orders")
    online = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min("o_orderdate").alias("first_order_date"),
        F.max("o_orderdate").alias("last_order_date"),
        F.count_if(online).alias("order_num_online"),
        F.count_if(~online).alias("order_num_offline"),
        F.coalesce(money_sum(F.when(online, F.col("o_totalprice"))), F.lit(0.0)).alias("value_online"),
        F.coalesce(money_sum(F.when(~online, F.col("o_totalprice"))), F.lit(0.0)).alias("value_offline"))


CUSTOMER_HISTORY_SQL = """(select o_custkey as customer_id, min(o_orderdate) as first_order_date,
  max(o_orderdate) as last_order_date,
  count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as order_num_online,
  count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH')) as order_num_offline,
  coalesce(cast(sum(cast(o_totalprice as decimal(18,2))) filter (where o_orderpriority in ('1-URGENT', '2-HIGH'))
    as double), 0.0) as value_online,
  coalesce(cast(sum(cast(o_totalprice as decimal(18,2))) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH'))
    as double), 0.0) as value_offline
  from orders group by o_custkey)"""


# ------------------------------------------------------------------ churn table
def churn(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer order summary; churn = no order in the 180 days before the latest order date."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    latest = o.select(F.max("o_orderdate")).scalar()
    per = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("total_value"),
        F.avg("o_totalprice").alias("avg_value"),
        F.max("o_orderdate").alias("last_date"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    j = c.join(per, c.c_custkey == per.o_custkey, "left")
    return j.select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total_value", "avg_value",
        F.coalesce("n_finished", F.lit(0)).alias("n_finished"),
        F.coalesce("n_urgent", F.lit(0)).alias("n_urgent"),
        F.when(F.col("last_date").isNull() | (F.col("last_date") < F.date_sub(latest, 180)), 1)
         .otherwise(0).alias("churn"))


# ------------------------------------------------------------------ salary stand-in (part + lineitem)
def salary(spark: SparkSession, sf: str) -> DataFrame:
    """Part attributes plus season (latest ship year) and career lineitem totals; target p_retailprice."""
    p = table(spark, sf, "part")
    li = table(spark, sf, "lineitem")
    last_year = li.agg(F.max(F.year("l_shipdate"))).first()[0]  # one number
    season = F.year("l_shipdate") == F.lit(last_year)
    per = li.groupBy("l_partkey").agg(
        F.count_if(season).alias("lines"),
        F.coalesce(F.sum(F.when(season, F.col("l_quantity"))), F.lit(0.0)).alias("qty"),
        F.coalesce(money_sum(F.when(season, F.col("l_extendedprice"))), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("c_lines"),
        F.sum("l_quantity").alias("c_qty"),
        money_sum(F.col("l_extendedprice")).alias("c_revenue"),
        F.count_distinct(F.year("l_shipdate")).alias("years"))
    return p.join(per, p.p_partkey == per.l_partkey, "inner").drop("l_partkey")


# ------------------------------------------------------------------ scouting stand-in
def scouting_long(spark: SparkSession, sf: str) -> DataFrame:
    """events as (user, day, event_type, value): the long attribute table."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id"), F.dayofmonth("ts").alias("day"), "event_type", "value")



SALARY_SQL = """(select p.*, per.lines, per.qty, per.revenue, per.c_lines, per.c_qty, per.c_revenue, per.years
  from part p join (
    select l_partkey,
      count(*) filter (where year(l_shipdate) = (select max(year(l_shipdate)) from lineitem)) as lines,
      coalesce(sum(l_quantity) filter (where year(l_shipdate) = (select max(year(l_shipdate)) from lineitem)), 0.0) as qty,
      coalesce(cast(sum(cast(l_extendedprice as decimal(18,2)))
        filter (where year(l_shipdate) = (select max(year(l_shipdate)) from lineitem)) as double), 0.0) as revenue,
      count(*) as c_lines, sum(l_quantity) as c_qty,
      cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as c_revenue,
      count(distinct year(l_shipdate)) as years
    from lineitem group by l_partkey) per on p.p_partkey = per.l_partkey)"""

SALARY_NUM = ["p_size", "lines", "qty", "revenue", "c_lines", "c_qty", "c_revenue", "years"]


# ------------------------------------------------------------------ deterministic prediction tables
# Metric and ensemble queries score fixed expressions, so the SQL twin can repeat them.
def regression_preds(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("p1"),
        (F.col("l_quantity") * 1000.0 + 20000.0).alias("p2"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("p3"))


REGRESSION_PREDS_SQL = """(select l_orderkey, l_linenumber, l_extendedprice as y, l_quantity * 1500.0 as p1,
  l_quantity * 1000.0 + 20000.0 as p2, l_extendedprice * (1 + l_discount - l_tax) as p3 from lineitem)"""


def classification_preds(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return j.select("doc_id", F.col("quality").alias("y"), score.alias("score"),
                    F.when(score > 0.7, 1).otherwise(0).alias("pred"))


CLASSIFICATION_PREDS_SQL = """(select doc_id, quality as y, n_chars / (n_chars + 1000.0) as score,
  case when n_chars / (n_chars + 1000.0) > 0.7 then 1 else 0 end as pred
  from documents join labels using (doc_id))"""
