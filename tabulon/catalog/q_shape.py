"""Projection, filter, join and reshape queries B01-B15, C01-C07 with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, rounded
from tabulon.operators import shape as S
from tabulon.plans.standins import HOUSE_SQL, LINEITEM_NULLS_SQL, house, lineitem_nulls
from tabulon.sources.io import table

LI_N = LINEITEM_NULLS_SQL
# The five event types of the driver tables (sorted).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("b01_cast_columns", "select c_custkey, cast(c_nationkey as varchar) as c_nationkey from customer")
def b01_cast_columns(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return S.cast_columns(c, ["c_nationkey"], "string")


@query("b02_fill_then_cast", "select l_orderkey, l_linenumber, "
       "cast(coalesce(nullif(l_linenumber, 1), l_quantity) as integer) as n from lineitem")
def b02_fill_then_cast(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(1)).alias("n"), "l_quantity")
    return S.fill_then_cast(li, "n", "l_quantity", "int").select("l_orderkey", "l_linenumber", "n")


@query("b03_to_numeric", "select event_id, try_cast(trim(case when event_id % 10 = 0 then 'n/a' "
       "else cast(value as varchar) end) as double) as value_text from events")
def b03_to_numeric(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string")).alias("value_text"))
    return S.to_numeric(e, ["value_text"])


@query("b04_to_timestamp", """select o_orderkey,
  strftime(try_cast(case when o_orderkey % 9 = 0 then 'not a date' else cast(o_orderdate as varchar) end
                    as timestamp), '%Y-%m-%d %H:%M:%S') as order_date_text from orders""")
def b04_to_timestamp(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("order_date_text"))
    t = S.to_timestamp(o, "date")
    return t.select("o_orderkey", F.date_format("order_date_text", "yyyy-MM-dd HH:mm:ss").alias("order_date_text"))


@query("b05_drop_columns", "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def b05_drop_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    return S.drop_columns(li, ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
                               "l_linestatus", "l_shipdate", "not_a_column"])


@query("b08_append_columns", f"""select l_orderkey, l_linenumber, l_quantity,
  {R('l_quantity * l_extendedprice', 6)} as qty_x_price, {R('l_extendedprice * (1 - l_discount)', 6)} as net,
  {R('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} as gross from lineitem""")
def b08_append_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_tax")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = S.append_columns(li, {"qty_x_price": F.col("l_quantity") * F.col("l_extendedprice"), "net": net,
                                "gross": net * (1 + F.col("l_tax"))})
    return rounded(out.drop("l_extendedprice", "l_discount", "l_tax"), 6)


@query("b09_filter_equal", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R'")
def b09_filter_equal(spark, sf):
    return S.filter_equal(table(spark, sf, "lineitem"), "l_returnflag", "R",
                          ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("b10_not_equal_keep_null", f"select l_orderkey, l_linenumber, l_tax from {LI_N} "
       "where l_tax is distinct from 0.02")
def b10_not_equal_keep_null(spark, sf):
    return S.not_equal_keep_null(lineitem_nulls(spark, sf), "l_tax", 0.02).select(
        "l_orderkey", "l_linenumber", "l_tax")


@query("b11_rows_with_nulls", f"select l_orderkey, l_linenumber, l_discount, l_tax from {LI_N} "
       "where l_discount is null or l_tax is null")
def b11_rows_with_nulls(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return S.rows_with_nulls(df)


@query("b12_drop_null_rows", f"select l_orderkey, l_linenumber, l_discount, l_tax from {LI_N} "
       "where l_discount is not null and l_tax is not null")
def b12_drop_null_rows(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return S.drop_null_rows(df)


@query("b13_split_labelled", f"""select l_orderkey, l_linenumber, price, 'labelled' as part from {HOUSE_SQL}
  where price is not null
union all select l_orderkey, l_linenumber, price, 'to_score' as part from {HOUSE_SQL} where price is null""")
def b13_split_labelled(spark, sf):
    h = house(spark, sf).select("l_orderkey", "l_linenumber", "price")
    lab, unl = S.split_labelled(h, "price")
    return lab.withColumn("part", F.lit("labelled")).unionByName(unl.withColumn("part", F.lit("to_score")))


@query("b14_isin", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def b14_isin(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return S.filter_isin(o, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("b14_semi_join", "select l_orderkey, l_linenumber, l_partkey from lineitem "
       "where l_partkey in (select p_partkey from part where p_size > 45)")
def b14_semi_join(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    big = table(spark, sf, "part").where(F.col("p_size") > 45).select("p_partkey")
    return S.filter_isin(li, "l_partkey", big)


@query("b15_head_tail", """select * from (select o_orderkey, o_totalprice, 'head' as part from orders
  order by o_orderkey limit 5)
union all select * from (select o_orderkey, o_totalprice, 'tail' as part from orders order by o_orderkey desc limit 5)""")
def b15_head_tail(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return (S.head(o, "o_orderkey", 5).withColumn("part", F.lit("head"))
            .unionByName(S.tail(o, "o_orderkey", 5).withColumn("part", F.lit("tail"))))


# ------------------------------------------------------------------ C01 / C02
@query("c01_outer_merge", """select coalesce(a.doc_id, b.doc_id) as doc_id, a.lang, a.n_chars, b.quality, b.toxic
from (select case when doc_id = 3 then null else doc_id end as doc_id, lang, n_chars from documents) a
full outer join (select case when doc_id = 4 then null else doc_id end as doc_id, quality, toxic from labels) b
  on a.doc_id is not distinct from b.doc_id""")
def c01_outer_merge(spark, sf):
    a = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id")).alias("doc_id"), "lang", "n_chars")
    b = table(spark, sf, "labels").select(
        F.when(F.col("doc_id") == 4, None).otherwise(F.col("doc_id")).alias("doc_id"), "quality", "toxic")
    return S.outer_merge(a, b, ["doc_id"])


_C01_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "ln"]


@query("c01_outer_merge_4key", """select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey,
  coalesce(a.l_partkey, b.l_partkey) as l_partkey, coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey,
  coalesce(a.ln, b.ln) as ln, a.qa, b.qb
from (select l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 7) as ln, l_quantity as qa from lineitem
      where l_returnflag in ('A', 'R')) a
full outer join (select l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 7) as ln, l_extendedprice as qb
      from lineitem where l_returnflag in ('R', 'N')) b
  on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey
 and a.ln is not distinct from b.ln""")
def c01_outer_merge_4key(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("ln", F.nullif("l_linenumber", F.lit(7)))
    a = li.where(F.col("l_returnflag").isin("A", "R")).select(*_C01_KEYS, F.col("l_quantity").alias("qa"))
    b = li.where(F.col("l_returnflag").isin("R", "N")).select(*_C01_KEYS, F.col("l_extendedprice").alias("qb"))
    return S.outer_merge(a, b, _C01_KEYS)


@query("c02_concat_rows", """select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0
union all by name select o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 1""")
def c02_concat_rows(spark, sf):
    o = table(spark, sf, "orders")
    train = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_orderstatus", "o_totalprice")
    test = o.where(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_orderstatus")
    return S.concat_rows(train, test)


# ------------------------------------------------------------------ C03, C05 - C07
@query("c03_pivot_mean", "select user_id, day, " + ", ".join(
    f"round(avg(value) filter (where event_type = '{t}'), 6) as {t}" for t in EVENT_TYPES)
       + " from (select user_id, cast(dayofmonth(ts) as integer) as day, event_type, value from events) "
       "group by user_id, day")
def c03_pivot_mean(spark, sf):
    from tabulon.plans.standins import scouting_long
    return rounded(S.pivot_mean(scouting_long(spark, sf), ["user_id", "day"], "event_type", "value", EVENT_TYPES))


@query("c05_melt", "select p_partkey, variable, value from (select p_partkey, p_retailprice, "
       "cast(p_size as double) as p_size from part) unpivot (value for variable in (p_retailprice, p_size))")
def c05_melt(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return S.melt(p, ["p_partkey"], ["p_retailprice", "p_size"], "variable", "value")


@query("c06_crosstab", """select l_returnflag,
  round((count(*) filter (where l_linestatus = 'F')) / count(*), 6) as "F",
  round((count(*) filter (where l_linestatus = 'O')) / count(*), 6) as "O"
from lineitem group by l_returnflag""")
def c06_crosstab(spark, sf):
    return rounded(S.crosstab_normalized(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"]))


@query("c07_contingency", """select l_returnflag, l_linestatus, count(*) as count,
  round(count(*) / (select count(*) from lineitem), 6) as share from lineitem group by 1, 2""")
def c07_contingency(spark, sf):
    return rounded(S.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


# ------------------------------------------------------------------ H01 - H04
@query("h01_window_mean", f"""select o_orderkey,
  {R('avg(o_totalprice) over (partition by o_orderstatus, o_orderpriority)')} as mean_status_priority from orders""")
def h01_window_mean(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return rounded(S.window_mean(o, "o_totalprice", ["o_orderstatus", "o_orderpriority"], "mean_status_priority")
                   .select("o_orderkey", "mean_status_priority"))


@query("h02_sort_report", f"""select p_brand, {R('avg(p_retailprice)')} as mean_price from part
  group by p_brand order by mean_price desc, p_brand""")
def h02_sort_report(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean_price"))
    return rounded(S.sort_report(p, "mean_price", "p_brand"))


@query("h03_top_k", """select o_orderkey, o_custkey, o_totalprice from orders
  order by o_totalprice desc, o_orderkey limit 20""")
def h03_top_k(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.top_k(o, "o_totalprice", 20, tie="o_orderkey")


@query("h04_value_counts", """select l_suppkey, count(*) as count from lineitem where l_suppkey is not null
  group by l_suppkey order by count desc, l_suppkey""")
def h04_value_counts(spark, sf):
    return S.value_counts(table(spark, sf, "lineitem"), "l_suppkey")


# ------------------------------------------------------------------ A01 - A03
@query("a01_read_table", """select c_custkey, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment,
  case when c_custkey % 5 = 0 then null else c_acctbal end as c_acctbal from customer""")
def a01_read_table(spark, sf):
    from tabulon.session import scratch_path
    from tabulon.sources.io import read_table
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    path = scratch_path(spark, "a01")
    c.write.option("header", True).csv(path)
    return read_table(spark, path, schema="c_custkey bigint, c_mktsegment string, c_acctbal double")


@query("a02_read_semicolon_table", """select s_suppkey, s_name, s_nationkey, s_acctbal from supplier""")
def a02_read_semicolon_table(spark, sf):
    from tabulon.session import scratch_path
    from tabulon.sources.io import read_semicolon_table
    path = scratch_path(spark, "a02")
    table(spark, sf, "supplier").write.option("header", True).option("sep", ";").csv(path)
    return read_semicolon_table(spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, "
                                                    "s_acctbal double")


@query("a03_write_predictions", f"""select o_orderkey, {R('o_totalprice * 0.9 + 1000')} as prediction from orders""")
def a03_write_predictions(spark, sf):
    from tabulon.session import scratch_path
    from tabulon.sources.io import read_table, write_predictions
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.9 + 1000).alias("prediction"))
    path = scratch_path(spark, "a03")
    write_predictions(rounded(o), path, "o_orderkey", "prediction")
    return read_table(spark, path, schema="o_orderkey bigint, prediction double")
