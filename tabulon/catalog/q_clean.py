"""Outlier and missing-value queries E01-E15 with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, round_binary, rounded
from tabulon.operators import clean as C
from tabulon.plans.standins import LINEITEM_NULLS_SQL, lineitem_nulls
from tabulon.sources.io import table

LI_N = LINEITEM_NULLS_SQL


def _union(parts):
    return "\nunion all\n".join(parts)


def _limits_sql(c, src, q1, q3, k=1.5):
    return (f"select '{c}' as feature, qa - {k} * (qb - qa) as low, qb + {k} * (qb - qa) as up from "
            f"(select quantile_cont({c}, {q1}) as qa, quantile_cont({c}, {q3}) as qb from {src})")


@query("e01_outlier_limits", "select feature, round(low, 6) as low, round(up, 6) as up from ("
       + _union([_limits_sql("value", "events", 0.05, 0.95)]) + ")")
def e01_outlier_limits(spark, sf):
    return rounded(C.outlier_limits(table(spark, sf, "events"), ["value"], 0.05, 0.95))


@query("e01_outlier_limits_q10_q90", "select feature, round(low, 6) as low, round(up, 6) as up from ("
       + _union([_limits_sql(c, "lineitem", 0.10, 0.90) for c in ["l_extendedprice", "l_quantity"]]) + ")")
def e01_outlier_limits_q10_q90(spark, sf):
    return rounded(C.outlier_limits(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 0.10, 0.90))


_E02 = ["c_acctbal", "c_custkey", "c_nationkey"]


def _has_out_sql(cols, src, q1, q3, k):
    return _union([f"""select '{c}' as feature, case when n > 0 then 1 else 0 end as has_outliers, n as n_outside
from (select count(*) filter (where {c} > l.up or {c} < l.low) as n from {src}, ({_limits_sql(c, src, q1, q3, k)}) l)"""
                   for c in cols])


@query("e02_has_outliers", _has_out_sql(_E02, "customer", 0.25, 0.75, 0.25))
def e02_has_outliers(spark, sf):
    return C.has_outliers(table(spark, sf, "customer"), _E02, 0.25, 0.75, 0.25)


@query("e03_outlier_columns", "select feature from (" + _has_out_sql(_E02, "customer", 0.25, 0.75, 0.25)
       + ") where has_outliers = 1")
def e03_outlier_columns(spark, sf):
    return C.outlier_columns(table(spark, sf, "customer"), _E02, 0.25, 0.75, 0.25)


@query("e04_outlier_rows", f"""select event_id, value from events, ({_limits_sql('value', 'events', 0.25, 0.75)}) l
where value < l.low or value > l.up""")
def e04_outlier_rows(spark, sf):
    return C.outlier_rows(table(spark, sf, "events"), "value", "event_id", 0.25, 0.75)


@query("e05_cap_outliers", f"""select event_id, {R('''case when value < l.low then trunc(l.low)
  when value > l.up then trunc(l.up) else value end''')} as value
from events, ({_limits_sql('value', 'events', 0.25, 0.75, 0.5)}) l""")
def e05_cap_outliers(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return rounded(C.cap_outliers(ev, ["value"], 0.25, 0.75, 0.5, mode="both"))


@query("e06_cap_outliers_upper", f"""select event_id, {R('''case when value > l.up then round_even(l.up, 0)
  else value end''')} as value
from events, ({_limits_sql('value', 'events', 0.25, 0.75, 0.5)}) l""")
def e06_cap_outliers_upper(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return rounded(C.cap_outliers(ev, ["value"], 0.25, 0.75, 0.5, mode="upper"))


def _li_missing_str(spark, sf):
    li = lineitem_nulls(spark, sf)
    return li.select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity",
                     F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("flag"))


_LI_MS = f"""(select l_orderkey, l_linenumber, l_discount, l_tax, l_quantity,
  case when l_linestatus = 'O' then l_returnflag end as flag from {LI_N})"""


@query("e07_fill_constant", f"select l_orderkey, l_linenumber, coalesce(flag, 'No') as flag from {_LI_MS}")
def e07_fill_constant(spark, sf):
    return C.fill_constant(_li_missing_str(spark, sf), ["flag"], "No").select("l_orderkey", "l_linenumber", "flag")


@query("e08_fill_from_column", f"select l_orderkey, l_linenumber, coalesce(l_tax, l_discount) as l_tax from {LI_N}")
def e08_fill_from_column(spark, sf):
    return C.fill_from_column(lineitem_nulls(spark, sf), "l_tax", "l_discount").select(
        "l_orderkey", "l_linenumber", "l_tax")


@query("e09_fill_mean", f"""select l_orderkey, l_linenumber,
  round(coalesce(l_discount, (select avg(l_discount) from {LI_N})), 6) as l_discount,
  round(coalesce(l_tax, (select avg(l_tax) from {LI_N})), 6) as l_tax from {LI_N}""")
def e09_fill_mean(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(C.MeanImputer(inputCols=["l_discount", "l_tax"]).fit(df).transform(df))


@query("e10_fill_median_of_other", f"""select l_orderkey, l_linenumber,
  coalesce(l_tax, (select quantile_cont(l_quantity, 0.5) from {LI_N})) as l_tax from {LI_N}""")
def e10_fill_median_of_other(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    return C.fill_median_of_other(df, "l_tax", "l_quantity").select("l_orderkey", "l_linenumber", "l_tax")


@query("e11_fill_mode", f"""select l_orderkey, l_linenumber,
  coalesce(flag, (select flag from {_LI_MS} where flag is not null group by flag order by count(*) desc, flag limit 1))
    as flag,
  coalesce(l_tax, (select l_tax from {_LI_MS} where l_tax is not null group by l_tax
                   order by count(*) desc, l_tax limit 1)) as l_tax
from {_LI_MS}""")
def e11_fill_mode(spark, sf):
    df = _li_missing_str(spark, sf).select("l_orderkey", "l_linenumber", "flag", "l_tax")
    return C.ModeImputer(inputCols=["flag", "l_tax"]).fit(df).transform(df)


@query("e12_value_to_null", "select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, "
       "nullif(l_tax, 0) as l_tax from lineitem")
def e12_value_to_null(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return C.value_to_null(li, ["l_discount", "l_tax"], 0.0)


@query("e13_conditional", "select l_orderkey, l_linenumber, case when l_returnflag = 'R' then l_quantity "
       "else -l_quantity end as signed_qty from lineitem")
def e13_conditional(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     C.conditional(F.col("l_returnflag") == "R", F.col("l_quantity"), -F.col("l_quantity"))
                     .alias("signed_qty"))


@query("e14_add_constant", "select l_orderkey, l_linenumber, "
       "round(l_tax / (l_discount + 1e-10), 2) as tax_per_discount from lineitem")
def e14_add_constant(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    eps = C.add_constant(li, ["l_discount"], 1e-10)
    return eps.select("l_orderkey", "l_linenumber",
                      round_binary(F.col("l_tax") / F.col("l_discount"), 2).alias("tax_per_discount"))


@query("e15_rare_encoder", """select p_partkey,
  case when p_brand in (select p_brand from part group by p_brand having count(*) / (select count(*) from part) < 0.04)
       then 'Rare' else p_brand end as p_brand,
  case when p_type in (select p_type from part group by p_type having count(*) / (select count(*) from part) < 0.04)
       then 'Rare' else p_type end as p_type
from part""")
def e15_rare_encoder(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return C.rare_encode(p, ["p_brand", "p_type"], 0.04)
