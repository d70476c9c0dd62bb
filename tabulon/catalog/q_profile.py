"""Profiling queries D01-D14, D16, D24 with their DuckDB twins."""

from __future__ import annotations

from tabulon.catalog import query, rounded
from tabulon.operators import profile as P
from tabulon.plans.standins import HOUSE_SQL, LINEITEM_NULLS_SQL, house, lineitem_nulls
from tabulon.sources.io import table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_N = LINEITEM_NULLS_SQL


def _union(parts):
    return "\nunion all\n".join(parts)


# ------------------------------------------------------------------ D01
_D01_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
              ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
              ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string")]


@query("d01_table_overview", _union([
    f"select '{c}' as feature, '{t}' as dtype, {i} as position, count(*) as n_rows, "
    f"count(*) - count({c}) as n_missing, count(distinct {c}) as n_distinct from {LI_N}"
    for i, (c, t) in enumerate(_D01_TYPES)]))
def d01_table_overview(spark, sf):
    return P.table_overview(lineitem_nulls(spark, sf))


# ------------------------------------------------------------------ D02 / D03
def _summary_sql(cols, probs, src):
    parts = []
    for c in cols:
        qs = ", ".join(f"round(quantile_cont({c}, {p}), 6) as {P.qname(p)}" for p in probs)
        parts.append(f"select '{c}' as feature, count({c}) as count, round(avg({c}), 6) as mean, "
                     f"round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min, {qs}, "
                     f"round(max({c}), 6) as max from {src}")
    return _union(parts)


@query("d02_describe", _summary_sql(LI_NUM, [0.25, 0.5, 0.75], LI_N))
def d02_describe(spark, sf):
    return rounded(P.describe(lineitem_nulls(spark, sf), LI_NUM))


@query("d03_num_summary", _summary_sql(["o_totalprice", "o_custkey"], P.SUMMARY_QUANTILES, "orders"))
def d03_num_summary(spark, sf):
    return rounded(P.num_summary(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


# ------------------------------------------------------------------ D04 / D05
@query("d04_missing_table", f"""
select feature, n_miss, round_even(n_miss * 100.0 / n, 2) as ratio from (
  select 'l_discount' as feature, count(*) - count(l_discount) as n_miss, count(*) as n from {LI_N}
  union all select 'l_tax', count(*) - count(l_tax), count(*) from {LI_N}
  union all select 'l_quantity', count(*) - count(l_quantity), count(*) from {LI_N}
  union all select 'l_returnflag', count(*) - count(l_returnflag), count(*) from {LI_N}
) where n_miss > 0""")
def d04_missing_table(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_discount", "l_tax", "l_quantity", "l_returnflag")
    return P.missing_table(df)


@query("d05_missing_vs_target", _union([
    f"select '{c}' as feature, case when {c} is null then 1 else 0 end as na_flag, "
    f"round(avg(price), 6) as target_mean, count(price) as count from {HOUSE_SQL} group by 1, 2"
    for c in ["l_discount", "l_tax"]]))
def d05_missing_vs_target(spark, sf):
    return rounded(P.missing_vs_target(house(spark, sf), "price", ["l_discount", "l_tax"]))


# ------------------------------------------------------------------ D06 - D10
@query("d06_cat_summary", _union([
    f"select '{c}' as feature, cast({c} as varchar) as level, count(*) as count, "
    f"round(count(*) * 100.0 / (select count(*) from customer), 6) as ratio "
    f"from customer where {c} is not null group by {c}" for c in ["c_mktsegment", "c_nationkey"]]))
def d06_cat_summary(spark, sf):
    return rounded(P.cat_summary(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]))


@query("d07_target_by_category", _union([
    f"select '{c}' as feature, {c} as level, round(avg(o_totalprice), 6) as target_mean "
    f"from orders where {c} is not null group by {c}" for c in ["o_orderpriority", "o_orderstatus"]]))
def d07_target_by_category(spark, sf):
    return rounded(P.target_by_category(table(spark, sf, "orders"), "o_totalprice",
                                        ["o_orderpriority", "o_orderstatus"]))


@query("d08_target_by_category_wide", _union([
    f"select '{c}' as feature, {c} as level, round(avg(o_totalprice), 6) as target_mean, "
    f"count(o_totalprice) as count, round(count(*) * 100.0 / (select count(*) from orders), 6) as ratio "
    f"from orders where {c} is not null group by {c}" for c in ["o_orderpriority", "o_orderstatus"]]))
def d08_target_by_category_wide(spark, sf):
    return rounded(P.target_by_category(table(spark, sf, "orders"), "o_totalprice",
                                        ["o_orderpriority", "o_orderstatus"], wide=True))


@query("d09_numeric_by_target", f"""
select l_returnflag, {", ".join(f"round(avg({c}), 6) as {c}" for c in LI_NUM)}
from {LI_N} where l_returnflag is not null group by l_returnflag""")
def d09_numeric_by_target(spark, sf):
    return rounded(P.numeric_by_target(lineitem_nulls(spark, sf), "l_returnflag", LI_NUM))


@query("d10_rare_analysis", _union([
    f"""select '{c}' as feature, (select count(distinct {c}) from part) as n_levels, {c} as level,
    count(*) as count, round(count(*) / (select count(*) from part), 6) as ratio,
    round(avg(p_retailprice), 6) as target_mean from part where {c} is not null group by {c}"""
    for c in ["p_type", "p_brand"]]))
def d10_rare_analysis(spark, sf):
    return rounded(P.rare_analysis(table(spark, sf, "part"), "p_retailprice", ["p_type", "p_brand"]))


# ------------------------------------------------------------------ D11
_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_STR = {"l_returnflag", "l_linestatus"}


def _d11_sql():
    parts = []
    for i, c in enumerate(_LI_ALL):
        s = "true" if c in _LI_STR else "false"
        parts.append(f"select '{c}' as feature, {i} as position, count(distinct {c}) as n_distinct, {s} as is_str "
                     f"from lineitem")
    return f"""select feature, position, n_distinct,
  case when is_str and n_distinct > 20 then 'cardinal' when is_str then 'cat'
       when n_distinct < 10 then 'cat' else 'num' end as kind,
  case when (not is_str) and n_distinct < 10 then 1 else 0 end as num_but_cat
from ({_union(parts)})"""


@query("d11_column_kinds", _d11_sql())
def d11_column_kinds(spark, sf):
    return P.column_kinds(table(spark, sf, "lineitem").select(*_LI_ALL))


# ------------------------------------------------------------------ D12 - D14
def _hist_sql(cols, bins, src):
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as feature, b.bin,
  round(r.lo + b.bin * ((r.hi - r.lo) / {bins}), 6) as "left",
  round(r.lo + (b.bin + 1) * ((r.hi - r.lo) / {bins}), 6) as "right",
  coalesce(h.cnt, 0) as count
from (select min({c}) as lo, max({c}) as hi from {src}) r
cross join (select cast(range as integer) as bin from range({bins})) b
left join (select cast(case when hi = lo then 0 else least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) end
           as integer) as bin, count(*) as cnt
           from {src}, (select min({c}) as lo, max({c}) as hi from {src}) where {c} is not null group by 1) h
  on h.bin = b.bin""")
    return _union(parts)


@query("d12_histogram", _hist_sql(["l_extendedprice", "l_quantity"], 20, "lineitem"))
def d12_histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], bins=20))


@query("d13_category_counts_by_source", f"""
select l_returnflag, count(*) filter (where source = 'test') as test,
       count(*) filter (where source = 'train') as train
from {HOUSE_SQL} where l_returnflag is not null group by l_returnflag""")
def d13_category_counts_by_source(spark, sf):
    return P.category_counts_by_source(house(spark, sf), "l_returnflag", "source", ["test", "train"])


def _sigma_sql(cols, src, k=3.0):
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as feature, round(m, 6) as mean, round(s, 6) as std,
  round(m - {k} * s, 6) as lower, round(m + {k} * s, 6) as upper,
  (select count(*) from {src} where {c} < m - {k} * s or {c} > m + {k} * s) as n_outside
from (select avg({c}) as m, stddev_samp({c}) as s from {src})""")
    return _union(parts)


@query("d14_sigma_bands", _sigma_sql(["l_extendedprice", "l_quantity"], "lineitem"))
def d14_sigma_bands(spark, sf):
    return rounded(P.sigma_bands(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


# ------------------------------------------------------------------ D16
def _skewtest_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as feature, n, g1 as skew, z,
  (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))
    * exp(-(abs(z) / sqrt(2.0)) * (abs(z) / sqrt(2.0))) as p_value
from (select *, 1.0 / (1.0 + 0.3275911 * (abs(z) / sqrt(2.0))) as t from (
  select *, case when n >= 8 then delta * ln(yy / alpha + sqrt((yy / alpha) * (yy / alpha) + 1)) end as z
  from (select *, 1 / sqrt(0.5 * ln(w2)) as delta, sqrt(2.0 / (w2 - 1)) as alpha,
               case when y = 0 then 1.0 else y end as yy
        from (select *, -1 + sqrt(2 * (beta2 - 1)) as w2
              from (select n, g1, g1 * sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2))) as y,
                           (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3))
                           / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) as beta2
                    from (select cast(count({c}) as double) as n,
                                 skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) as g1
                          from {src}))))))""")
    return _union(parts)


@query("d16_skew_test", "select feature, cast(n as bigint) as n, round(skew, 6) as skew, round(z, 6) as z, "
       "round(p_value, 4) as p_value from (" + _skewtest_sql(["l_extendedprice", "l_quantity"], "lineitem") + ")")
def d16_skew_test(spark, sf):
    """The twin's p-value is a series good to 1.5e-7, so it is compared to four digits; see the unit test."""
    out = P.skew_test(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(out.drop("p_value").select("*")).join(rounded(out.select("feature", "p_value"), 4), "feature")


# ------------------------------------------------------------------ D24
@query("d24_kde", """
with st as (select count(l_quantity) as n, stddev_samp(l_quantity) as sd, min(l_quantity) as lo,
                   max(l_quantity) as hi from lineitem),
     g as (select cast(range as integer) as point from range(50))
select g.point, round(st.lo + g.point * (st.hi - st.lo) / 49, 6) as x,
       round(sum(exp(-0.5 * pow((st.lo + g.point * (st.hi - st.lo) / 49 - l.l_quantity)
                                / (st.sd * pow(st.n, -0.2)), 2)))
             / (st.n * st.sd * pow(st.n, -0.2) * sqrt(2 * pi())) * 1000, 6) as density_x1000
from lineitem l, st, g where l.l_quantity is not null
group by g.point, st.lo, st.hi, st.n, st.sd""")
def d24_kde(spark, sf):
    from pyspark.sql import functions as F
    k = P.kde(table(spark, sf, "lineitem"), "l_quantity", grid_size=50)
    return rounded(k.select("point", "x", (F.col("density") * 1000).alias("density_x1000")))
