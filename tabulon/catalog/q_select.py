"""Column-selection queries D15, D17-D23 with their DuckDB twins."""

from __future__ import annotations

from itertools import combinations

from tabulon.catalog import R, query, rounded
from tabulon.operators import select as S
from tabulon.plans.standins import (LINEITEM_NULLS_SQL, SALARY_NUM, SALARY_SQL, lineitem_nulls,
                                    salary)

LI_N = LINEITEM_NULLS_SQL
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return "\nunion all\n".join(parts)


def _skew_G1(c, src):
    return (f"select '{c}' as feature, case when stddev_pop({c}) = 0 then 0.0 else skewness({c}) end as skew "
            f"from {src}")


@query("d15_skewed_columns", f"select feature, {R('skew')} as skew, "
       "case when skew > 1.5 and feature <> 'p_retailprice' then 1 else 0 end as over from ("
       + _union([_skew_G1(c, SALARY_SQL) for c in SALARY_NUM + ["p_retailprice"]]) + ")")
def d15_skewed_columns(spark, sf):
    return rounded(S.skewed_columns(salary(spark, sf), SALARY_NUM + ["p_retailprice"], 1.5,
                                    exclude=["p_retailprice"]))


@query("d17_correlation_matrix", _union([
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from {LI_N}" for a, b in combinations(LI_NUM, 2)]))
def d17_correlation_matrix(spark, sf):
    return rounded(S.correlation_matrix(lineitem_nulls(spark, sf), LI_NUM))


@query("d18_corr_with_target", _union([
    f"select '{c}' as feature, round(corr({c}, p_retailprice), 6) as r from {SALARY_SQL}" for c in SALARY_NUM]))
def d18_corr_with_target(spark, sf):
    return rounded(S.corr_with_target(salary(spark, sf), "p_retailprice", SALARY_NUM))


_D19_COLS = ["l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_linenumber"]


def _dominant_sql(cols, src):
    parts = [f"select '{c}' as feature, max(cnt) / sum(cnt) as dominant_ratio from "
             f"(select cast({c} as varchar) as level, count(*) as cnt from {src} where {c} is not null group by 1)"
             for c in cols]
    return _union(parts)


@query("d19_dominant_ratio", "select feature, round(dominant_ratio, 6) as dominant_ratio, "
       "case when dominant_ratio > 0.5 then 1 else 0 end as over from (" + _dominant_sql(_D19_COLS, LI_N) + ")")
def d19_dominant_ratio(spark, sf):
    return rounded(S.dominant_ratio(lineitem_nulls(spark, sf), _D19_COLS, threshold=0.5))


def _d20_sql():
    src = f"(select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, " \
          f"case when l_linestatus = 'O' then 'x' end as mostly_missing, 'same' as constant from {LI_N})"
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "mostly_missing", "constant"]
    miss = _union([f"select '{c}' as feature, (count(*) - count({c})) * 100.0 / count(*) as pct from {src}"
                   for c in cols])
    return f"""select feature, 'missing' as reason from ({miss}) where round_even(pct, 2) > 10 and feature <> 'l_quantity'
union all
select feature, 'dominant' as reason from ({_dominant_sql(cols, src)}) where dominant_ratio > 0.95"""


@query("d20_columns_to_drop", _d20_sql())
def d20_columns_to_drop(spark, sf):
    from pyspark.sql import functions as F
    df = lineitem_nulls(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(F.col("l_linestatus") == "O", "x").alias("mostly_missing"), F.lit("same").alias("constant"))
    return S.columns_to_drop(df, target="l_quantity", missing_pct=10, dominant=0.95)


_D21_COLS = ["p_partkey", "p_size", "lines", "qty", "c_lines", "c_qty", "years"]


@query("d21_low_corr_columns", "select feature, round(r, 6) as r from (" + _union([
    f"select '{c}' as feature, corr({c}, p_retailprice) as r from {SALARY_SQL}" for c in _D21_COLS])
       + ") where abs(r) < 0.1 and feature not like '%key%'")
def d21_low_corr_columns(spark, sf):
    return rounded(S.low_corr_columns(salary(spark, sf), "p_retailprice", _D21_COLS, 0.1, exempt_substring="key"))


_D22_COLS = ["lines", "qty", "revenue", "c_lines", "c_qty", "c_revenue", "years", "p_retailprice"]


@query("d22_corr_band_columns", "select distinct feature from (select a as feature, r from ("
       + _union([f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {SALARY_SQL}"
                 for a, b in combinations(_D22_COLS, 2)])
       + ") where abs(r) between 0.3 and 0.9 union all select b as feature, r from ("
       + _union([f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {SALARY_SQL}"
                 for a, b in combinations(_D22_COLS, 2)])
       + ") where abs(r) between 0.3 and 0.9)")
def d22_corr_band_columns(spark, sf):
    return S.corr_band_columns(salary(spark, sf), _D22_COLS, 0.3, 0.9)


@query("d23_corr_tiers", """select feature, round(r, 6) as r,
  case when abs(r) < 0.1 and feature not like '%key%' then 'low'
       when abs(r) > 0.1 and abs(r) < 0.3 then 'mid'
       when abs(r) > 0.3 and feature <> 'p_retailprice' then 'good' end as tier
from (""" + _union([f"select '{c}' as feature, corr({c}, p_retailprice) as r from {SALARY_SQL}"
                    for c in SALARY_NUM + ["p_partkey"]]) + """)
where (abs(r) < 0.1 and feature not like '%key%') or (abs(r) > 0.1 and abs(r) < 0.3)
   or (abs(r) > 0.3 and feature <> 'p_retailprice')""")
def d23_corr_tiers(spark, sf):
    return rounded(S.corr_tiers(salary(spark, sf), "p_retailprice", SALARY_NUM + ["p_partkey"], 0.1, 0.3,
                                exempt_substring="key"))
