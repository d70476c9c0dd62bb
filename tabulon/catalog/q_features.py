"""Feature construction queries F01-F22 with their DuckDB twins."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, round_binary, rounded
from tabulon.operators import features as X
from tabulon.plans.standins import (CUSTOMER_HISTORY_SQL, LINEITEM_NULLS_SQL, SALARY_SQL, customer_history,
                                    lineitem_nulls, salary)
from tabulon.sources.io import table

LI_N = LINEITEM_NULLS_SQL
KEY = ["l_orderkey", "l_linenumber"]


def _li(spark, sf, cols):
    return table(spark, sf, "lineitem").select(*KEY, *cols)


# ------------------------------------------------------------------ F01 - F03
@query("f01_group_mean", f"""select o_orderkey,
  {R('avg(o_totalprice) over (partition by o_orderpriority)')} as mean_priority from orders""")
def f01_group_mean(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(X.group_mean(o, "o_totalprice", "o_orderpriority", "mean_priority")
                   .select("o_orderkey", "mean_priority"))


_F02_SETS = [["p_brand", "p_type"], ["p_type", "size_n"], ["p_brand", "p_type", "size_n"]]


def _part_sizes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type",
                                           F.nullif("p_size", F.lit(1)).alias("size_n"), "p_retailprice")


@query("f02_group_means", "select p_partkey, " + ", ".join(
    f"case when {' and '.join(f'{k} is not null' for k in ks)} then "
    f"{R(f'avg(p_retailprice) over (partition by {chr(44).join(ks)})')} end as m{i}"
    for i, ks in enumerate(_F02_SETS))
       + " from (select p_partkey, p_brand, p_type, nullif(p_size, 1) as size_n, p_retailprice from part)")
def f02_group_means(spark, sf):
    p = _part_sizes(spark, sf)
    out = X.group_means(p, "p_retailprice", _F02_SETS, [f"m{i}" for i in range(len(_F02_SETS))])
    return rounded(out.select("p_partkey", *[f"m{i}" for i in range(len(_F02_SETS))]))


_F03_SETS = [[i, a, b] for i in ["p_name"] for a, b in combinations(["p_brand", "p_type", "size_n"], 2)]


@query("f03_cross_group_means", "select p_partkey, " + ", ".join(
    f"case when {' and '.join(f'{k} is not null' for k in ks)} then "
    f"{R(f'avg(p_retailprice) over (partition by {chr(44).join(ks)})')} end as {'_'.join(ks)}_mean_p_retailprice"
    for ks in _F03_SETS)
       + " from (select p_partkey, p_name, p_brand, p_type, nullif(p_size, 1) as size_n, p_retailprice from part)")
def f03_cross_group_means(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                        F.nullif("p_size", F.lit(1)).alias("size_n"), "p_retailprice")
    out = X.cross_group_means(p, "p_retailprice", ["p_name"], ["p_brand", "p_type", "size_n"])
    return rounded(out.select("p_partkey", *[f"{'_'.join(ks)}_mean_p_retailprice" for ks in _F03_SETS]))


def _other_folds(keys, value, fold):
    """A group's mean without the rows of one's own fold, in SQL."""
    own = f"partition by {', '.join(keys + [fold])}"
    whole = f"partition by {', '.join(keys)}"
    return (f"(sum({value}) over ({whole}) - coalesce(sum({value}) over ({own}), 0)) / "
            f"nullif(count({value}) over ({whole}) - count({value}) over ({own}), 0)")


@query("f01_group_mean_out_of_fold", f"""select o_orderkey, {R(_other_folds(['o_orderpriority'], 'o_totalprice', 'fold'))} as mean_priority
  from (select *, o_orderkey % 5 as fold from orders)""")
def f01_group_mean_out_of_fold(spark, sf):
    """The priority's mean price over the other folds: a row's own price is not in its feature."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_orderkey") % 5).alias("fold"))
    return rounded(X.group_mean(o, "o_totalprice", "o_orderpriority", "mean_priority", out_of_fold=True).select("o_orderkey", "mean_priority"))


@query("f02_group_means_out_of_fold", "select p_partkey, " + ", ".join(
    f"case when {' and '.join(f'{k} is not null' for k in ks)} then {R(_other_folds(ks, 'p_retailprice', 'fold'))} end as m{i}"
    for i, ks in enumerate(_F02_SETS))
       + " from (select p_partkey, p_brand, p_type, nullif(p_size, 1) as size_n, p_retailprice, p_partkey % 4 as fold from part)")
def f02_group_means_out_of_fold(spark, sf):
    p = _part_sizes(spark, sf).withColumn("fold", F.col("p_partkey") % 4)
    out = X.group_means(p, "p_retailprice", _F02_SETS, [f"m{i}" for i in range(len(_F02_SETS))], out_of_fold=True)
    return rounded(out.select("p_partkey", *[f"m{i}" for i in range(len(_F02_SETS))]))


@query("f03_cross_group_means_out_of_fold", "select p_partkey, " + ", ".join(
    f"case when {' and '.join(f'{k} is not null' for k in ks)} then {R(_other_folds(ks, 'p_retailprice', 'fold'))} end as "
    f"{'_'.join(ks)}_mean_p_retailprice" for ks in _F03_SETS)
       + " from (select p_partkey, p_name, p_brand, p_type, nullif(p_size, 1) as size_n, p_retailprice, p_partkey % 4 as fold from part)")
def f03_cross_group_means_out_of_fold(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.nullif("p_size", F.lit(1)).alias("size_n"),
                                        "p_retailprice", (F.col("p_partkey") % 4).alias("fold"))
    out = X.cross_group_means(p, "p_retailprice", ["p_name"], ["p_brand", "p_type", "size_n"], out_of_fold=True)
    return rounded(out.select("p_partkey", *[f"{'_'.join(ks)}_mean_p_retailprice" for ks in _F03_SETS]))


# ------------------------------------------------------------------ F04 / F05
_ROW = ["l_discount", "l_tax", "q"]
_ROW_SRC = f"(select l_orderkey, l_linenumber, l_discount, l_tax, l_quantity / 100 as q from {LI_N})"


def _row_df(spark, sf):
    return lineitem_nulls(spark, sf).select(*KEY, "l_discount", "l_tax", (F.col("l_quantity") / 100).alias("q"))


_SUM = "(coalesce(l_discount, 0.0) + coalesce(l_tax, 0.0) + coalesce(q, 0.0))"
_CNT = "((l_discount is not null)::int + (l_tax is not null)::int + (q is not null)::int)"


@query("f04_row_mean", f"select l_orderkey, l_linenumber, {R(f'{_SUM} / nullif({_CNT}, 0)')} as mean from {_ROW_SRC}")
def f04_row_mean(spark, sf):
    return rounded(X.row_stats(_row_df(spark, sf), _ROW, ["mean"]).drop(*_ROW))


@query("f05_row_stats", f"""select l_orderkey, l_linenumber,
  {R("list_aggregate([l_discount, l_tax, q], 'stddev_samp')")} as std,
  {R('least(l_discount, l_tax, q)')} as min, {R('greatest(l_discount, l_tax, q)')} as max,
  {R(_SUM)} as sum, {R("list_aggregate([l_discount, l_tax, q], 'median')")} as median from {_ROW_SRC}""")
def f05_row_stats(spark, sf):
    return rounded(X.row_stats(_row_df(spark, sf), _ROW, ["std", "min", "max", "sum", "median"]).drop(*_ROW))


# ------------------------------------------------------------------ F06 - F09
@query("f06_products", f"""select l_orderkey, l_linenumber,
  {R('l_quantity * l_extendedprice', 2)} as qty_price, {R('l_quantity * l_discount * l_tax', 6)} as qty_disc_tax
from lineitem""")
def f06_products(spark, sf):
    li = _li(spark, sf, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    out = X.products(li, [["l_quantity", "l_extendedprice"], ["l_quantity", "l_discount", "l_tax"]],
                     ["qty_price", "qty_disc_tax"])
    return out.select(*KEY, round_binary(F.col("qty_price"), 2).alias("qty_price"),
                      round_binary(F.col("qty_disc_tax"), 6).alias("qty_disc_tax"))


@query("f07_sums_diffs", """select l_orderkey, l_linenumber, l_quantity + l_linenumber as qty_plus_line,
  l_quantity - l_linenumber as qty_minus_line, l_suppkey - l_partkey as supp_minus_part from lineitem""")
def f07_sums_diffs(spark, sf):
    li = _li(spark, sf, ["l_quantity", "l_suppkey", "l_partkey"])
    return li.select(*KEY, (F.col("l_quantity") + F.col("l_linenumber")).alias("qty_plus_line"),
                     (F.col("l_quantity") - F.col("l_linenumber")).alias("qty_minus_line"),
                     (F.col("l_suppkey") - F.col("l_partkey")).alias("supp_minus_part"))


@query("f08_safe_ratio", f"""select l_orderkey, l_linenumber,
  {R('l_extendedprice / (l_quantity + 1)')} as price_per_qty,
  {R('l_tax / (l_discount + 0.001)')} as tax_per_disc,
  {R('l_extendedprice / (l_discount + 1e-05) / (l_tax + 1e-05)', 0)} as chained,
  {R('l_tax / nullif(l_discount, 0)')} as unguarded from lineitem""")
def f08_safe_ratio(spark, sf):
    li = _li(spark, sf, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    out = li.select(*KEY, X.ratio("l_extendedprice", "l_quantity", 1.0).alias("price_per_qty"),
                    X.ratio("l_tax", "l_discount", 1e-3).alias("tax_per_disc"),
                    X.chained_ratio("l_extendedprice", "l_discount", "l_tax", 1e-5).alias("chained"),
                    X.ratio("l_tax", "l_discount").alias("unguarded"))
    return out.select(*KEY, *[round_binary(F.col(c), 0 if c == "chained" else 6).alias(c)
                              for c in ["price_per_qty", "tax_per_disc", "chained", "unguarded"]])


# career ratios on the salary stand-in; D(a, b) is a guarded division.
_F09 = {
    "new_qty": "D(qty, c_qty) + qty",
    "new_rev": "D(revenue, c_revenue)",
    "rev_x_years": "revenue * years",
    "qty_rate": "D(qty, lines) * 100",
    "c_qty_per_year": "D(c_qty, years)",
    "diff_lines": "lines - D(c_lines, years)",
    "diff_qty": "qty - D(c_qty, years)",
    "career_total": "c_qty + c_lines",
    "c_rev_per_line": "D(c_revenue, c_lines)",
    "net_score": "p_size - qty + lines",
}


def _div(expr: str, spark_side: bool) -> str:
    rep = r"try_divide(\1, \2)" if spark_side else r"(\1 / nullif(\2, 0))"
    return re.sub(r"D\((\w+), (\w+)\)", rep, expr)


@query("f09_career_ratios", "select p_partkey, " + ", ".join(
    f"{R(_div(e, False))} as {n}" for n, e in _F09.items()) + f" from {SALARY_SQL}")
def f09_career_ratios(spark, sf):
    s = salary(spark, sf)
    return rounded(s.select("p_partkey", *[F.expr(_div(e, True)).alias(n) for n, e in _F09.items()]))


# ------------------------------------------------------------------ F10 - F13
_PAIR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("f10_pair_features", "select l_orderkey, l_linenumber, " + ", ".join(
    f"{R(f'{a} * {b}', 4)} as {a}_x_{b}, {R(f'{a} + {b}', 4)} as {a}_plus_{b}, {R(f'{a} - {b}', 4)} as {a}_minus_{b}"
    for a, b in combinations(_PAIR, 2)) + " from lineitem")
def f10_pair_features(spark, sf):
    li = _li(spark, sf, _PAIR)
    return rounded(X.pair_features(li, _PAIR, ("mul", "add", "sub")).drop(*_PAIR), 4)


@query("f11_triple_mean", "select l_orderkey, l_linenumber, " + ", ".join(
    f"{R(f'({a} + {b} + {c}) / 3.0', 4)} as {a}_{b}_{c}_mean" for a, b, c in combinations(_PAIR, 3))
       + " from lineitem")
def f11_triple_mean(spark, sf):
    li = _li(spark, sf, _PAIR)
    return rounded(X.triple_features(li, _PAIR, ("mean",)).drop(*_PAIR), 4)


_GEN = ["l_quantity", "l_discount", "l_tax"]


@query("f12_pair_generator", "select l_orderkey, l_linenumber, " + ", ".join(
    f"{R(f'{a} + {b}')} as {a}_plus_{b}, {R(f'{a} - {b}')} as {a}_minus_{b}, {R(f'{b} - {a}')} as {b}_minus_{a}, "
    f"{R(f'{a} * {b}')} as {a}_x_{b}, {R(f'{a} / ({b} + 1e-05)', 2)} as {a}_div_{b}, "
    f"{R(f'{b} / ({a} + 1e-05)', 2)} as {b}_div_{a}" for a, b in combinations(_GEN, 2)) + " from lineitem")
def f12_pair_generator(spark, sf):
    li = _li(spark, sf, _GEN)
    out = X.pair_features(li, _GEN, ("add", "sub", "mul", "div"), both_directions=True).drop(*_GEN)
    divs = [c for c in out.columns if "_div_" in c]
    return out.select(*KEY, *[round_binary(F.col(c), 2 if c in divs else 6).alias(c)
                              for c in out.columns if c not in KEY])


@query("f13_triple_generators", "select l_orderkey, l_linenumber, " + ", ".join(
    f"{R(f'({a} + {b} + {c}) / 3.0')} as {a}_{b}_{c}_mean, {R(f'{a} * {b} * {c}', 6)} as {a}_{b}_{c}_prod, "
    f"{R(f'{a} / ({b} + 1e-05) / ({c} + 1e-05)', 0)} as {a}_div_{b}_div_{c}, "
    f"{R(f'{c} / ({b} + 1e-05) / ({a} + 1e-05)', 4)} as {c}_div_{b}_div_{a}, "
    f"{R(f'{a} - {b} - {c}')} as {a}_minus_{b}_minus_{c}, {R(f'{c} - {b} - {a}')} as {c}_minus_{b}_minus_{a}"
    for a, b, c in combinations(_GEN, 3)) + " from lineitem")
def f13_triple_generators(spark, sf):
    li = _li(spark, sf, _GEN)
    out = X.triple_features(li, _GEN, ("mean", "prod", "div", "sub")).drop(*_GEN)
    scale = {c: (0 if c.startswith("l_quantity_div") else 4 if "_div_" in c else 6) for c in out.columns}
    return out.select(*[round_binary(F.col(c), scale[c]).alias(c) if c not in KEY else F.col(c)
                        for c in out.columns])


# ------------------------------------------------------------------ F14 - F19
_EDGES = [0, 8, 16, 24, 32, 40, 48]
_LABELS = ["0-8", "8-16", "16-24", "24-32", "32-40", "40-48"]


@query("f14_range_bins", "select p_partkey, case " + " ".join(
    f"when p_size {'>=' if i == 0 else '>'} {_EDGES[i]} and p_size <= {_EDGES[i + 1]} then '{lab}'"
    for i, lab in enumerate(_LABELS)) + " end as size_bin from part")
def f14_range_bins(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.range_bins("p_size", _EDGES, _LABELS).alias("size_bin"))


@query("f15_quantile_bins", """with e as (select quantile_cont(l_quantity, 1/3) as e1, quantile_cont(l_quantity, 2/3) as e2
  from lineitem)
select l_orderkey, l_linenumber, case when l_quantity <= e1 then 0 when l_quantity <= e2 then 1 else 2 end as qbin,
  case when l_quantity <= e1 then 'low' when l_quantity <= e2 then 'mid' else 'high' end as qbin_label
from lineitem, e""")
def f15_quantile_bins(spark, sf):
    li = _li(spark, sf, ["l_quantity"])
    return X.quantile_bins(li, "l_quantity", 3, ["low", "mid", "high"], name="qbin").drop("l_quantity")


@query("f16_flags", """select event_id,
  case when event_type in ('purchase', 'signup') then 1 else 0 end as engaged,
  case when event_type is distinct from 'view' or value > 50 then 1 else 0 end as not_view_or_big from events""")
def f16_flags(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.flag(F.col("event_type").isin("purchase", "signup")).alias("engaged"),
                    X.flag(~F.col("event_type").eqNullSafe("view") | (F.col("value") > 50)).alias("not_view_or_big"))


@query("f17_count_equal", """select l_orderkey, l_linenumber,
  (case when big_qty = 'Yes' then 1 else 0 end) + (case when big_disc = 'Yes' then 1 else 0 end)
  + (case when l_returnflag = 'Yes' then 1 else 0 end) as n_yes
from (select l_orderkey, l_linenumber, case when l_quantity > 25 then 'Yes' else 'No' end as big_qty,
             case when l_discount > 0.05 then 'Yes' end as big_disc, l_returnflag from lineitem)""")
def f17_count_equal(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *KEY, F.when(F.col("l_quantity") > 25, "Yes").otherwise("No").alias("big_qty"),
        F.when(F.col("l_discount") > 0.05, "Yes").alias("big_disc"), "l_returnflag")
    return li.select(*KEY, X.count_equal_to(["big_qty", "big_disc", "l_returnflag"], "Yes").alias("n_yes"))


@query("f18_map_codes", "select p_partkey, case when p_size in (2, 3, 4, 5) then 'defender' else 'attacker' end "
       "as mentality from part")
def f18_map_codes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.map_codes("p_size", [2, 3, 4, 5], "defender", "attacker")
                                           .alias("mentality"))


@query("f19_concat_codes", "select p_partkey, cast(p_size as varchar) || '_' || p_type as size_type from part")
def f19_concat_codes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.concat_codes("p_size", "p_type").alias("size_type"))


# ------------------------------------------------------------------ F20 - F22
@query("f20_rfm", f"""select customer_id,
  cast(floor((epoch(a) - epoch(last_order_date)) / 86400) as integer) as recency,
  cast(floor((epoch(last_order_date) - epoch(first_order_date)) / 86400) as integer) as tenure,
  order_num_online + order_num_offline as frequency, {R('value_online + value_offline', 2)} as monetary
from {CUSTOMER_HISTORY_SQL} h, (select max(last_order_date) + interval 2 day as a from {CUSTOMER_HISTORY_SQL})""")
def f20_rfm(spark, sf):
    h = customer_history(spark, sf)
    r = X.rfm(h, "first_order_date", "last_order_date", ["order_num_online", "order_num_offline"],
              ["value_online", "value_offline"])
    return r.select("customer_id", "recency", "tenure", "frequency", round_binary(F.col("monetary"), 2).alias("monetary"))


@query("f21_seconds", f"""select customer_id, epoch(last_order_date) - epoch(first_order_date) as tenure_seconds
from {CUSTOMER_HISTORY_SQL}""")
def f21_seconds(spark, sf):
    from tabulon.functions.exprs import seconds_between
    h = customer_history(spark, sf)
    return h.select("customer_id", seconds_between("last_order_date", "first_order_date").alias("tenure_seconds"))


@query("f22_log1p_expm1", f"""select o_orderkey, {R('ln(1 + o_totalprice)', 6)} as log_price,
  {R('exp(ln(1 + o_totalprice)) - 1', 2)} as back from orders""")
def f22_log1p_expm1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lg = X.log1p_cols(o, ["o_totalprice"]).withColumnRenamed("o_totalprice", "log_price")
    back = X.expm1_cols(lg.withColumn("back", F.col("log_price")), ["back"])
    return back.select("o_orderkey", round_binary(F.col("log_price"), 6).alias("log_price"),
                       round_binary(F.col("back"), 2).alias("back"))
