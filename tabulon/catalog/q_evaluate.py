"""Split, fold, metric and ensemble queries (T01-T07, T11, T13, N01-N05) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, rounded
from tabulon.learn import ensemble as N
from tabulon.learn import evaluate as T
from tabulon.plans.standins import (CLASSIFICATION_PREDS_SQL, REGRESSION_PREDS_SQL, classification_preds,
                                    regression_preds)
from tabulon.sources.io import table

RP, CP = REGRESSION_PREDS_SQL, CLASSIFICATION_PREDS_SQL


@query("t01_train_test_split", """select o_orderkey,
  case when ((o_orderkey * 7919 + 42) % 10000 + 10000) % 10000 < 2500 then 'test' else 'train' end as part
from orders""")
def t01_train_test_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    tr, te = T.train_test_split(o, "o_orderkey", 0.25, seed=42, method="affine")
    return tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))


@query("t02_kfold", """select o_orderkey, o_custkey, o_orderdate, o_totalprice, cast(case when r < rem * (q + 1) then floor(r / (q + 1))
  else rem + floor((r - rem * (q + 1)) / q) end as integer) as fold
from (select o_orderkey, o_custkey, o_orderdate, o_totalprice, row_number() over (order by o_orderkey) - 1 as r,
             floor(count(*) over () / 5) as q, count(*) over () - floor(count(*) over () / 5) * 5 as rem
      from orders)""")
def t02_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return T.kfold(o, "o_orderkey", 5)


def _strat_sql(k=5):
    ends = []
    for i in range(k):
        terms = [f"(greatest(floor((s + n - {j} + {k - 1}) / {k}), 0) - greatest(floor((s - {j} + {k - 1}) / {k}), 0))"
                 for j in range(i + 1)]
        ends.append(" + ".join(terms))
    cases = " + ".join(f"case when r >= ({e}) then 1 else 0 end" for e in ends)
    return f"""with c as (select o_orderstatus, count(*) as n, min(o_orderkey) as f from orders group by o_orderstatus),
s as (select o_orderstatus, n, coalesce(sum(n) over (order by f rows between unbounded preceding
      and 1 preceding), 0) as s from c),
r as (select o_orderkey, o_orderstatus, o_custkey, o_totalprice, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as r
      from orders)
select r.o_orderkey, r.o_orderstatus, r.o_custkey, r.o_totalprice, cast({cases} as integer) as fold from r join s using (o_orderstatus)"""


@query("t03_stratified_kfold", _strat_sql(5))
def t03_stratified_kfold(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    return T.stratified_kfold(o, "o_orderkey", "o_orderstatus", 5)


def _cp_folds(spark, sf):
    return classification_preds(spark, sf).withColumn("fold", (F.col("doc_id") % 5).cast("int"))


@query("t04_cross_validate", f"""with rk as (select doc_id % 5 as fold, y,
    rank() over (partition by doc_id % 5 order by score)
      + (count(*) over (partition by doc_id % 5, score) - 1) / 2.0 as rnk from {CP}),
  a as (select avg(auc) as auc from (select fold, (sum(rnk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0)
        / (sum(y) * (count(*) - sum(y))) as auc from rk group by fold))
select {R('any_value(a.auc)')} as auc, {R('avg(accuracy)')} as accuracy, {R('avg(precision)')} as precision,
  {R('avg(recall)')} as recall, {R('avg(f1)')} as f1 from (
  select fold, accuracy, precision, recall,
    case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from (
    select fold, (tp + tn) / n as accuracy,
      case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
      case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from (
      select doc_id % 5 as fold, count(*) filter (where y = 1 and pred = 1) as tp,
        count(*) filter (where y = 0 and pred = 1) as fp, count(*) filter (where y = 1 and pred = 0) as fn,
        count(*) filter (where y = 0 and pred = 0) as tn, count(*) as n from {CP} group by 1))), a""")
def t04_cross_validate(spark, sf):
    return rounded(T.cross_validated_scores(_cp_folds(spark, sf), "y", "pred", score="score"))


@query("t05_cv_rmse", f"""select {R('avg(rmse)')} as cv_rmse, count(*) as folds from (
  select l_orderkey % 5 as fold, sqrt(avg((p1 - y) * (p1 - y))) as rmse from {RP} group by 1)""")
def t05_cv_rmse(spark, sf):
    p = regression_preds(spark, sf).withColumn("fold", F.col("l_orderkey") % 5)
    return rounded(T.cv_rmse(p, "y", "p1"))


@query("t06_regression_metrics", f"""select count(*) as n, {R('sqrt(avg((p1 - y) * (p1 - y)))')} as rmse,
  {R('avg(abs(p1 - y))')} as mae, {R('1 - sum((p1 - y) * (p1 - y)) / (var_pop(y) * count(*))')} as r2 from {RP}""")
def t06_regression_metrics(spark, sf):
    return rounded(T.regression_metrics(regression_preds(spark, sf), "y", "p1"))


@query("t07_classification_metrics", f"""with c as (select count(*) filter (where y = 1 and pred = 1) as tp,
    count(*) filter (where y = 0 and pred = 1) as fp, count(*) filter (where y = 1 and pred = 0) as fn,
    count(*) filter (where y = 0 and pred = 0) as tn from {CP}),
  m as (select (tp + tn) / (tp + tn + fp + fn) as accuracy,
    case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision,
    case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall from c),
  rk as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rnk from {CP}),
  a as (select (sum(rnk) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) as auc
        from rk)
select {R('accuracy')} as accuracy, {R('precision')} as precision, {R('recall')} as recall,
  {R('case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end')} as f1,
  {R('auc')} as auc from m, a""")
def t07_classification_metrics(spark, sf):
    return rounded(T.classification_metrics(classification_preds(spark, sf), "y", "pred", "score"))


@query("t11_rmse_original_scale", f"""select {R('sqrt(avg(power((exp(ln(1 + p1)) - 1) - (exp(ln(1 + y)) - 1), 2)))', 4)}
  as rmse from {RP}""")
def t11_rmse_original_scale(spark, sf):
    p = regression_preds(spark, sf).select(F.log1p("y").alias("y_log"), F.log1p("p1").alias("p_log"))
    return rounded(T.rmse_original_scale(p, "y_log", "p_log"), 4)


@query("t13_comparison_table", f"""select o_orderkey, o_totalprice as actual, {R('o_totalprice * 0.9 + 1000')}
  as predicted, {R('o_totalprice - (o_totalprice * 0.9 + 1000)')} as error from orders order by o_orderkey limit 20""")
def t13_comparison_table(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                          (F.col("o_totalprice") * 0.9 + 1000).alias("pred"))
    return rounded(T.comparison_table(o, "o_orderkey", "o_totalprice", "pred", 20))


# ------------------------------------------------------------------ N01 - N05
@query("n01_blend", f"select l_orderkey, l_linenumber, {R('0.28 * p1 + 0.12 * p2 + 0.6 * p3')} as blend from {RP}")
def n01_blend(spark, sf):
    p = regression_preds(spark, sf)
    return rounded(p.select("l_orderkey", "l_linenumber", N.blend(["p1", "p2", "p3"], [0.28, 0.12, 0.60])
                            .alias("blend")))


def _grid_sql():
    rows = [f"select {i} as idx, cast({w[0]} as double) as w1, cast({w[1]} as double) as w2, "
            f"cast({w[2]} as double) as w3" for i, w in enumerate(N.weight_grid())]
    return " union all ".join(rows)


@query("n02_best_blend_weights", f"""select w1, w2, w3, {R('rmse', 4)} as rmse from (
  select g.idx, g.w1, g.w2, g.w3, sqrt(avg(power(g.w1 * p1 + g.w2 * p2 + g.w3 * p3 - y, 2))) as rmse
  from {RP}, ({_grid_sql()}) g group by g.idx, g.w1, g.w2, g.w3) order by rmse, idx limit 1""")
def n02_best_blend_weights(spark, sf):
    return rounded(N.best_blend_weights(regression_preds(spark, sf), "y", ["p1", "p2", "p3"]), 4)


@query("n04_final_mix", f"""select l_orderkey, l_linenumber,
  {R('exp(0.4 * ln(1 + p3) + 0.6 * (0.28 * ln(1 + p1) + 0.12 * ln(1 + p2) + 0.6 * ln(1 + p3))) - 1', 4)} as final
from {RP}""")
def n04_final_mix(spark, sf):
    p = regression_preds(spark, sf).select("l_orderkey", "l_linenumber",
                                           *[F.log1p(c).alias(c) for c in ["p1", "p2", "p3"]])
    b = N.blend(["p1", "p2", "p3"], [0.28, 0.12, 0.60])
    return rounded(p.select("l_orderkey", "l_linenumber", N.final_mix("p3", b, 0.4).alias("final")), 4)


@query("n05_blend_with_best", f"""with best as (select w1, w2, w3 from (
  select g.idx, g.w1, g.w2, g.w3, sqrt(avg(power(g.w1 * ln(1 + p1) + g.w2 * ln(1 + p2) + g.w3 * ln(1 + p3)
    - ln(1 + y), 2))) as rmse
  from {RP}, ({_grid_sql()}) g where l_orderkey % 2 = 0 group by g.idx, g.w1, g.w2, g.w3) order by rmse, idx limit 1)
select l_orderkey, l_linenumber,
  {R('exp(best.w1 * ln(1 + p1) + best.w2 * ln(1 + p2) + best.w3 * ln(1 + p3)) - 1', 4)} as prediction
from {RP}, best where l_orderkey % 2 = 1""")
def n05_blend_with_best(spark, sf):
    p = regression_preds(spark, sf).select("l_orderkey", "l_linenumber",
                                           *[F.log1p(c).alias(c) for c in ["y", "p1", "p2", "p3"]])
    train, test = p.where(F.col("l_orderkey") % 2 == 0), p.where(F.col("l_orderkey") % 2 == 1)
    w = N.best_blend_weights(train, "y", ["p1", "p2", "p3"])
    out = N.blend_with_best(test, w, ["p1", "p2", "p3"])
    return rounded(out.select("l_orderkey", "l_linenumber", "prediction"), 4)
