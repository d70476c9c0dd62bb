"""Model, tuning, stacking and segmentation queries.

Fitted models have arbitrary internals, so most of these are rows-only checks;
the linear models have closed forms for one feature and a DuckDB twin, the
segment profile is checked on a fixed segment rule, and the last group states
what any right fit must give (predictions within the labels, every row scored
once, nearest centres) in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.catalog import R, query, rounded
from tabulon.learn import models as M
from tabulon.learn import paths as PA
from tabulon.learn import segment as K
from tabulon.learn import tune as TU
from tabulon.learn.evaluate import kfold, stratified_kfold
from tabulon.plans.rfm import RFM_COLS, rfm_features
from tabulon.plans.standins import CUSTOMER_HISTORY_SQL, SALARY_NUM, SALARY_SQL, churn, customer_history, salary
from tabulon.session import scratch_path

SAL_X = SALARY_NUM
CH_X = ["c_acctbal", "n_orders", "total_value", "avg_value", "n_finished", "n_urgent", "c_nationkey"]


def _made_once(df):
    """``df`` as a written table: the count, the sample and the sort behind folds do not join and add up their input again."""
    path = scratch_path(df.sparkSession, "stand-in")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _salary_folds(spark, sf, k=5):
    s = salary(spark, sf).select("p_partkey", *SAL_X, F.col("p_retailprice").alias("label"))
    return kfold(_made_once(s), "p_partkey", k)


def _churn_folds(spark, sf, k=5):
    c = churn(spark, sf).select("c_custkey", *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x)
                                               for x in CH_X], F.col("churn").cast("double").alias("label"))
    return stratified_kfold(_made_once(c), "c_custkey", "label", k)


def _fit_score(spark, sf, est, key="p_partkey", folds=_salary_folds, feats=SAL_X):
    return _scored(folds(spark, sf), est, key, feats)


def _scored(df, est, key="p_partkey", feats=SAL_X):
    model, pred = M.fit_predict(est, df, df, feats, "label")
    return pred.select(key, "label", "prediction")


# ------------------------------------------------------------------ M01 / M02 with closed forms
@query("m01_linear", f"""select {R('regr_slope(p_retailprice, c_lines)')} as coef,
  {R('regr_intercept(p_retailprice, c_lines)')} as intercept from {SALARY_SQL}""")
def m01_linear(spark, sf):
    s = salary(spark, sf)
    model, _ = M.fit_predict(M.regressor("lr"), s.withColumn("label", F.col("p_retailprice")), s.limit(0),
                             ["c_lines"])
    lr = model.stages[-1]
    return rounded(spark.range(1).select(F.lit(float(lr.coefficients[0])).alias("coef"),
                                         F.lit(float(lr.intercept)).alias("intercept")))


_ALPHA = 10000.0


@query("m02_ridge", f"""select {R('slope', 4)} as coef, {R('ybar - slope * xbar', 4)} as intercept from (
  select covar_pop(p_retailprice, c_lines) * count(*) / (var_pop(c_lines) * count(*) + {_ALPHA}) as slope,
         avg(c_lines) as xbar, avg(p_retailprice) as ybar from {SALARY_SQL})""")
def m02_ridge(spark, sf):
    s = salary(spark, sf)
    model, _ = M.fit_predict(M.regressor("ridge", alpha=_ALPHA), s.withColumn("label", F.col("p_retailprice")),
                             s.limit(0), ["c_lines"])
    lr = model.stages[-1]
    return rounded(spark.range(1).select(F.lit(float(lr.coefficients[0])).alias("coef"),
                                         F.lit(float(lr.intercept)).alias("intercept")), 4)


def _one_feature(spark, sf, est, digits=4):
    """Coefficient and intercept of a linear model of the price on the number of lines."""
    s = salary(spark, sf).withColumn("label", F.col("p_retailprice"))
    lr = M.fit_predict(est, s, s.limit(0), ["c_lines"])[0].stages[-1]
    return rounded(s.limit(1).select(F.lit(float(lr.coefficients[0])).alias("coef"), F.lit(float(lr.intercept)).alias("intercept")), digits)


def _soft_sql(alpha, l1):
    """Soft threshold of the covariance: the closed form of lasso and elastic net with one feature."""
    return f"""select {R('slope', 2)} as coef, {R('ybar - slope * xbar', 2)} as intercept from (
  select sign(c) * greatest(abs(c) - {alpha * l1}, 0) / (v + {alpha * (1 - l1)}) as slope, xbar, ybar from (
    select covar_pop(p_retailprice, c_lines) as c, var_pop(c_lines) as v, avg(c_lines) as xbar, avg(p_retailprice) as ybar
    from {SALARY_SQL}))"""


@query("m03_lasso_one_feature", _soft_sql(0.5, 1.0))
def m03_lasso_one_feature(spark, sf):
    return _one_feature(spark, sf, M.regressor("lasso", alpha=0.5), 2)


@query("m04_elastic_net_one_feature", _soft_sql(0.5, 0.5))
def m04_elastic_net_one_feature(spark, sf):
    return _one_feature(spark, sf, M.regressor("enet", alpha=0.5, l1_ratio=0.5), 2)


# ------------------------------------------------------------------ M03 - M13: rows-only predictions
@query("m03_lasso")
def m03_lasso(spark, sf):
    return _fit_score(spark, sf, M.regressor("lasso", alpha=1.0))


@query("m04_elastic_net")
def m04_elastic_net(spark, sf):
    return _fit_score(spark, sf, M.regressor("enet", alpha=1.0, l1_ratio=0.5))


@query("m06_decision_tree")
def m06_decision_tree(spark, sf):
    return _fit_score(spark, sf, M.regressor("cart"))


@query("m07_random_forest")
def m07_random_forest(spark, sf):
    """100 trees without a depth bound."""
    return _fit_score(spark, sf, M.regressor("rf"))


@query("m06_tree_of_distinct_rows", """select p_partkey, (round(p_retailprice, 6) + 0.0) as prediction from part""")
def m06_tree_of_distinct_rows(spark, sf):
    """Grown until leaves are pure, a tree over a column without ties gives every row its label."""
    from tabulon.sources.io import table
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("label"))
    _, out = M.fit_predict(M.regressor("cart"), p, p, ["p_partkey", "p_size"])
    return rounded(out.select("p_partkey", "prediction"))


@query("m08_gradient_boosting")
def m08_gradient_boosting(spark, sf):
    return _fit_score(spark, sf, M.regressor("gbm"))


@query("m09_booster_regressors")
def m09_booster_regressors(spark, sf):
    parts, df = [], _salary_folds(spark, sf)
    for name in M.BOOSTERS:
        p = _scored(df, M.regressor(name, n_estimators=30, **({"max_depth": 6} if name == "lgbm" else {})))
        parts.append(p.withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m10_booster_classifiers")
def m10_booster_classifiers(spark, sf):
    parts, df = [], _churn_folds(spark, sf)
    for name in M.BOOSTERS:
        p = _scored(df, M.classifier(name, n_estimators=30, **({"max_depth": 6} if name == "lgbm" else {})), "c_custkey", CH_X)
        parts.append(p.withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m11_logistic_regression")
def m11_logistic_regression(spark, sf):
    return _fit_score(spark, sf, M.classifier("logreg"), "c_custkey", _churn_folds, CH_X)


def _kernel_rows(spark, sf, folds, cols, **scaled):
    from tabulon.operators.encode import StandardScaler
    df = folds(spark, sf)
    df = StandardScaler(inputCols=[*cols, *scaled]).fit(df).transform(df)
    return M.assemble(cols).transform(df)


@query("m12_kernel_svm")
def m12_kernel_svm(spark, sf):
    """RBF classifier with the hinge loss, to a duality gap of 0.1 %."""
    rows = _kernel_rows(spark, sf, _churn_folds, CH_X)
    return M.classifier("svc").fit(rows).transform(rows).select("c_custkey", "label", "prediction")


@query("m12_kernel_svr")
def m12_kernel_svr(spark, sf):
    """RBF regressor with the epsilon-insensitive loss on scaled prices."""
    rows = _kernel_rows(spark, sf, _salary_folds, SAL_X, label=True)
    return M.regressor("svr").fit(rows).transform(rows).select("p_partkey", "label", "prediction")


@query("m12_duality_gaps")
def m12_duality_gaps(spark, sf):
    """Primal and dual value and their difference after each round, for both losses."""
    one = M.classifier("svc").fit(_kernel_rows(spark, sf, _churn_folds, CH_X)).gaps(spark).withColumn("loss", F.lit("hinge"))
    two = M.regressor("svr").fit(_kernel_rows(spark, sf, _salary_folds, SAL_X, label=True)).gaps(spark).withColumn("loss", F.lit("epsilon"))
    return one.unionByName(two)


@query("m13_adaboost")
def m13_adaboost(spark, sf):
    return _fit_score(spark, sf, M.classifier("adaboost"), "c_custkey", _churn_folds, CH_X)


@query("m14_feature_importance")
def m14_feature_importance(spark, sf):
    df = _salary_folds(spark, sf)
    model, _ = M.fit_predict(M.regressor("rf", max_depth=8), df, df.limit(0), SAL_X)
    return M.feature_importance(model, SAL_X, top=5)


@query("m15_predict")
def m15_predict(spark, sf):
    """Fit on the labelled half (even part keys), score the other half."""
    df = _salary_folds(spark, sf)
    train, test = df.where(F.col("p_partkey") % 2 == 0), df.where(F.col("p_partkey") % 2 == 1)
    _, pred = M.fit_predict(M.regressor("gbm"), train, test, SAL_X)
    return pred.select("p_partkey", "prediction")


# ------------------------------------------------------------------ T08 - T10, T12, N03
@query("t08_grid_search")
def t08_grid_search(spark, sf):
    from pyspark.ml.regression import GBTRegressor
    _, table = TU.grid_search(GBTRegressor(seed=42), {"maxDepth": [2, 4], "maxIter": [5, 10]},
                              _salary_folds(spark, sf), SAL_X, "label")
    return table


def _curve_sql(loss, coefficient):
    """One row per grid point and fold of a one-feature model: fit on the other folds, RMSE and R^2 on this one."""
    return f"""with s as (select p_retailprice as y, c_lines as x, p_partkey % 5 as fold from {SALARY_SQL}),
t as (select f.fold, covar_pop(s.y, s.x) as c, var_pop(s.x) as v, avg(s.x) as mx, avg(s.y) as my, count(*) as n
  from (select distinct fold from s) f join s on s.fold <> f.fold group by f.fold),
w as (select t.fold, {loss}, {coefficient} as slope, mx, my from t, {{grid}}),
e as (select w.*, s.y, s.y - (my - slope * mx) - slope * s.x as r from w join s on s.fold = w.fold)"""


_ENET_ALPHAS, _ENET_RATIOS = [0.001, 0.003, 0.005, 0.01, 0.03], [0.001, 0.005, 0.01, 0.03, 0.05, 0.1]  # the reference's grid


def _one_feature_folds(spark, sf):
    s = salary(spark, sf)
    return s.select("c_lines", F.col("p_retailprice").alias("label"), (F.col("p_partkey") % 5).cast("int").alias("fold"))


_ENET_SQL = _curve_sql("alpha, l1_ratio", "sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (v + alpha * (1 - l1_ratio))").replace(
    "{grid}", f"(select unnest({_ENET_ALPHAS}::double[]) as alpha), (select unnest({_ENET_RATIOS}::double[]) as l1_ratio)")


@query("t08_elastic_net_folds", _ENET_SQL + f""" select cast(fold as integer) as fold, alpha, l1_ratio, {R('any_value(slope)', 4)} as coef,
  {R('sqrt(avg(r * r))', 4)} as rmse from e group by fold, alpha, l1_ratio""")
def t08_elastic_net_folds(spark, sf):
    """Every (alpha, l1_ratio) and fold of the grid with one feature, where the fit has a closed form."""
    found = PA.elastic_net_folds(_one_feature_folds(spark, sf), ["c_lines"], "label", _ENET_ALPHAS, _ENET_RATIOS)
    return rounded(found.select("fold", "alpha", "l1_ratio", F.col("coefficients")[0].alias("coef"), "rmse"), 4)


@query("t08_elastic_net_grid_search")
def t08_elastic_net_grid_search(spark, sf):
    """The reference's elastic net grid (30 points) by 5-fold CV, from one aggregation."""
    return PA.elastic_net_grid_search(_salary_folds(spark, sf), SAL_X, "label", _ENET_ALPHAS, _ENET_RATIOS)


_RIDGE_SQL = _curve_sql("alpha", "c * n / (v * n + alpha)").replace("{grid}", "(select unnest([0.01, 1.0, 100.0, 10000.0]::double[]) as alpha)")


@query("t08_ridge_one_feature", _RIDGE_SQL + f""", p as (select alpha, fold, sqrt(avg(r * r)) as rmse, 1 - sum(r * r) / (var_pop(y) * count(*)) as r2
  from e group by alpha, fold) select alpha, {R('avg(r2)', 4)} as mean_r2, {R('avg(rmse)', 4)} as mean_rmse from p group by alpha""")
def t08_ridge_one_feature(spark, sf):
    found = TU.ridge_grid_search(_one_feature_folds(spark, sf), ["c_lines"], "label", [0.01, 1.0, 100.0, 10000.0])
    return rounded(found.select("alpha", "mean_r2", "mean_rmse"), 4)


@query("t08_logistic_grid_search")
def t08_logistic_grid_search(spark, sf):
    """Ten values of C by 10-fold CV: all folds and values take their Newton steps in common passes."""
    scaled = _scaled_churn(spark, sf, 10)
    return PA.logistic_grid_search(scaled, CH_X, "label", [10.0 ** k for k in range(-5, 5)], metric="auc")[1]


def _scaled_churn(spark, sf, k):
    from tabulon.operators.encode import StandardScaler
    df = _churn_folds(spark, sf, k)
    return StandardScaler(inputCols=CH_X).fit(df).transform(df)


@query("t08_booster_grid_search")
def t08_booster_grid_search(spark, sf):
    """36 points of the leaf-wise booster: all folds and combinations grow in common passes, and the rounds are one fit's stages."""
    _, table = TU.grid_search(M.regressor("lgbm", num_leaves=8), {"learning_rate": [0.01, 0.1, 0.3], "colsample_bytree": [0.5, 0.7, 1.0], "n_estimators": [5, 10, 15, 20]},
                              _salary_folds(spark, sf), SAL_X, "label")
    return table


@query("t09_compare_models")
def t09_compare_models(spark, sf):
    """All regressors of the reference's comparison, each with its own library's parameters."""
    models = {n: M.regressor(n) for n in ("lr", "ridge", "lasso", "enet")} | {"knn": M.regressor("knn", mode="approximate")}
    models |= {n: M.regressor(n) for n in ("svr", "cart", "rf", "gbm", "xgb", "lgbm")} | {"catboost": M.regressor("catboost", **M.CATBOOST)}
    return TU.compare_models(models, _salary_folds(spark, sf), SAL_X, "label")


@query("t09_compare_classifiers")
def t09_compare_classifiers(spark, sf):
    """All classifiers of the reference's comparison, each with its own library's parameters."""
    models = {"logreg": M.classifier("logreg"), "knn": M.classifier("knn", mode="approximate")}
    models |= {n: M.classifier(n) for n in ("svc", "cart", "rf", "adaboost", "gbm", "xgb", "lgbm")} | {"catboost": M.classifier("catboost", **M.CATBOOST)}
    return TU.compare_models(models, _churn_folds(spark, sf), CH_X, "label", task="classification")


@query("t10_tune_models")
def t10_tune_models(spark, sf):
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
    cands = {"ridge": (M.Ridge(), {"alpha": [0.1, 1.0, 10.0]}),
             "enet": (M.ElasticNet(), {"alpha": [0.1, 1.0], "l1_ratio": [0.2, 0.8]}),
             "cart": (DecisionTreeRegressor(seed=42), {"maxDepth": [3, 6]}),
             "rf": (RandomForestRegressor(seed=42, numTrees=10), {"maxDepth": [3, 6]})}
    df = _salary_folds(spark, sf)
    held = F.col("p_partkey") % 5 == 0
    return TU.tune_models(cands, df.where(~held), SAL_X, "label", holdout=df.where(held))


@query("t12_validation_curve")
def t12_validation_curve(spark, sf):
    from pyspark.ml.regression import DecisionTreeRegressor
    return TU.validation_curve(DecisionTreeRegressor(seed=42), "maxDepth", [2, 4, 8],
                               _salary_folds(spark, sf, 3), SAL_X, "label")


@query("t12_validation_curve_rounds")
def t12_validation_curve_rounds(spark, sf):
    """The whole axis of rounds from one fit a fold, over 10 folds."""
    from pyspark.ml.regression import GBTRegressor
    return TU.validation_curve(GBTRegressor(seed=42, maxDepth=3), "maxIter", [5, 10, 20, 30], _salary_folds(spark, sf, 10), SAL_X, "label", metric="mae")


@query("t12_validation_curve_auc")
def t12_validation_curve_auc(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    return TU.validation_curve(RandomForestClassifier(seed=42, numTrees=10), "maxDepth", [2, 5, 8],
                               _churn_folds(spark, sf, 3), CH_X, "label", metric="roc_auc", task="classification")


@query("n03_stacking")
def n03_stacking(spark, sf):
    df = _salary_folds(spark, sf)
    st = TU.StackingRegressor([M.regressor("lr"), M.regressor("cart", max_depth=5)], SAL_X, "label").fit(df)
    return st.transform(df).select("p_partkey", "label", "prediction")


# ------------------------------------------------------------------ K01 - K04
@query("k01_kmeans")
def k01_kmeans(spark, sf):
    seg, _ = K.kmeans_segments(rfm_features(spark, sf), RFM_COLS, 4, seed=42)
    return seg.select("customer_id", "segment")


@query("k02_elbow")
def k02_elbow(spark, sf):
    return K.elbow(rfm_features(spark, sf), RFM_COLS, 2, 20, seed=42)


@query("k03_segment_profile", f"""select segment, count(*) as n, """ + ", ".join(
    f"{R(f'avg({c}::double)')} as {c}_mean, {R(f'min({c}::double)')} as {c}_min, "
    f"{R(f'max({c}::double)')} as {c}_max"
    for c in ["order_num_online", "order_num_offline", "value_online", "value_offline"])
       + f" from (select *, cast(customer_id % 4 as integer) as segment from {CUSTOMER_HISTORY_SQL}) group by segment")
def k03_segment_profile(spark, sf):
    h = customer_history(spark, sf).withColumn("segment", (F.col("customer_id") % 4).cast("int"))
    return rounded(K.segment_profile(h, "segment", ["order_num_online", "order_num_offline", "value_online",
                                                    "value_offline"]))


@query("k04_hierarchical_segments")
def k04_hierarchical_segments(spark, sf):
    seg, _ = K.hierarchical_segments(rfm_features(spark, sf), RFM_COLS, 5, seed=42)
    return seg.select("customer_id", "hsegment")


@query("k04_ward_segments")
def k04_ward_segments(spark, sf):
    seg, _ = K.ward_segments(rfm_features(spark, sf), RFM_COLS, 5)
    return seg.select("customer_id", "hsegment")


@query("k04_ward_dendrogram")
def k04_ward_dendrogram(spark, sf):
    """The last 30 merges of the tree, as a truncated dendrogram shows them."""
    _, tree = K.ward_segments(rfm_features(spark, sf), RFM_COLS, 5)
    return tree.table().orderBy(F.desc("step")).limit(30)


@query("k04_ward_total", f"""select count(*) as n, {R('sum(ss)', 3)} as sum_of_squares from (
  select c_custkey, power(c_acctbal - avg(c_acctbal) over (), 2) + power(c_nationkey - avg(c_nationkey) over (), 2) as ss from customer)""")
def k04_ward_total(spark, sf):
    """Ward's merges take up the whole sum of squares: half the squared heights and what is left within the summaries."""
    from tabulon.learn.ward import summaries, ward_merges
    from tabulon.sources.io import table
    c = table(spark, sf, "customer").select("c_acctbal", "c_nationkey")
    s = summaries(c, ["c_acctbal", "c_nationkey"])
    within = float((s.squares - (s.sums ** 2).sum(axis=1) / s.n).sum())
    total = within + float((ward_merges(s.n, s.centres)[:, 2] ** 2 / 2).sum())
    return rounded(c.agg(F.count(F.lit(1)).alias("n"), F.lit(total).alias("sum_of_squares")), 3)


# ------------------------------------------------------------------ M05: exact kNN with pivot pruning
_KNN_SQL = """with e as (select vec_id, label, embedding from embeddings),
d as (select a.vec_id as qid, b.vec_id as tid, b.label as tlabel,
        sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
             lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as dist
      from e a, e b where a.vec_id <> b.vec_id),
r as (select qid, tlabel, row_number() over (partition by qid order by dist, tid) as rn from d),
v as (select qid, tlabel, count(*) as c from r where rn <= 5 group by qid, tlabel)
select qid as vec_id, tlabel as prediction from (
  select qid, tlabel, row_number() over (partition by qid order by c desc, tlabel) as rn from v) where rn = 1"""


@query("m05_knn_classifier", _KNN_SQL)
def m05_knn_classifier(spark, sf):
    """Leave-one-out 5-NN label of every embedding (exact, pivot-pruned)."""
    from tabulon.learn.knn import knn_classify
    from tabulon.sources.io import table
    e = table(spark, sf, "embeddings")
    return knn_classify(e, e, "vec_id", "embedding", "label", k=5, exclude_self=True, n_pivots=32)


@query("m05_knn_approximate")
def m05_knn_approximate(spark, sf):
    """Leave-one-out 5-NN label of every embedding by multi-probe random projections."""
    from tabulon.learn.knn import approximate_neighbours
    from tabulon.sources.io import table
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    near = approximate_neighbours(e, e, "vec_id", "embedding", "label", k=5, exclude_self=True)
    votes = near.groupBy("qid", "tlabel").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("c")).alias("less"), F.col("tlabel"))).alias("b"))
    return best.select(F.col("qid").alias("vec_id"), F.col("b.tlabel").alias("prediction"))


@query("m05_knn_regressor")
def m05_knn_regressor(spark, sf):
    """5-NN regression of the part price from scaled salary features (rows-only; ties in distance are common)."""
    from tabulon.learn.knn import knn_regress
    from tabulon.operators.encode import StandardScaler
    s = _salary_folds(spark, sf)
    scaled = StandardScaler(inputCols=SAL_X).fit(s).transform(s)
    vec = scaled.select("p_partkey", F.array(*SAL_X).alias("x"), "label")
    return knn_regress(vec, vec, "p_partkey", "x", "label", k=5, exclude_self=True, n_pivots=128)


@query("t08_ridge_grid_search")
def t08_ridge_grid_search(spark, sf):
    """The reference's 1,000-alpha ridge grid (logspace(-5, 5)) by 5-fold CV, from one aggregation."""
    import numpy as np
    return TU.ridge_grid_search(_salary_folds(spark, sf), SAL_X, "label", list(np.logspace(-5, 5, 1000)))


# ------------------------------------------------------------------ SURVEY section 3: whole flows (rows-only)
@query("s31_house_price_flow")
def s31_house_price_flow(spark, sf):
    from tabulon.plans.flows import house_price_flow
    return house_price_flow(spark, sf)


@query("s32_churn_flow")
def s32_churn_flow(spark, sf):
    from tabulon.plans.flows import churn_flow
    return churn_flow(spark, sf)


@query("s33_scouting_flow")
def s33_scouting_flow(spark, sf):
    from tabulon.plans.flows import scouting_flow
    return scouting_flow(spark, sf)


@query("s34_segmentation_flow")
def s34_segmentation_flow(spark, sf):
    """RFM features, k from the elbow of 2..19, k-means segments and their profile, then hierarchical segments and theirs."""
    feats = rfm_features(spark, sf).persist()
    knee = K.elbow(feats, RFM_COLS, 2, 20, seed=42).where("is_knee = 1").first()
    k = knee["k"] if knee else 2
    seg, _ = K.kmeans_segments(feats, RFM_COLS, k, seed=42)
    tree, _ = K.ward_segments(feats, RFM_COLS, k)
    feats.unpersist()
    one = K.segment_profile(seg, "segment", RFM_COLS).withColumn("method", F.lit("kmeans"))
    two = K.segment_profile(tree, "hsegment", RFM_COLS).withColumnRenamed("hsegment", "segment").withColumn("method", F.lit("hierarchical"))
    return one.unionByName(two)


# ------------------------------------------------------------------ invariants of fitted models, stated in SQL
def _in_label_range(df, pred="prediction", label="label"):
    """Rows, rows with a prediction, and rows whose prediction lies within the labels: what averaging trees must give."""
    lim = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    eps = 1e-9 * max(1.0, abs(lim["hi"]))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(pred).alias("n_predicted"),
                  F.count_if(F.col(pred).between(lim["lo"] - eps, lim["hi"] + eps)).alias("n_in_range"))


_ALL_IN_RANGE = f"select count(*) as n, count(*) as n_predicted, count(*) as n_in_range from {SALARY_SQL}"


@query("m06_tree_invariants", _ALL_IN_RANGE)
def m06_tree_invariants(spark, sf):
    return _in_label_range(m06_decision_tree(spark, sf))


@query("m07_forest_invariants", _ALL_IN_RANGE)
def m07_forest_invariants(spark, sf):
    return _in_label_range(_fit_score(spark, sf, M.regressor("rf", n_estimators=20, max_depth=8)))


_EQUAL_MEANS = " union all ".join(f"select '{m}' as model, count(*) as n, {R('avg(p_retailprice)', 3)} as mean_prediction from {SALARY_SQL}"
                                  for m in ("gbm", "xgb", "lgbm", "catboost"))


@query("m09_mean_invariants", _EQUAL_MEANS)
def m09_mean_invariants(spark, sf):
    """Boosting of squares without a penalty keeps the sum of residuals at 0: predictions have the labels' mean."""
    out, df = None, _salary_folds(spark, sf)
    for name, params in (("gbm", {}), ("xgb", {"reg_lambda": 0.0}), ("lgbm", {"reg_lambda": 0.0}), ("catboost", {"reg_lambda": 0.0})):
        p = _scored(df, M.regressor(name, n_estimators=5, **params))
        row = p.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))
        out = row if out is None else out.unionByName(row)
    return rounded(out, 3)


@query("m11_mean_invariant", f"""select count(*) as n, {R('avg(case when last_date is null or last_date < day - 180 then 1 else 0 end)', 5)} as mean_chance
  from customer left join (select o_custkey, cast(max(o_orderdate) as date) as last_date from orders group by o_custkey) on c_custkey = o_custkey,
       (select cast(max(o_orderdate) as date) as day from orders)""")
def m11_mean_invariant(spark, sf):
    """The intercept is not penalised, so the chances of a logistic model have the mean of the labels."""
    df = _scaled_churn(spark, sf, 5)
    fits = PA.logistic_fits(df, CH_X, "label", [1.0])
    chance = 1 / (1 + F.exp(-PA.linear_by_fold(CH_X, {f: fits.fit(1.0) for f in range(5)})))
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), F.avg(chance).alias("mean_chance")), 5)


@query("m15_predict_one_feature", f"""with s as (select p_partkey, p_retailprice as y, c_lines as x from {SALARY_SQL}),
f as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from s where p_partkey % 2 = 0)
select p_partkey, {R('a * x + b', 3)} as prediction from s, f where p_partkey % 2 = 1""")
def m15_predict_one_feature(spark, sf):
    """Fit on even keys, score odd ones: least squares of one feature, so that SQL has the same values."""
    s = salary(spark, sf).select("p_partkey", "c_lines", F.col("p_retailprice").alias("label"))
    _, pred = M.fit_predict(M.regressor("lr"), s.where("p_partkey % 2 = 0"), s.where("p_partkey % 2 = 1"), ["c_lines"])
    return rounded(pred.select("p_partkey", "prediction"), 3)


@query("m10_class_invariants", f"""select m as model, count(*) as n, count(*) as n_of_a_class
  from (select unnest(['gbm', 'logreg', 'adaboost', 'cart']) as m), customer group by m""")
def m10_class_invariants(spark, sf):
    """Every customer gets one of the two classes from every classifier."""
    out, df = None, _churn_folds(spark, sf)
    for name, params in (("gbm", {"n_estimators": 5}), ("logreg", {}), ("adaboost", {"n_estimators": 5}), ("cart", {"max_depth": 8})):
        p = _scored(df, M.classifier(name, **params), "c_custkey", CH_X)
        row = p.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isin(0.0, 1.0)).alias("n_of_a_class"))
        out = row if out is None else out.unionByName(row)
    return out


@query("m14_importance_invariants", "select 1.0 as total, 0 as n_negative")
def m14_importance_invariants(spark, sf):
    df = _salary_folds(spark, sf)
    model, _ = M.fit_predict(M.regressor("cart", max_depth=8), df, df.limit(0), SAL_X)
    imp = M.feature_importance(model, SAL_X)
    return imp.agg(F.round(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).cast("int").alias("n_negative"))


@query("t09_out_of_fold_rows", """select cast(r % 5 as integer) as fold, count(*) as n from (
  select row_number() over (order by p_partkey) - 1 as r from part) group by 1""")
def t09_out_of_fold_rows(spark, sf):
    """Every row is scored once, by the model that did not see its fold (folds by position modulo 5)."""
    from tabulon.functions.ranking import row_index
    df = row_index(_salary_folds(spark, sf).drop("fold"), ["p_partkey"], name="r").withColumn("fold", (F.col("r") % 5).cast("int")).drop("r")
    oof = TU.out_of_fold(M.regressor("lr"), df, SAL_X, "label", keep=["p_partkey"])
    return oof.where(F.col("prediction").isNotNull()).groupBy("fold").agg(F.count_distinct("p_partkey").alias("n"))


@query("k01_nearest_centre", "select count(distinct o_custkey) as n, count(distinct o_custkey) as n_nearest, 1 as sizes_descend from orders")
def k01_nearest_centre(spark, sf):
    """Each customer is in the segment of the nearest centre, and segments are numbered by falling size."""
    seg, model = K.kmeans_segments(rfm_features(spark, sf), RFM_COLS, 4, seed=42)
    far = [sum((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(RFM_COLS, centre)) for centre in model.clusterCenters()]
    sizes = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy("segment").collect()  # k rows
    falls = int(all(a["n"] >= b["n"] for a, b in zip(sizes, sizes[1:])))
    # segments are renumbered centres: the nearest centre must be the same for a whole segment
    place = seg.withColumn("near", F.array_position(F.array(*far), F.array_min(F.array(*far))))
    whole = place.groupBy("segment").agg(F.mode("near").alias("centre"))
    near = place.join(whole, "segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("near") == F.col("centre")).alias("n_nearest"))
    return near.withColumn("sizes_descend", F.lit(falls))


@query("k02_cost_falls", "select 18 as n, 1 as n_knees from (select count(*) from customer)")
def k02_cost_falls(spark, sf):
    """One knee among the 18 values of k; the curve starts higher than it ends."""
    e = K.elbow(rfm_features(spark, sf), RFM_COLS, 2, 20, seed=42)
    return e.agg(F.count(F.lit(1)).cast("int").alias("n"),
                 F.sum(F.col("is_knee")).cast("int").alias("n_knees"))
