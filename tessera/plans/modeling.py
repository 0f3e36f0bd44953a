"""Registered model queries (P8, M9, L1-L8, S6, S8, W11).  Boosted-tree fits are
iterative Spark ML jobs without an SQL twin (rows-only check); the least squares
of one feature, its scaling, predictions, metrics, importance, contributions,
folds and stored form are checked against ``regr_slope`` and ``regr_intercept``,
and so is the prepared matrix of a saved model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera import config as C
from tessera.ml import models as ml
from tessera.ml.prepare import MatrixPreparer, model_features, split_kinds
from tessera.ml.run import train_and_compare as run_all
from tessera.operators import clean, features as ft, stats as st
from tessera.plans.cleaning import _scratch, f4_split_sql
from tessera.plans.common import PANEL_SQL, finish, r6
from tessera.plans.scoring import _metric_sql
from tessera.session import materialize
from tessera.sources import fixtures as fx

SPEC = fx.EVENTS_SPEC


def _raw_frame(spark, sf_dir):
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir, extra=True), SPEC)
    feats = st.raw_model_columns(p)
    return ml.model_frame(p, feats, SPEC.target), feats


def _engineered_frame(spark, sf_dir):
    e = clean.temporal_split(ft.engineer_optimized(fx.hourly_panel(spark, sf_dir, extra=True), SPEC), SPEC)
    e = materialize(e)
    frames = [e.where(F.col("split") == s) for s in ("train", "val", "test")]
    feats = st.common_numeric(frames, exclude=[SPEC.target, SPEC.key, SPEC.time, "split"])
    return ml.model_frame(e, feats, SPEC.target), feats


def _train(df):
    return df.where(F.col("split") == "train")


def linear_one_feature(spark, sf_dir):
    """L1 on one feature: least squares of the target on its 1-row lag over
    the train split; slope, intercept and rows used."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)
    p = ft.window_features(p, SPEC, [ft.Lag(SPEC.target, 1, "lag1")])
    d = _train(p).dropna(subset=[SPEC.target, "lag1"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["lag1"], outputCol="_f"),
                            LinearRegression(featuresCol="_f", labelCol=SPEC.target, regParam=0.0,
                                             standardization=False, solver="normal")])
    lr = pipe.fit(d).stages[-1]
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return finish(n.select(F.lit(float(lr.coefficients[0])).alias("slope"),
                           F.lit(float(lr.intercept)).alias("intercept"), F.col("n").cast("long")))


def linear_metrics(spark, sf_dir):
    """L1 + L5: standardised least squares on the raw columns (train medians
    filled), metrics per split."""
    df, feats = _raw_frame(spark, sf_dir)
    m = ml.fit("linear", _train(df), feats, SPEC.target)
    return finish(m.evaluate(df, ["split"], full=True))


def gbt_metrics(spark, sf_dir):
    """L2 + L5: boosted trees on the C3 features, metrics per split."""
    df, feats = _engineered_frame(spark, sf_dir)
    m = ml.fit("gbt", _train(df), feats, SPEC.target)
    return finish(m.evaluate(df, ["split"], full=True))


def feature_importance(spark, sf_dir):
    """L6 + T4: top 15 importances of the linear and boosted models."""
    df, feats = _engineered_frame(spark, sf_dir)
    lin = ml.fit("linear", _train(df), feats, SPEC.target)
    gbt = ml.fit("gbt", _train(df), feats, SPEC.target)
    a = st.top_k(lin.importance(), "importance", C.TOP_FEATURES).withColumn("model", F.lit("linear"))
    b = st.top_k(gbt.importance(), "importance", C.TOP_FEATURES).withColumn("model", F.lit("gbt"))
    return finish(a.unionByName(b))


def cv_scores(spark, sf_dir):
    """W11 + L1: 5-fold expanding time cross-validation of the linear model on train."""
    df, feats = _raw_frame(spark, sf_dir)
    return finish(ml.cross_validate("linear", _train(df), SPEC, feats, SPEC.target))


def hyper_search(spark, sf_dir):
    """L3: seeded random search of boosted-tree parameters, 50 trials in the whole
    space, scored on val."""
    df, feats = _raw_frame(spark, sf_dir)
    return finish(ml.random_search(_train(df), df.where(F.col("split") == "val"), feats, SPEC.target))


def tuned_training(spark, sf_dir):
    """L2 + L3 + W11: the same search, a fit with its best parameters, train and
    val RMSE, mean and deviation of five folds' RMSEs."""
    df, feats = _raw_frame(spark, sf_dir)
    return finish(ml.tuned_fit(_train(df), df.where(F.col("split") == "val"), SPEC, feats, SPEC.target)[1])


def gbt_validation_stop(spark, sf_dir):
    """L2 with the validation split: trees grown and kept, train and val RMSE, by
    both rules (patience over all prefixes, first tree that brings too little)."""
    df, feats = _engineered_frame(spark, sf_dir)
    val = df.where(F.col("split") == "val")
    rows = [(rule, *ml.fit_stopped(_train(df), val, feats, SPEC.target, rule=rule).metrics.values()) for rule in ("patience", "first")]
    return finish(spark.createDataFrame(rows, "rule string, trees double, grown double, train_rmse double, val_rmse double"))


def linear_attribution(spark, sf_dir):
    """L7 (linear): exact contributions on all test rows, summarised as mean
    |contribution| per feature."""
    df, feats = _engineered_frame(spark, sf_dir)
    m = ml.fit("linear", _train(df), feats, SPEC.target)
    return finish(ml.linear_attribution(m, df.where(F.col("split") == "test")))


def permutation_importance(spark, sf_dir):
    """L7 (trees): RMSE increase per permuted feature over all test rows."""
    df, feats = _engineered_frame(spark, sf_dir)
    m = ml.fit("gbt", _train(df), feats, SPEC.target)
    return finish(ml.permutation_importance(m, df.where(F.col("split") == "test")))


def train_and_compare_leak_safe(spark, sf_dir):
    """L8 on features that hold nothing of their row's target."""
    return finish(run_all(fx.hourly_panel(spark, sf_dir, extra=True), SPEC, leak_safe=True).comparison)


# ------------------------------------------------------------------ least squares of one feature

def _lag_frame(spark, sf_dir):
    """Rows of a split with the target and the row before's, ``lag1``."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)
    p = ft.window_features(p, SPEC, [ft.Lag(SPEC.target, 1, "lag1")])
    return materialize(p.select("station", "datetime", "split", "lag1", SPEC.target).dropna())


def _lag_model(spark, sf_dir):
    df = _lag_frame(spark, sf_dir)
    return df, ml.fit("linear", _train(df), ["lag1"], SPEC.target)


def linear_scaled_fit(spark, sf_dir):
    """M9 + L1: coefficient per population deviation, intercept, mean, deviation."""
    df, m = _lag_model(spark, sf_dir)
    scaler, lr = m.model.stages[1], m.model.stages[-1]
    row = (float(lr.coefficients[0]), float(lr.intercept), float(scaler.mean[0]), float(scaler.std[0]))
    return finish(spark.createDataFrame([row], "coefficient double, intercept double, mean double, std double"))


def linear_predictions(spark, sf_dir):
    """L4: prediction of every row."""
    df, m = _lag_model(spark, sf_dir)
    return finish(m.predict(df).select("station", "datetime", "split", "p"))


def linear_evaluation(spark, sf_dir):
    """The full metric set per split."""
    df, m = _lag_model(spark, sf_dir)
    return finish(m.evaluate(df, ["split"], full=True))


def linear_importance(spark, sf_dir):
    """|coefficient| per deviation."""
    return finish(_lag_model(spark, sf_dir)[1].importance())


def linear_row_contributions(spark, sf_dir):
    """Each test row's contribution."""
    df, m = _lag_model(spark, sf_dir)
    return finish(ml.linear_contributions(m, df.where(F.col("split") == "test"), ["station", "datetime"]))


def linear_mean_contribution(spark, sf_dir):
    """Mean |contribution| over all test rows."""
    df, m = _lag_model(spark, sf_dir)
    return finish(ml.linear_attribution(m, df.where(F.col("split") == "test")))


def saved_predictions(spark, sf_dir):
    """S6 + S8 + L4: the model saved, loaded, and applied; with the metrics kept
    beside it."""
    df, m = _lag_model(spark, sf_dir)
    m.metrics = {r["split"]: float(r["rmse"]) for r in m.evaluate(df).collect()}  # three splits
    path = _scratch(spark, "model")
    m.save(path)
    back = ml.Fitted.load(path)
    kept = spark.createDataFrame(list(back.metrics.items()), "split string, kept_rmse double")
    return finish(back.predict(df).join(F.broadcast(kept), "split").select("station", "datetime", "split", "p", "kept_rmse"))


def linear_folds(spark, sf_dir):
    """RMSE of each of five expanding time folds on train."""
    return finish(ml.cross_validate("linear", _train(_lag_frame(spark, sf_dir)), SPEC, ["lag1"], SPEC.target))


def linear_two_features(spark, sf_dir):
    """L1 + M9 on two features: coefficients per population deviation, intercept,
    and the test RMSE of the fitted pipeline."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)
    p = ft.window_features(p, SPEC, [ft.Lag(SPEC.target, 1, "lag1"), ft.Lag("PM10", 1, "other1")])
    df = materialize(p.select("split", "lag1", "other1", SPEC.target).dropna())
    m = ml.fit("linear", _train(df), ["lag1", "other1"], SPEC.target)
    lr, test = m.model.stages[-1], m.evaluate(df.where(F.col("split") == "test"), [])
    a, b = (F.lit(float(x)) for x in lr.coefficients)
    return finish(test.select(a.alias("a"), b.alias("b"), F.lit(float(lr.intercept)).alias("intercept"), "rmse", "n"))


# ------------------------------------------------------------------ P8

def _string_panel(spark, sf_dir):
    """The split panel with strings, a flag and nulls among its features."""
    p = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC).where(F.col("split").isNotNull())
    h = F.hour("datetime")
    return p.select("station", "datetime", "split", SPEC.target, "PM10", "TEMP", F.when(F.col("hh") % 30 != 4, F.col("wd")).alias("wd"),
                    F.when(h < 12, "am").when(h < 20, "pm").alias("part"), (F.weekday("datetime") >= 5).alias("weekend"))


def prepared_matrix(spark, sf_dir):
    """Medians, modes and label codes of train applied to all splits."""
    p = _string_panel(spark, sf_dir)
    numeric, categorical = split_kinds(p, model_features(p, [SPEC.target, "station", "datetime", "split"]))
    m = MatrixPreparer(numeric=numeric, categorical=categorical).fit(_train(p))
    return finish(m.transform(p))


def prepared_saved(spark, sf_dir):
    """P8 + L1 + S8: a pipeline of preparation and model, fitted on train, saved and
    loaded; the matrix as its loaded first stage makes it."""
    p = _string_panel(spark, sf_dir)
    m = ml.fit_prepared(_train(p), model_features(p, [SPEC.target, "station", "datetime", "split"]), SPEC.target, "linear")
    path = _scratch(spark, "prepared")
    m.save(path)
    return finish(ml.Fitted.load(path).model.stages[0].transform(p))


def train_and_compare(spark, sf_dir):
    """Clean -> engineer -> linear baseline vs boosted trees -> comparison table."""
    res = run_all(fx.hourly_panel(spark, sf_dir, extra=True), SPEC)
    return finish(res.comparison)


QUERIES = {
    "linear_one_feature": linear_one_feature,
    "linear_metrics": linear_metrics,
    "gbt_metrics": gbt_metrics,
    "feature_importance": feature_importance,
    "cv_scores": cv_scores,
    "hyper_search": hyper_search,
    "tuned_training": tuned_training,
    "linear_attribution": linear_attribution,
    "permutation_importance": permutation_importance,
    "train_and_compare": train_and_compare,
    "train_and_compare_leak_safe": train_and_compare_leak_safe,
    "gbt_validation_stop": gbt_validation_stop,
    "linear_scaled_fit": linear_scaled_fit,
    "linear_predictions": linear_predictions,
    "linear_evaluation": linear_evaluation,
    "linear_importance": linear_importance,
    "linear_row_contributions": linear_row_contributions,
    "linear_mean_contribution": linear_mean_contribution,
    "saved_predictions": saved_predictions,
    "linear_folds": linear_folds,
    "linear_two_features": linear_two_features,
    "prepared_matrix": prepared_matrix,
    "prepared_saved": prepared_saved,
}

_LAG_SQL = f"""
  WITH d AS (
    SELECT station, datetime, split, lag1, PM2_5 AS y FROM (
      SELECT *, lag(PM2_5, 1) OVER (PARTITION BY station ORDER BY datetime) AS lag1 FROM ({f4_split_sql(PANEL_SQL)}))
    WHERE split IS NOT NULL AND lag1 IS NOT NULL AND PM2_5 IS NOT NULL),
  m AS (SELECT regr_slope(y, lag1) AS a, regr_intercept(y, lag1) AS b, avg(y) AS my, avg(lag1) AS mx, stddev_pop(lag1) AS sx
    FROM d WHERE split = 'train'),
  scored AS (SELECT station, datetime, split, lag1, y, a * lag1 + b AS p, a * (lag1 - mx) AS c FROM d, m)
"""

_PREPARED_SQL = f"""
  WITH p AS (
    SELECT station, datetime, split, PM2_5, PM10, TEMP, CASE WHEN hh % 30 <> 4 THEN wd END AS wd,
      CASE WHEN hour(datetime) < 12 THEN 'am' WHEN hour(datetime) < 20 THEN 'pm' END AS part, isodow(datetime) >= 6 AS weekend
    FROM ({f4_split_sql(PANEL_SQL)}) WHERE split IS NOT NULL),
  t AS (SELECT * FROM p WHERE split = 'train'),
  med AS (SELECT quantile_cont(PM10, 0.5) AS PM10, quantile_cont(TEMP, 0.5) AS TEMP, quantile_cont(weekend::INT, 0.5) AS weekend FROM t),
  wm AS (SELECT wd AS v FROM t WHERE wd IS NOT NULL GROUP BY wd ORDER BY count(*) DESC, wd LIMIT 1),
  pm AS (SELECT part AS v FROM t WHERE part IS NOT NULL GROUP BY part ORDER BY count(*) DESC, part LIMIT 1),
  wc AS (SELECT wd AS v, row_number() OVER (ORDER BY wd) - 1 AS code FROM (SELECT DISTINCT wd FROM t WHERE wd IS NOT NULL)),
  pc AS (SELECT part AS v, row_number() OVER (ORDER BY part) - 1 AS code FROM (SELECT DISTINCT part FROM t WHERE part IS NOT NULL))
  SELECT station, datetime, split, {r6('p.PM2_5')} AS PM2_5, {r6('coalesce(p.PM10, med.PM10)')} AS PM10, {r6('coalesce(p.TEMP, med.TEMP)')} AS TEMP,
    {r6('coalesce(wc.code, (SELECT count(*) FROM wc))')} AS wd, {r6('coalesce(pc.code, (SELECT count(*) FROM pc))')} AS part,
    {r6('coalesce(p.weekend::INT, med.weekend)')} AS weekend
  FROM p CROSS JOIN med LEFT JOIN wc ON wc.v = coalesce(p.wd, (SELECT v FROM wm)) LEFT JOIN pc ON pc.v = coalesce(p.part, (SELECT v FROM pm))"""

SQL = {
    "linear_one_feature": f"""
      SELECT {r6('regr_slope(PM2_5, lag1)')} AS slope, {r6('regr_intercept(PM2_5, lag1)')} AS intercept,
             count(*)::BIGINT AS n
      FROM (SELECT *, lag(PM2_5, 1) OVER (PARTITION BY station ORDER BY datetime) AS lag1
            FROM ({f4_split_sql(PANEL_SQL)}))
      WHERE split = 'train' AND PM2_5 IS NOT NULL AND lag1 IS NOT NULL""",
    "linear_scaled_fit": f"{_LAG_SQL} SELECT {r6('a * sx')} AS coefficient, {r6('my')} AS intercept, {r6('mx')} AS mean, {r6('sx')} AS std FROM m",
    "linear_predictions": f"{_LAG_SQL} SELECT station, datetime, split, {r6('p')} AS p FROM scored",
    "linear_evaluation": f"{_LAG_SQL} SELECT split, {_metric_sql(True)} FROM scored GROUP BY split",
    "linear_importance": f"{_LAG_SQL} SELECT 'lag1' AS feature, {r6('abs(a * sx)')} AS importance FROM m",
    "linear_row_contributions": f"{_LAG_SQL} SELECT station, datetime, 'lag1' AS feature, {r6('c')} AS contribution FROM scored WHERE split = 'test'",
    "linear_mean_contribution": f"{_LAG_SQL} SELECT 'lag1' AS feature, {r6('avg(abs(c))')} AS mean_abs_contribution FROM scored WHERE split = 'test'",
    "saved_predictions": f"""{_LAG_SQL} SELECT station, datetime, split, {r6('p')} AS p,
      {r6('sqrt(avg((y - p) * (y - p)) OVER (PARTITION BY split))')} AS kept_rmse FROM scored""",
    "linear_folds": f"""{_LAG_SQL},
      s AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS step FROM (SELECT DISTINCT datetime FROM d WHERE split = 'train')),
      n AS (SELECT count(*) AS n, count(*) // 6 AS size FROM s),
      f AS (SELECT fold, n - (5 - fold) * size AS lo, n - (5 - fold) * size + size AS hi FROM range(5) AS r(fold), n),
      x AS (SELECT fold, step < lo AS fit, lag1, y FROM d JOIN s USING (datetime), f WHERE d.split = 'train' AND step < hi),
      k AS (SELECT fold, regr_slope(y, lag1) AS a, regr_intercept(y, lag1) AS b, count(*) AS n_train FROM x WHERE fit GROUP BY fold)
      SELECT fold::BIGINT AS fold, n_train::BIGINT AS n_train, count(*)::BIGINT AS n_test, {r6('sqrt(avg((y - a * lag1 - b) * (y - a * lag1 - b)))')} AS rmse
      FROM x JOIN k USING (fold) WHERE NOT fit GROUP BY fold, n_train""",
    "prepared_matrix": _PREPARED_SQL,
    "prepared_saved": _PREPARED_SQL,
    "linear_two_features": f"""
      WITH d AS (
        SELECT split, x, z, PM2_5 AS y FROM (
          SELECT *, lag(PM2_5, 1) OVER w AS x, lag(PM10, 1) OVER w AS z FROM ({f4_split_sql(PANEL_SQL)})
          WINDOW w AS (PARTITION BY station ORDER BY datetime))
        WHERE split IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL AND PM2_5 IS NOT NULL),
      c AS (SELECT var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy,
              avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM d WHERE split = 'train'),
      b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, * FROM c)
      SELECT {r6('any_value(bx * sqrt(xx))')} AS a, {r6('any_value(bz * sqrt(zz))')} AS b, {r6('any_value(my)')} AS intercept,
        {r6('sqrt(avg((y - my - bx * (x - mx) - bz * (z - mz)) * (y - my - bx * (x - mx) - bz * (z - mz))))')} AS rmse, count(*)::BIGINT AS n
      FROM d, b WHERE split = 'test'""",
}
