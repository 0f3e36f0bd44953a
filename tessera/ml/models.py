"""Model operators as Spark ML jobs.

* Linear baseline: ``VectorAssembler -> PopulationScaler ->
  LinearRegression(regParam=0)``; the normal-equation solver aggregates
  XᵀX per partition, so the fit is one pass over the rows whatever their count.
* Boosted trees: ``GBTRegressor`` (per-level histogram aggregation on executors),
  stopped by the validation rows inside the fit, or cut to its best first trees.
* Fits that don't depend on each other (trials, folds) run together from a bounded
  pool, so the cluster is busy while one of them waits for its driver.
* Everything that scores (metrics, cross-validation, search, attribution) is
  ``transform`` + one aggregate; only coefficients, trees and metric rows
  reach the driver.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as C
from tessera.config import PanelSpec
from tessera.ml.prepare import MatrixPreparer, PopulationScaler, split_kinds
from tessera.ml.validation import fold_bounds, time_steps
from tessera.operators import metrics as mt
from tessera.operators import stats as st
from tessera.operators.sequence import POS, with_position
from tessera.session import materialize, wide_tables

FEATURES = "_features"
SCALED = "_scaled"
IS_VAL = "_is_val"
#: Fits that run at the same time.
POOL = 8
#: Rows of a fit's table that make a task worth its start.
ROWS_PER_TASK = 50_000


def together(spark: SparkSession, jobs: Sequence[Callable], width: int = POOL) -> list:
    """The results of ``jobs`` in order, at most ``width`` of them running at once."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(lambda f: f(), map(inheritable_thread_target(spark), jobs)))


# ---------------------------------------------------------------- pipelines

def linear_pipeline(features: Sequence[str], label: str) -> Pipeline:
    """L1 (+ M9): standardise (mean 0, unit population deviation) then ordinary
    least squares."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol=FEATURES),
        PopulationScaler(inputCol=FEATURES, outputCol=SCALED),
        LinearRegression(featuresCol=SCALED, labelCol=label, regParam=0.0, elasticNetParam=0.0,
                         standardization=False, solver="normal"),
    ])


def gbt_pipeline(features: Sequence[str], label: str, params: dict | None = None) -> Pipeline:
    """L2: gradient-boosted regression trees (defaults: 100 trees, depth 6,
    step 0.3, seed 42)."""
    p = dict(C.GBT_PARAMS)
    p.update(params or {})
    frac = p.pop("featureSubsetFraction", None)
    if frac is not None and "featureSubsetStrategy" not in p:
        p["featureSubsetStrategy"] = repr(float(frac)) if frac < 1 else "all"
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol=FEATURES),
        GBTRegressor(featuresCol=FEATURES, labelCol=label, **p),
    ])


@dataclass
class Fitted:
    """A fitted pipeline with its feature names, label and metrics."""
    model: PipelineModel | None
    features: list[str]
    label: str
    kind: str
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)

    def _require(self):
        if self.model is None:
            raise ValueError("Model must be trained first")

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        """L4: batch scoring; returns ``df`` plus the prediction column."""
        self._require()
        scored = self.model.transform(df).withColumnRenamed("prediction", out)
        return scored.drop(FEATURES, SCALED)

    def evaluate(self, df: DataFrame, by: Sequence[str] = ("split",), full: bool = False) -> DataFrame:
        """Predict + metrics (A12, or A13 with ``full``) per group."""
        s = self.predict(df).withColumn("y", F.col(self.label))
        return mt.metrics(s, by, full=full)

    def importance(self) -> DataFrame:
        """Linear: |coefficient| on standardised features; trees: gain
        importance.  Sorted descending (T3)."""
        self._require()
        spark = SparkSession.active()
        last = self.model.stages[-1]
        if self.kind == "linear":
            vals = [abs(float(v)) for v in last.coefficients.toArray()]
        else:
            vals = [float(v) for v in last.featureImportances.toArray()]
        df = spark.createDataFrame(list(zip(self.features, vals)), "feature string, importance double")
        return df.orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        """Spark ML persistence plus a JSON metadata table beside it."""
        self._require()
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"features": self.features, "label": self.label, "kind": self.kind,
                "params": {k: (v if isinstance(v, (int, float, str, bool)) else str(v)) for k, v in self.params.items()},
                "metrics": self.metrics}
        SparkSession.active().createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "Fitted":
        meta = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])
        return Fitted(PipelineModel.load(f"{path}/model"), meta["features"], meta["label"], meta["kind"],
                      meta.get("params", {}), meta.get("metrics", {}))


def fit(kind: str, train: DataFrame, features: Sequence[str], label: str, params: dict | None = None) -> Fitted:
    pipe = linear_pipeline(features, label) if kind == "linear" else gbt_pipeline(features, label, params)
    model, kept = pipe.fit(train if kind == "linear" else in_few_tasks(train)), dict(params or {})
    if kind == "linear":
        kept["n_rows"] = int(model.stages[-1].summary.numInstances)
    return Fitted(model, list(features), label, kind, kept)


def prepared_pipeline(df: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", params: dict | None = None) -> Pipeline:
    """P8 + L1/L2: the matrix preparation (train medians, modes, label codes) as
    the first stage of the model, fitted and saved with it."""
    numeric, categorical = split_kinds(df, features)
    model = linear_pipeline(features, label) if kind == "linear" else gbt_pipeline(features, label, params)
    return Pipeline(stages=[MatrixPreparer(numeric=numeric, categorical=categorical), *model.getStages()])


def fit_prepared(train: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", params: dict | None = None) -> Fitted:
    """A model of raw columns, strings and nulls among them; rows without a
    label have no part in the fit."""
    rows = train.select(*features, label).where(F.col(label).isNotNull())
    return Fitted(prepared_pipeline(rows, features, label, kind, params).fit(rows), list(features), label, kind, dict(params or {}))


# ---------------------------------------------------------------- L2: validation stop

def boosted_frame(train: DataFrame, val: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(label, vector, is_val) of both splits, written once for all fits over them."""
    one = lambda df, v: df.select(*features, label, F.lit(v).alias(IS_VAL))
    d = VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(one(train, False).unionByName(one(val, True)))
    return in_few_tasks(materialize(d.select(label, FEATURES, IS_VAL)))


def in_few_tasks(df: DataFrame) -> DataFrame:
    """A stored table in no more partitions than its rows are worth: a boosted fit
    runs a job for every level of every tree."""
    return df.coalesce(max(1, math.ceil(df.count() / ROWS_PER_TASK)))


def rmse_by_split(model, frame: DataFrame, label: str) -> dict[bool, float]:
    """{is_val: RMSE} of a tree model over a boosted frame, one aggregate."""
    err = F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2)).alias("rmse")
    return {r[IS_VAL]: float(r["rmse"]) for r in model.transform(frame).groupBy(IS_VAL).agg(err).collect()}


def best_prefix(errors: Sequence[float], rounds: int = C.EARLY_STOPPING_ROUNDS, min_delta: float = C.EARLY_STOPPING_MIN_DELTA) -> int:
    """How many first trees to keep: those up to the best error seen when for
    ``rounds`` trees none was better than the best by more than ``min_delta``."""
    best, at = math.inf, 0
    for k, e in enumerate(errors):
        if e < best - min_delta:
            best, at = e, k + 1
        elif k + 1 - at >= rounds:
            break
    return max(at, 1)


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The boosted model of the first ``n`` trees of ``model``."""
    if n >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = java.trees()[k], float(model.treeWeights[k])
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    out = GBTRegressionModel(java.copyValues(cut, gateway.jvm.org.apache.spark.ml.param.ParamMap.empty()))
    return model._copyValues(out)


def fit_stopped(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, params: dict | None = None,
                rule: str = "patience", rounds: int = C.EARLY_STOPPING_ROUNDS, min_delta: float = C.EARLY_STOPPING_MIN_DELTA) -> Fitted:
    """L2 with a validation split. rule="patience": all trees are grown on the train
    rows, the error of every prefix is read off the validation rows in one pass,
    and the model keeps its trees up to the best one within ``rounds`` (see
    :func:`best_prefix`). rule="first": the fit itself ends at the first tree
    that takes less than ``min_delta`` off the validation error. ``metrics``
    has the number of trees kept and both RMSEs."""
    if rule not in ("patience", "first"):
        raise ValueError("rule must be 'patience' or 'first'")
    frame = boosted_frame(train, val, features, label)
    more = {"validationIndicatorCol": IS_VAL, "validationTol": min_delta} if rule == "first" else {}
    gbt = gbt_pipeline(features, label, {**(params or {}), **more}).getStages()[-1]
    model = gbt.fit(frame if more else frame.where(~F.col(IS_VAL)))
    grown = model.getNumTrees
    if rule == "patience":
        errors = [math.sqrt(e) for e in model.evaluateEachIteration(frame.where(IS_VAL), "squared")]
        model = first_trees(model, best_prefix(errors, rounds, min_delta))
    rmse = rmse_by_split(model, frame, label)
    stages = [VectorAssembler(inputCols=list(features), outputCol=FEATURES), model]
    metrics = {"trees": float(model.getNumTrees), "grown": float(grown), "train_rmse": rmse[False], "val_rmse": rmse[True]}
    return Fitted(PipelineModel(stages), list(features), label, "gbt", dict(params or {}), metrics)


# ---------------------------------------------------------------- data preparation

def model_frame(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ("station", "datetime", "split"),
                fill: str = "train") -> DataFrame:
    """Median fill (A9, train medians by default, or each split's own with
    ``fill='per_split'``), then complete cases (P5)."""
    feats = list(features)
    keys = [k for k in keys if k in df.columns]
    # Stage boundary: the medians, the fill and every fit pass read the
    # written columns instead of re-running the feature plan.
    with wide_tables(df.sparkSession):
        return _model_frame(materialize(df.select(*keys, *feats, label)), feats, label, fill)


def _model_frame(d: DataFrame, feats: list[str], label: str, fill: str) -> DataFrame:
    numeric = [c for c in feats if c in st.numeric_names(d)]
    bools = [c for c in feats if c not in numeric]
    if bools:
        d = d.withColumns({c: F.col(c).cast("double") for c in bools})
        numeric += bools
    if fill == "per_split" and "split" in d.columns:
        parts = [st.median_fill(d.where(F.col("split") == s), numeric) for s in ("train", "val", "test")]
        d = st.union_frames(parts)
    else:
        fit_on = d.where(F.col("split") == "train") if "split" in d.columns else d
        d = st.median_fill(d, numeric, fit=fit_on)
    return materialize(st.complete_cases(d, feats, label))


# ---------------------------------------------------------------- W11 + L1/L2: cross-validation

def cross_validate(kind: str, df: DataFrame, spec: PanelSpec, features: Sequence[str], label: str,
                   n_splits: int = C.CV_SPLITS, params: dict | None = None) -> DataFrame:
    """Expanding time folds: fit on each fold's train rows, RMSE on its test
    rows.  Returns ``(fold, n_train, n_test, rmse)``; every fit is a Spark job.
    Rows are tagged with their time step once; each fold is a range filter
    on that step (the fold bounds are an ``n_splits``-row table)."""
    steps = time_steps(df, spec)
    bounds = fold_bounds(steps, n_splits).orderBy("fold").collect()
    tagged = materialize(df.join(steps, spec.time))  # read by three jobs a fold

    def fold(b) -> DataFrame:
        tr = tagged.where(F.col("step") < b["test_start"]).drop("step")
        te = tagged.where((F.col("step") >= b["test_start"]) & (F.col("step") < b["test_end"])).drop("step")
        m = fit(kind, tr, features, label, params)
        scored = m.predict(te).withColumn("y", F.col(label))
        res = scored.agg(F.lit(int(b["fold"])).alias("fold"),
                         F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2)).alias("rmse"),
                         F.count(F.lit(1)).alias("n_test"))
        return res.crossJoin(tr.agg(F.count(F.lit(1)).alias("n_train")))

    rows = together(df.sparkSession, [lambda b=b: fold(b) for b in bounds])
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("fold", "n_train", "n_test", "rmse")


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population std of the fold RMSEs."""
    return cv.agg(F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"))


# ---------------------------------------------------------------- L3: random search

def draw_params(n_trials: int, seed: int = C.RANDOM_STATE, space: dict | None = None) -> list[dict]:
    """Seeded draws from the search space: ``int`` uniform, ``float``
    uniform, ``logfloat`` log-uniform."""
    rng = random.Random(seed)
    space = space or C.SEARCH_SPACE
    out = []
    for _ in range(n_trials):
        p = {}
        for name, (kind, lo, hi) in space.items():
            if kind == "int":
                p[name] = rng.randint(int(lo), int(hi))
            elif kind == "logfloat":
                p[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                p[name] = rng.uniform(lo, hi)
        out.append(p)
    return out


def random_search(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, n_trials: int = C.SEARCH_TRIALS,
                  seed: int = C.RANDOM_STATE, space: dict | None = None, base: dict | None = None,
                  min_delta: float = C.EARLY_STOPPING_MIN_DELTA, width: int = POOL) -> DataFrame:
    """L3: one boosted-tree fit a drawn parameter set, up to ``width`` at a time over
    one written table; each stops by the validation rows, its drawn number of
    trees is the most it may grow. Returns (trial, params, trees, train_rmse,
    val_rmse, best); ``best`` marks the lowest validation RMSE (of equal ones the
    first trial)."""
    spark, frame = train.sparkSession, boosted_frame(train, val, features, label)

    def trial(i: int, p: dict) -> tuple:
        params = {**(base or {}), **p, "validationIndicatorCol": IS_VAL, "validationTol": min_delta}
        model = gbt_pipeline(features, label, params).getStages()[-1].fit(frame)
        rmse = rmse_by_split(model, frame, label)
        text = json.dumps({k: round(v, 6) if isinstance(v, float) else v for k, v in p.items()}, sort_keys=True)
        return i, text, model.getNumTrees, rmse[False], rmse[True]

    rows = together(spark, [lambda i=i, p=p: trial(i, p) for i, p in enumerate(draw_params(n_trials, seed, space))], width)
    best = min(rows, key=lambda r: (r[4], r[0]))[0] if rows else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows],
                                 "trial int, params string, trees int, train_rmse double, val_rmse double, best boolean")


def tuned_fit(train: DataFrame, val: DataFrame, spec: PanelSpec, features: Sequence[str], label: str,
              n_trials: int = C.SEARCH_TRIALS, space: dict | None = None, n_splits: int = C.CV_SPLITS,
              out: str | None = None) -> tuple[Fitted, DataFrame]:
    """L2 + L3 + W11 + S6/S8: search, fit with the best parameters (stopped like its
    trial), score train and val, cross-validate on train with the trees it kept.
    The one-row result ``(train_rmse, val_rmse, cv_rmse_mean, cv_rmse_std, trees,
    params)`` is kept with the model; ``out`` saves both."""
    trials = random_search(train, val, features, label, n_trials, space=space)
    best = json.loads(trials.where("best").first()["params"])
    model = fit_stopped(train, val, features, label, best, "first")
    folds = {**best, "maxIter": int(model.metrics["trees"])}
    cv = cv_summary(cross_validate("gbt", train, spec, features, label, n_splits, folds)).first()
    model.metrics = {"train_rmse": model.metrics["train_rmse"], "val_rmse": model.metrics["val_rmse"],
                     "cv_rmse_mean": float(cv["cv_rmse_mean"]), "cv_rmse_std": float(cv["cv_rmse_std"]), "trees": model.metrics["trees"]}
    model.params = best
    if out:
        model.save(out)
    result = train.sparkSession.createDataFrame([(*model.metrics.values(), json.dumps(best, sort_keys=True))],
                                                ", ".join(f"{k} double" for k in model.metrics) + ", params string")
    return model, result


# ---------------------------------------------------------------- L7: attribution

def linear_contributions(m: Fitted, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L7 (linear): exact per-row contribution of every feature,
    ``coef_j * (x_j - mean_j) / std_j``, as a long table
    ``(keys…, feature, contribution)``; contributions plus the intercept
    equal the prediction."""
    scaler = m.model.stages[1]
    lr = m.model.stages[-1]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    coef = lr.coefficients.toArray()
    terms = []
    for j, c in enumerate(m.features):
        scale = 0.0 if std[j] == 0 else float(coef[j]) / float(std[j])
        terms.append(F.struct(F.lit(c).alias("feature"),
                              (F.lit(scale) * (F.col(c) - F.lit(float(mean[j])))).alias("contribution")))
    return df.select(*keys, F.inline(F.array(*terms)))


def linear_attribution(m: Fitted, df: DataFrame) -> DataFrame:
    """L7 (linear) over all rows: ``(feature, mean_abs_contribution)``, one
    aggregate with an average a feature; no row is multiplied."""
    scaler, lr = m.model.stages[1], m.model.stages[-1]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), lr.coefficients.toArray()
    scale = [0.0 if std[j] == 0 else float(coef[j]) / float(std[j]) for j in range(len(m.features))]
    row = df.agg(*[F.avg(F.abs(F.lit(scale[j]) * (F.col(f"`{c}`") - F.lit(float(mean[j]))))).alias(f"c{j}") for j, c in enumerate(m.features)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{j}").alias("mean_abs_contribution"))
                                         for j, c in enumerate(m.features)])))


def permutation_importance(m: Fitted, sample: DataFrame, seed: int = C.RANDOM_STATE) -> DataFrame:
    """L7 (any model): per feature, RMSE increase when that feature's values
    are permuted across all rows of ``sample``. All features are scored in one job:
    each row is copied once a feature with only that column permuted. The
    permutation is distributed: row i by one salted hash takes the values of row i
    by another, both numbered by a range-partitioned sort and partition offsets."""
    feats, label = m.features, m.label
    base = materialize(sample.select(*feats, label))

    def numbered(salt: int) -> DataFrame:
        # Equal hashes are equal rows (or as good as): the rest of the order is theirs.
        d = base.withColumns({"_h": F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in [*feats, label]]), "_all": F.lit(0)})
        return with_position(d, PanelSpec(key="_all", time="_h", position_method="sort"))

    a = numbered(seed).select(*feats, label, F.col(POS).alias("_r"))
    b = numbered(seed + 1).select(*[F.col(f"`{c}`").alias(f"_perm_{c}") for c in feats], F.col(POS).alias("_r"))
    pair = a.join(b, "_r")
    names = F.array(*[F.lit(c) for c in feats + ["__none__"]])
    copies = pair.withColumn("_feature", F.explode(names))
    copies = copies.select("_feature", label, *[F.when(F.col("_feature") == c, F.col(f"_perm_{c}"))
                                                .otherwise(F.col(c)).alias(c) for c in feats])
    scored = m.predict(copies)
    rm = scored.groupBy("_feature").agg(F.sqrt(F.avg((F.col(label) - F.col("p")) ** 2)).alias("rmse"))
    ref = rm.where(F.col("_feature") == "__none__").select(F.col("rmse").alias("_ref"))
    return (rm.where(F.col("_feature") != "__none__").crossJoin(ref)
            .select(F.col("_feature").alias("feature"), (F.col("rmse") - F.col("_ref")).alias("rmse_increase"))
            .orderBy(F.desc("rmse_increase"), "feature"))
