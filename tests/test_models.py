"""Fitted preparation, stops by validation rows, search, attribution, the run's sinks."""

import math
import random
import subprocess
import sys
import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera import config as C
from tessera.ml import models as ml
from tessera.ml.prepare import MatrixPreparer, MatrixPreparerModel, PopulationScaler, model_features, split_kinds
from tessera.operators import stats as st
from tessera.sources import io

SCHEMA = "id int, n double, k int, flag boolean, s string, none string, empty double, y double"


def frame(spark):
    rows = [(1, 1.0, 4, True, "b", None, None, 1.0), (2, None, None, None, "a", None, None, 2.0), (3, 4.0, 9, False, "b", None, None, 3.0),
            (4, 2.5, 5, False, "a", None, None, 4.0), (5, 3.0, 6, True, None, None, None, 5.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_prepared_matrix(spark, tmp_path):
    df = frame(spark)
    numeric, categorical = split_kinds(df, model_features(df, ["id", "y"]))
    assert (numeric, categorical) == (["n", "k", "flag", "empty"], ["s", "none"])
    model = MatrixPreparer(numeric=numeric, categorical=categorical).fit(df)
    new = df.unionByName(spark.createDataFrame([(6, None, None, None, "zz", "q", 7.0, None)], SCHEMA))
    got = {r.id: tuple(r)[1:-1] for r in model.transform(new).collect()}
    # Medians 2.75, 5.5, 0.5; a and b are equally frequent: a; a label not seen gets the next code.
    assert got[2] == (2.75, 5.5, 0.5, 0.0, 0.0, None) and got[5][3] == 0.0 and got[1][3] == 1.0
    assert got[6] == (2.75, 5.5, 0.5, 2.0, 1.0, 7.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = MatrixPreparerModel.load(str(tmp_path / "m"))
    assert {r.id: tuple(r)[1:-1] for r in back.transform(new).collect()} == got and back.uid == model.uid
    with pytest.raises(ValueError):
        model_features(df.select("id", "y"), ["id", "y"])


def test_many_labels(spark):
    df = spark.range(3000).select(F.format_string("v%05d", (F.col("id") * 7) % 2500).alias("s")).repartition(6)
    model = MatrixPreparer(categorical=["s"]).fit(df)
    got = df.distinct().withColumn("code", F.col("s"))
    pairs = model.transform(got.select("s")).select("s").distinct().count()
    assert pairs == 2500 and {(r.label, r.code) for r in model.codes.collect()} == {(f"v{k:05d}", float(k)) for k in range(2500)}


def test_prepared_pipeline_saves_and_loads(spark, tmp_path):
    df = frame(spark)
    m = ml.fit_prepared(df, ["n", "k", "s"], "y", "linear")
    want = {r.id: r.p for r in m.predict(df).collect()}
    m.save(str(tmp_path / "p"))
    back = ml.Fitted.load(str(tmp_path / "p"))
    got = {r.id: r.p for r in back.predict(df).collect()}
    assert got == pytest.approx(want) and back.features == ["n", "k", "s"]


def test_population_scaler(spark, tmp_path):
    rows = [(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame(rows, "a double, b double"))
    model = PopulationScaler(inputCol="v", outputCol="z").fit(df)
    x = np.array(rows)
    assert model.std.toArray() == pytest.approx(x.std(axis=0)) and model.mean.toArray() == pytest.approx(x.mean(axis=0))
    z = np.array([r.z.toArray() for r in model.transform(df).collect()])
    assert z[:, 0] == pytest.approx((x[:, 0] - x[:, 0].mean()) / x[:, 0].std()) and (z[:, 1] == 0).all()
    model.write().overwrite().save(str(tmp_path / "s"))
    assert type(model).load(str(tmp_path / "s")).std == model.std


def test_coefficients_need_no_correction(spark):
    rng = random.Random(2)
    rows = [(x := rng.gauss(5, 3), 2 * x + 1) for _ in range(20)]
    m = ml.fit("linear", spark.createDataFrame(rows, "x double, y double"), ["x"], "y")
    assert m.importance().first()["importance"] == pytest.approx(2 * np.std([r[0] for r in rows]))


def test_best_prefix():
    assert ml.best_prefix([5, 4, 3, 3.5, 3.4, 2], rounds=2, min_delta=0.0) == 3
    assert ml.best_prefix([5, 4, 3, 3.5, 3.4, 2], rounds=3, min_delta=0.0) == 6
    assert ml.best_prefix([5, 4.9995, 4.5], rounds=5, min_delta=0.001) == 3
    assert ml.best_prefix([5, 4.9995, 4.9992], rounds=5, min_delta=0.001) == 1 and ml.best_prefix([], 5, 0.1) == 1


@pytest.fixture(scope="module")
def boosted(spark):
    rng = random.Random(9)
    rows = [(i, a := rng.uniform(-2, 2), b := rng.uniform(-2, 2), math.sin(a) * 5 + b * b + rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double").cache()
    return df.where("id % 4 > 0"), df.where("id % 4 = 0")


def test_stop_by_patience_keeps_the_best_prefix(spark, boosted):
    train, val = boosted
    params = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.5}
    whole = ml.fit("gbt", train, ["a", "b"], "y", params)
    last = whole.model.stages[-1]
    v = VectorAssembler(inputCols=["a", "b"], outputCol=ml.FEATURES).transform(val)
    errors = [math.sqrt(e) for e in last.evaluateEachIteration(v, "squared")]
    m = ml.fit_stopped(train, val, ["a", "b"], "y", params, rounds=3, min_delta=0.0)
    k = ml.best_prefix(errors, 3, 0.0)
    assert m.metrics["trees"] == k == m.model.stages[-1].getNumTrees and m.metrics["grown"] == 12
    assert m.metrics["val_rmse"] == pytest.approx(errors[k - 1])
    cut = ml.first_trees(last, 5)
    rmse = cut.transform(v).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert cut.getNumTrees == 5 and rmse == pytest.approx(errors[4])


def test_stop_inside_the_fit(spark, boosted, tmp_path):
    train, val = boosted
    m = ml.fit_stopped(train, val, ["a", "b"], "y", {"maxIter": 60, "stepSize": 0.5}, rule="first", min_delta=0.01)
    assert m.metrics["trees"] < 60 and m.metrics["val_rmse"] < 2
    m.save(str(tmp_path / "g"))
    back = ml.Fitted.load(str(tmp_path / "g"))
    assert back.metrics == m.metrics and back.model.stages[-1].getNumTrees == m.metrics["trees"]
    with pytest.raises(ValueError):
        ml.fit_stopped(train, val, ["a", "b"], "y", rule="never")


def test_search_runs_all_trials(spark, boosted):
    train, val = boosted
    space = dict(C.SEARCH_SPACE, maxIter=("int", 5, 10), maxDepth=("int", 2, 3))
    got = ml.random_search(train, val, ["a", "b"], "y", 5, space=space).orderBy("trial").collect()
    assert [r.trial for r in got] == list(range(5)) and sum(r.best for r in got) == 1
    assert min(got, key=lambda r: r.val_rmse).best and all(1 <= r.trees <= 10 for r in got)
    again = ml.random_search(train, val, ["a", "b"], "y", 5, space=space, width=1).orderBy("trial").collect()
    assert got == again
    assert len(ml.draw_params(50)) == 50 and all(100 <= p["maxIter"] <= 1000 for p in ml.draw_params(50))


def test_permutation_importance_is_a_permutation(spark, boosted):
    train, val = boosted
    m = ml.fit("gbt", train, ["a", "b"], "y", {"maxIter": 5})
    got = {r.feature: r.rmse_increase for r in ml.permutation_importance(m, val, seed=3).collect()}
    rows = val.select("a", "b", "y", *[F.xxhash64(F.lit(s), "a", "b", "y").alias(f"h{s}") for s in (3, 4)]).collect()
    one, two = sorted(rows, key=lambda r: r.h3), sorted(rows, key=lambda r: r.h4)

    def rmse(table):
        p = m.predict(spark.createDataFrame(table, "a double, b double, y double"))
        return p.agg(F.sqrt(F.avg((F.col("y") - F.col("p")) ** 2))).first()[0]

    base = rmse([(r.a, r.b, r.y) for r in one])
    assert got["a"] == pytest.approx(rmse([(p.a, r.b, r.y) for r, p in zip(one, two)]) - base)
    assert got["b"] == pytest.approx(rmse([(r.a, p.b, r.y) for r, p in zip(one, two)]) - base)


def test_correlation_matrix(spark):
    rng = np.random.default_rng(1)
    import pandas as pd
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"] * 2 + 1e6
    pdf["e"], pdf["f"] = 3.0, np.nan
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.values],
                               ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)
    want = pdf.corr(min_periods=2)
    got = st.correlation_matrix(df).collect()
    assert len(got) == 15
    for r in got:
        w = want.loc[r.feature_a, r.feature_b]
        both = pdf[[r.feature_a, r.feature_b]].dropna()
        assert r.n == len(both)
        assert (r["corr"] is None) if np.isnan(w) or "e" in (r.feature_a, r.feature_b) else r["corr"] == pytest.approx(w, abs=1e-9)
    assert all(r["corr"] is None and r.n == 0 for r in st.correlation_matrix(df.limit(0)).collect())


def test_run_twice_into_one_folder(spark, tmp_path):
    import datetime as dt
    from tessera.config import PanelSpec
    from tessera.ml.run import train_and_compare
    rng = random.Random(6)
    spec = PanelSpec(train_end="2024-01-04", val_start="2024-01-05", val_end="2024-01-06", test_start="2024-01-07")
    rows = []
    for s in ("x", "y"):
        v = 20.0
        for h in range(8 * 24):
            v = 0.8 * v + rng.uniform(0, 8)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), v, v + rng.uniform(0, 5), rng.uniform(-5, 25), rng.uniform(990, 1010), "N"))
    p = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, PM10 double, TEMP double, PRES double, wd string")
    for _ in range(2):
        res = train_and_compare(p, spec, {"maxIter": 3, "maxDepth": 3}, out_dir=str(tmp_path / "out"))
    stored = io.read_results(spark, str(tmp_path / "out" / "predictions"))
    assert stored.count() == res.scored.count() and stored.select("model").distinct().count() == 2
    metrics = io.read_results(spark, str(tmp_path / "out" / "metrics"), model="gbt", split="test")
    assert metrics.count() == 1 and spark.read.json(str(tmp_path / "out" / "model_comparison")).count() == res.comparison.count()
    assert ml.Fitted.load(str(tmp_path / "out" / "boosted_model")).features == res.boosted.features


@pytest.mark.parametrize("absent, wants", [("xxhash", True), ("tessera.llm", True), ("tessera.operators.quantiles", False)])
def test_entry_without_a_module(absent, wants):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r}: raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as E
assert len(E.queries()) > 100 and not any(n.startswith("op") for n in E.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True)
    assert (done.returncode == 0) == wants, done.stderr.decode()[-500:]
