"""Feature, metric and model operators on hand-made frames."""

import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from conftest import hours
from tessera.config import PanelSpec
from tessera.functions.encode import compass_degrees
from tessera.ml import models as ml
from tessera.operators import features as ft, metrics as mt

SPEC = PanelSpec(chunk_rows=4, position_bucket="hour")


def test_single_row_std_and_lag_are_null(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), 3.0)], "station string, datetime timestamp_ntz, PM2_5 double")
    r = ft.window_features(df, SPEC, [ft.Lag("PM2_5", 1, "l1")], [ft.Roll("PM2_5", 6, "std", 1, "s6")]).first()
    assert r["l1"] is None and r["s6"] is None


def test_compass_levels_unknown_and_null(spark):
    df = spark.createDataFrame([("N",), ("E",), ("NNW",), ("XX",), (None,)], "wd string")
    got = [r[0] for r in df.select(compass_degrees(F.col("wd"))).collect()]
    assert got == [0.0, 90.0, 337.5, None, None]


def test_calendar_weekday_monday_zero_and_holidays(spark):
    days = [dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 6, 13), dt.datetime(2024, 2, 14, 20),
            dt.datetime(2024, 12, 25, 12), dt.datetime(2024, 7, 3, 8)]
    df = spark.createDataFrame([("s", d) for d in days], "station string, datetime timestamp_ntz")
    rows = ft.calendar_features(df, SPEC).orderBy("datetime").collect()
    assert [r["day_of_week"] for r in rows] == [0, 5, 2, 2, 2]
    assert [r["is_holiday"] for r in rows] == [1, 1, 1, 0, 1]
    by ={r["datetime"]: r for r in rows}
    assert by[dt.datetime(2024, 1, 1, 3)]["is_holiday"] == 1
    assert by[dt.datetime(2024, 7, 3, 8)]["is_holiday"] == 0
    assert by[dt.datetime(2024, 12, 25, 12)]["is_holiday"] == 1
    assert by[dt.datetime(2024, 1, 6, 13)]["time_of_day"] == "afternoon"
    assert by[dt.datetime(2024, 1, 1, 3)]["season_winter"] == 1 and by[dt.datetime(2024, 7, 3, 8)]["season_summer"] == 1


def test_zero_target_mape_is_skipped(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 12.0), (20.0, 18.0)], "y double, p double")
    r = mt.metrics(df, by=[]).first()
    assert r["mape_skipped"] == 1
    assert r["mape"] == pytest.approx(((2 / 10) + (2 / 20)) / 2 * 100)


def test_r2_matches_regression_evaluator(spark):
    rng = random.Random(1)
    rows = [(float(y), float(y + rng.gauss(0, 3))) for y in range(50)]
    df = spark.createDataFrame(rows, "y double, p double")
    ours = mt.metrics(df, by=[]).first()
    ev = RegressionEvaluator(labelCol="y", predictionCol="p")
    assert ours["r2"] == pytest.approx(ev.setMetricName("r2").evaluate(df), abs=1e-9)
    assert ours["rmse"] == pytest.approx(ev.setMetricName("rmse").evaluate(df), abs=1e-9)


def test_planted_linear_signal_is_recovered(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b = rng.uniform(-5, 5), rng.uniform(-5, 5)
        rows.append(("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), a, b, 2 * a - 3 * b + 1, "train"))
    df = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, a double, b double, y double, split string")
    m = ml.fit("linear", df, ["a", "b"], "y")
    contrib = ml.linear_contributions(m, df, ["datetime"])
    total = contrib.groupBy("datetime").agg(F.sum("contribution").alias("c"))
    pred = m.predict(df).join(total, "datetime")
    intercept = float(m.model.stages[-1].intercept)
    worst = pred.select(F.max(F.abs(F.col("c") + F.lit(intercept) - F.col("p")))).first()[0]
    assert worst < 1e-8
    r = m.evaluate(df, by=[]).first()
    assert r["rmse"] < 1e-8


def test_time_folds_expand(spark):
    from tessera.ml.validation import fold_summary
    rows = [("s", t) for t in hours(60)]
    df = spark.createDataFrame(rows, "station string, datetime timestamp_ntz")
    got = {(r["fold"], r["role"]): r["rows"] for r in fold_summary(df, PanelSpec(), 5).collect()}
    assert [got[(i, "test")] for i in range(5)] == [10] * 5
    assert [got[(i, "train")] for i in range(5)] == [10, 20, 30, 40, 50]
