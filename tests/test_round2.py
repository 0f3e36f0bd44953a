"""Leak-safe features, skewed quantiles, label codes, sources by name, and the
fixed constants (pinned, as the SQL side shares them)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config as C
from tessera.config import PanelSpec
from tessera.operators import clean, features as ft, stats as st
from tessera.operators.quantiles import quantiles
from tessera.sources import io
from conftest import hours


def panel(spark, change=0.0):
    rng = np.random.default_rng(4)
    rows = []
    for s in ("a", "b"):
        for i, t in enumerate(hours(80)):
            v = rng.normal(size=6)
            rows.append((s, t, float(50 + 9 * v[0] + (change if (s, i) == ("a", 60) else 0)), float(80 + v[1]), float(5 + v[2]),
                         float(7 + v[3]), float(10 + v[4]), float(1000 + v[5]), 2.5, "NE"))
    return spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, PM10 double, SO2 double, "
                                       "NO2 double, TEMP double, PRES double, WSPM double, wd string")


@pytest.mark.parametrize("engineer", [ft.engineer_full, ft.engineer_optimized])
def test_leak_safe_row_does_not_see_its_target(spark, engineer):
    spec = PanelSpec(key_levels=("a", "b"))
    at = (F.col("station") == "a") & (F.col("datetime") == F.lit(hours(80)[60].isoformat(sep=" ")).cast("timestamp_ntz"))
    one, two = (engineer(panel(spark, x), spec, leak_safe=True).where(at).drop("PM2_5").first() for x in (0.0, 1000.0))
    assert one is not None and one == two
    assert engineer(panel(spark, 0.0), spec).where(at).drop("PM2_5").first() != engineer(panel(spark, 1000.0), spec).where(at).drop("PM2_5").first()


def test_quantiles_of_a_column_with_one_value_nearly_everywhere(spark):
    v = np.r_[np.zeros(1900), np.arange(1, 101)]
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(v)], "a double, b double").repartition(6)
    got = {(r.name, r.prob): r.value for r in quantiles(df, ["a", "b"], [0.1, 0.5, 0.951, 0.975, 1.0]).collect()}
    for (name, p), x in got.items():
        assert x == pytest.approx(np.quantile(v if name == "a" else np.arange(2000), p), abs=1e-9)


def test_label_codes_and_mode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",), ("c",)], "wd string")
    fit = df.where("wd IN ('a', 'c')")
    assert sorted((r.wd or "", r.wd_index) for r in st.label_encode(df, "wd", fit).collect()) == [
        ("", 2.0), ("a", 0.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 1.0)]
    assert st.mode_fill(df, ["wd"]).where("wd = 'b'").count() == 3  # b and c tie: the smaller


def test_duplicates_prefer_measured_rows(spark):
    df = spark.createDataFrame([("a", 1, None, 5.0), ("a", 1, 7.0, 6.0)], "station string, t int, v double, w double")
    assert clean.remove_duplicates(df, ["station", "t"], ["v"]).first().v == 7.0


def test_panel_without_a_key(spark):
    rows = [(t, None if i % 9 == 3 else float(i), 10.0) for i, t in enumerate(hours(40))]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, PM2_5 double, TEMP double")
    out, reports = clean.preprocess(df, PanelSpec())
    assert "station" not in out.columns and out.count() == 40 and out.where("PM2_5 IS NULL").count() == 0
    assert reports["unsplit"].first()[0] == 0


def test_split_by_whole_days(spark):
    spec = PanelSpec(train_end="2024-01-01", val_start="2024-01-02", val_end="2024-01-02", test_start="2024-01-03")
    df = spark.createDataFrame([("a", t) for t in hours(72)], "station string, datetime timestamp_ntz")
    loose, whole = clean.temporal_split(df, spec), clean.temporal_split(df, spec, whole_days=True)
    assert clean.unsplit_rows(loose).first()[0] == 46 and clean.unsplit_rows(whole).first()[0] == 0


def test_iqr_caps_of_whole_numbers_stay_fractions(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 2, 3, 3, 4, 100]], "v int")
    out, _ = clean.cap_iqr(df, PanelSpec(), ["v"])
    assert out.agg(F.max("v")).first()[0] == pytest.approx(3.5 + 3 * 1.5)


def test_csv_binds_by_name_and_counts_malformed(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("station,year,PM2.5,hour\nS1,2013,4.5,1\nS2,bad,NA,x\n")
    df = io.read_raw_csv(spark, str(tmp_path / "x" / "*.csv"))
    rows = {r.station: r for r in df.collect()}
    assert rows["S1"].PM2_5 == 4.5 and rows["S1"].year == 2013 and rows["S1"].No is None and rows["S1"].malformed == 0
    assert rows["S2"].year is None and rows["S2"].malformed == 2 and io.malformed_rows(df).first()[:] == (1, 2)


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_assets_check_under_any_form_of_root(spark, tmp_path, prefix):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("x")
    want = spark.createDataFrame([("d/a.txt",), ("d/b.txt",)], "path string")
    assert dict(map(tuple, io.assets_check(spark, want, f"{prefix}{tmp_path}").collect())) == {"d/a.txt": True, "d/b.txt": False}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m", 1.5)], "model string, rmse double")
    io.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().rmse == 1.5
    lines = spark.createDataFrame([(1, "b"), (0, "a")], "seq int, line string")
    io.write_report(lines, f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["a", "b"]


def test_tuned_model_keeps_its_metrics(spark, tmp_path):
    from tessera.ml import models as ml
    rows = [("a", t, float(i % 7), float(i % 7) * 2 + (i % 3)) for i, t in enumerate(hours(60))]
    df = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, x double, y double")
    space = {"maxDepth": ("int", 2, 3), "maxIter": ("int", 2, 3)}
    m, res = ml.tuned_fit(df, df, PanelSpec(), ["x"], "y", n_trials=2, space=space, n_splits=2, out=f"{tmp_path}/m")
    row, back = res.first(), ml.Fitted.load(f"{tmp_path}/m")
    assert back.metrics == m.metrics and back.metrics["val_rmse"] == row.val_rmse and row.cv_rmse_std >= 0
    assert back.params["maxDepth"] in (2, 3) and {"train_rmse", "val_rmse", "cv_rmse_mean", "cv_rmse_std"} <= set(res.columns)


def test_constraint_setting_returns(spark):
    from tessera.session import wide_tables
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    with wide_tables(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name) == "true"
    spark.conf.set(name, before)


def test_fixed_values():
    assert C.PHYSICAL_LIMITS["PM2_5"] == (0, 500) and C.PHYSICAL_LIMITS["TEMP"] == (-50, 60)
    assert len(C.COMPASS_POINTS) == 16 and C.FORWARD_FILL_LIMIT == 6 and C.MAX_SELECTED_FEATURES == 50
    assert (C.IQR_MULTIPLIER, C.IQR_EXTREME_MULTIPLIER, C.MISSING_DATA_THRESHOLD) == (1.5, 3.0, 0.1)
    assert tuple(C.CRITICAL_LAGS) == (1, 6, 12, 24) and tuple(C.FULL_TARGET_LAGS) == tuple(range(1, 25))
    assert dt.datetime.fromisoformat(C.TRAIN_END) < dt.datetime.fromisoformat(C.TEST_START)
