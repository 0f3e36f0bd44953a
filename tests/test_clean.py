"""Cleaning operators on hand-made frames with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import hours
from tessera.config import PanelSpec
from tessera.operators import clean
from tessera.operators.quantiles import quantiles

SPEC = PanelSpec(chunk_rows=5, position_bucket="hour")


def _series(spark, values, station="s", wd=None):
    rows = [(station, t, v, None, wd) for t, v in zip(hours(len(values)), values)]
    return spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")


def _col(df, c="PM2_5"):
    return [r[c] for r in df.orderBy("datetime").collect()]


def test_forward_fill_limit_six(spark):
    vals = [None, 1.0] + [None] * 6 + [2.0] + [None] * 7 + [3.0, None]
    got = _col(clean.forward_fill(_series(spark, vals), SPEC, ["PM2_5"]))
    assert got == [None, 1.0] + [1.0] * 6 + [2.0] + [2.0] * 6 + [None] + [3.0, 3.0]


def test_interpolation_linear_with_ends(spark):
    vals = [None, None, 1.0, None, None, 4.0, None]
    rows = [("s", t, None, v, None) for t, v in zip(hours(7), vals)]
    df = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")
    got = _col(clean.interpolate_linear(df, SPEC, ["TEMP"]), "TEMP")
    assert got == pytest.approx([1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 4.0])


def test_no_fill_crosses_stations(spark):
    a = _series(spark, [1.0, None, None], station="a")
    b = _series(spark, [None, 5.0, None], station="b")
    got = clean.forward_fill(a.unionByName(b), SPEC, ["PM2_5"])
    by = {(r["station"], r["datetime"]): r["PM2_5"] for r in got.collect()}
    assert [by[("b", t)] for t in hours(3)] == [None, 5.0, 5.0]
    assert [by[("a", t)] for t in hours(3)] == [1.0, 1.0, 1.0]


def test_clip_keeps_null(spark):
    df = _series(spark, [-5.0, None, 700.0, 10.0])
    assert _col(clean.clip_physical(df, SPEC)) == [0.0, None, 500.0, 10.0]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1001)
    y = rng.integers(0, 5, size=1001).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(7)
    q = {(r["name"], r["prob"]): r["value"] for r in quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.75, 0.99]).collect()}
    for name, arr in (("x", x), ("y", y)):
        for p in (0.1, 0.25, 0.5, 0.75, 0.99):
            assert q[(name, p)] == pytest.approx(float(np.percentile(arr, p * 100)), abs=1e-12)


def test_iqr_cap_and_zero_iqr_option(spark):
    vals = [0.0] * 95 + [1.0, 2.0, 3.0, 50.0, 400.0]
    df = _series(spark, vals)
    capped, report = clean.cap_iqr(df, SPEC, cols=["PM2_5"])
    assert max(_col(capped)) == 0.0          # IQR 0 caps every positive value to Q3
    assert report.collect()[0]["iqr_outliers"] == 5
    kept, _ = clean.cap_iqr(df, SPEC, cols=["PM2_5"], skip_zero_iqr=True)
    assert max(_col(kept)) == 400.0


def test_split_bounds_are_midnight(spark):
    spec = PanelSpec(train_end="2015-12-31", val_start="2016-01-01", val_end="2016-12-31", test_start="2017-01-01")
    ts = [dt.datetime(2015, 12, 31, 0), dt.datetime(2015, 12, 31, 5), dt.datetime(2016, 1, 1, 0),
          dt.datetime(2016, 12, 31, 0), dt.datetime(2016, 12, 31, 1), dt.datetime(2017, 1, 1, 3)]
    df = spark.createDataFrame([("s", t) for t in ts], "station string, datetime timestamp_ntz")
    got = [r["split"] for r in clean.temporal_split(df, spec).orderBy("datetime").collect()]
    assert got == ["train", None, "val", "val", None, "test"]


def test_dedupe_keeps_first_by_tiebreak(spark):
    rows = [(1, "k", 5.0), (0, "k", 7.0), (2, "j", 1.0)]
    df = spark.createDataFrame(rows, "id long, key string, v double")
    got = {r["key"]: (r["id"], r["v"]) for r in clean.remove_duplicates(df, ["key"], ["id"]).collect()}
    assert got == {"k": (0, 7.0), "j": (2, 1.0)}


def test_drop_sparse_rows_threshold(spark):
    rows = [("s", t, None, None, "N") for t in hours(1)] + [("s", t, 1.0, 2.0, "N") for t in hours(1)]
    df = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")
    assert clean.drop_sparse_rows(df, SPEC).count() == 1


def test_split_does_not_depend_on_session_time_zone(spark):
    spec = PanelSpec(train_end="2015-12-31", val_start="2016-01-01", val_end="2016-12-31", test_start="2017-01-01")
    ts = [dt.datetime(2015, 12, 31, 0), dt.datetime(2016, 1, 1, 0), dt.datetime(2017, 1, 1, 0)]
    df = spark.createDataFrame([("s", t) for t in ts], "station string, datetime timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r["split"] for r in clean.temporal_split(df, spec).orderBy("datetime").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["train", "val", "test"]


def test_approx_quantiles_close_to_exact(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(float(a),) for a in x], "x double").repartition(5)
    got = {r["prob"]: r["value"] for r in quantiles(df, ["x"], [0.25, 0.5, 0.75], method="approx").collect()}
    srt = np.sort(x)
    for p in (0.25, 0.5, 0.75):
        # percentile_approx returns an element within 1/accuracy of the rank.
        k = int(np.searchsorted(srt, got[p]))
        assert abs(k - p * (len(x) - 1)) <= 2
