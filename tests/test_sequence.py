"""Chunked row windows equal plain per-key windows, across chunk edges."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import hours
from tessera.config import PanelSpec
from tessera.operators import clean, features as ft
from tessera.operators.sequence import POS, with_position


def _panel(spark, n=120, stations=("a", "b", "c"), null_rate=0.3, seed=7):
    rng = random.Random(seed)
    rows = []
    for s in stations:
        for t in hours(n):
            v = None if rng.random() < null_rate else round(rng.uniform(0, 100), 2)
            rows.append((s, t, v, None if rng.random() < null_rate else rng.uniform(-5, 5), None))
    return spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_positions_are_dense_per_key(spark):
    spec = PanelSpec(position_bucket="hour", chunk_rows=7)
    d = with_position(_panel(spark, 50), spec)
    got = d.groupBy("station").agg(F.min(POS).alias("lo"), F.max(POS).alias("hi"),
                                   F.countDistinct(POS).alias("n")).collect()
    assert all(r["lo"] == 0 and r["hi"] == 49 and r["n"] == 50 for r in got)
    w = Window.partitionBy("station").orderBy("datetime")
    bad = d.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") != F.col(POS)).count()
    assert bad == 0


def test_chunked_lags_and_rolling_match_plain_windows(spark):
    p = _panel(spark)
    small = PanelSpec(chunk_rows=5, position_bucket="hour")
    lags = [ft.Lag("PM2_5", k, f"lag{k}") for k in (1, 6, 12)]
    rolls = [ft.Roll("PM2_5", 12, "mean", 6, "m12"), ft.Roll("PM2_5", 24, "std", 1, "s24"),
             ft.Roll("TEMP", 6, "max", 1, "x6")]
    got = ft.window_features(p, small, lags, rolls)
    w = Window.partitionBy("station").orderBy("datetime")
    exp = p.select(
        "*", *[F.lag("PM2_5", k).over(w).alias(f"lag{k}") for k in (1, 6, 12)],
        F.when(F.count("PM2_5").over(w.rowsBetween(-11, 0)) >= 6, F.avg("PM2_5").over(w.rowsBetween(-11, 0))).alias("m12"),
        F.stddev_samp("PM2_5").over(w.rowsBetween(-23, 0)).alias("s24"),
        F.max("TEMP").over(w.rowsBetween(-5, 0)).alias("x6"))
    cols = ["station", "datetime", "lag1", "lag6", "lag12", "m12", "s24", "x6"]
    a, b = _rows(got, cols), _rows(exp, cols)
    assert len(a) == len(b) == 360
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            assert (x is None and y is None) or x == y or abs(x - y) < 1e-9


def test_chunked_fill_and_interpolation_match_unchunked(spark):
    p = _panel(spark, null_rate=0.5)
    big = PanelSpec(position_bucket="hour")
    small = big.replace(chunk_rows=4)
    a = _rows(clean.interpolate_linear(clean.forward_fill(p, small, ["PM2_5"]), small, ["TEMP"]),
              ["station", "datetime", "PM2_5", "TEMP"])
    b = _rows(clean.interpolate_linear(clean.forward_fill(p, big, ["PM2_5"]), big, ["TEMP"]),
              ["station", "datetime", "PM2_5", "TEMP"])
    assert a == b


def test_hot_key_spreads_over_chunks(spark):
    """One key with most rows is cut into many chunks, not one task."""
    rows = [("hot", t, 1.0, 1.0, None) for t in hours(400)] + [("cold", t, 1.0, 1.0, None) for t in hours(10)]
    p = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")
    spec = PanelSpec(chunk_rows=50, position_bucket="hour")
    chunks = with_position(p, spec).where(F.col("station") == "hot").select((F.col(POS) / 50).cast("int")).distinct()
    assert chunks.count() == 8


def test_sort_positions_equal_bucket_positions(spark):
    p = _panel(spark, 80)
    a = with_position(p, PanelSpec(position_bucket="hour")).select("station", "datetime", POS)
    b = with_position(p, PanelSpec(position_method="sort")).select("station", "datetime", POS)
    assert sorted(a.collect()) == sorted(b.collect())
    rows = [("hot", t, 1.0, 1.0, None) for t in hours(300)] + [("cold", t, 1.0, 1.0, None) for t in hours(5)]
    hot = spark.createDataFrame(rows, "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string")
    got = with_position(hot, PanelSpec(position_method="sort")).where(F.col("station") == "hot")
    assert sorted(r[0] for r in got.select(POS).collect()) == list(range(300))


def test_sort_method_windows_match(spark):
    p = _panel(spark, 60)
    lags = [ft.Lag("PM2_5", 3, "l3")]
    rolls = [ft.Roll("TEMP", 6, "mean", 2, "m6")]
    a = ft.window_features(p, PanelSpec(chunk_rows=7, position_method="sort"), lags, rolls)
    b = ft.window_features(p, PanelSpec(), lags, rolls)
    cols = ["station", "datetime", "l3", "m6"]
    assert _rows(a, cols) == _rows(b, cols)
