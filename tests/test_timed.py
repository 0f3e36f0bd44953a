"""Windows and grids by time against plain loops, on keys with gaps."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.config import PanelSpec
from tessera.operators import clean, features as ft

START = dt.datetime(2024, 3, 30, 20)
SCHEMA = "station string, datetime timestamp_ntz, PM2_5 double, _x int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for key, share in (("a", 0.9), ("b", 0.3), ("c", 0.05)):
        for h in range(200):
            if rng.random() < share:
                out.append((key, START + dt.timedelta(hours=h), rng.choice([None, rng.uniform(0, 9), 1.0]), h))
    out += [(None, START + dt.timedelta(hours=3), 2.0, 0), ("d", START, 1.0, 0), ("e", None, 4.0, 0)]
    out += [("a", START + dt.timedelta(minutes=30), 5.0, 0)] * 2
    return out


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b))


@pytest.mark.parametrize("chunk_hours", [7, 8192])
@pytest.mark.parametrize("leak_safe", [False, True])
def test_windows_by_hours(spark, rows, chunk_hours, leak_safe):
    spec = PanelSpec(chunk_hours=chunk_hours)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    lags = [ft.Lag("PM2_5", k, f"l{k}") for k in (1, 24)]
    rolls = [ft.Roll("PM2_5", 6, "mean", 1, "m6"), ft.Roll("PM2_5", 24, "std", 3, "s24"), ft.Roll("PM2_5", 48, "max", 1, "x48")]
    got = ft.window_features(df, spec, lags, rolls, leak_safe, by="hours").collect()
    assert len(got) == len(rows)
    hour = dt.timedelta(hours=1)
    for r in got:
        own = [(t, v) for k, t, v, _ in rows if k == r.station and t is not None and v is not None]
        for k in (1, 24):
            seen = [v for t, v in own if r.datetime and t == r.datetime - k * hour]
            assert near(r[f"l{k}"], max(seen, default=None))
        if r.datetime is None:
            continue
        for name, n, least, f in (("m6", 6, 1, statistics.fmean), ("s24", 24, 3, statistics.stdev), ("x48", 48, 1, max)):
            lo = r.datetime - n * hour
            seen = [v for t, v in own if (lo <= t < r.datetime if leak_safe else lo < t <= r.datetime)]
            assert near(r[name], f(seen) if len(seen) >= least else None), (name, r)


def test_one_shuffle(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plan = ft.window_features(df, PanelSpec(), [ft.Lag("PM2_5", 1, "l")], [ft.Roll("PM2_5", 6, "mean", 1, "m")], by="hours")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    with pytest.raises(ValueError):
        ft.window_features(df, PanelSpec(), [ft.Lag("PM2_5", 1, "l")], by="days")


@pytest.mark.parametrize("chunk_hours", [5, 8192])
def test_grid(spark, rows, chunk_hours):
    spec = PanelSpec(chunk_hours=chunk_hours)
    df = spark.createDataFrame(rows, SCHEMA)
    want, have = set(), {}
    for k, t, _, _ in rows:
        if t is not None:
            have.setdefault(k, set()).add(t.replace(minute=0))
    for k, ts in have.items():
        t = min(ts)
        while t <= max(ts):
            if t not in ts:
                want.add((k, t))
            t += dt.timedelta(hours=1)
    got = [tuple(r) for r in clean.missing_hours(df, spec).collect()]
    assert len(got) == len(want) and set(got) == want
    full = clean.regularise(df, spec)
    assert full.columns == df.columns and full.count() == len(rows) + len(want)
    assert full.where(F.col("_x").isNull()).count() == len(want)
    assert clean.missing_hours(df.limit(0), spec).collect() == []
