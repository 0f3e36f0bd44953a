"""Tasks grow in number with the rows, and no step grows with the square of a key."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import hours
from tessera.config import PanelSpec
from tessera.operators import clean, sequence

SCHEMA = "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string"
FEW = 20
SPECS = [PanelSpec(chunk_rows=5, position_bucket="hour", position_method=m) for m in ("bucket", "sort")]


def _rows(n=120):
    rng = random.Random(11)
    some = lambda v: None if rng.random() < 0.6 else v
    return [(s, t, some(float(i)), some(float(i * i)), some("N")) for s in ("a", "b", None) for i, t in enumerate(hours(n))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _collected(df):
    return sorted(map(repr, df.collect()))


def test_no_frame_ends_with_its_partition(spark):
    """such a frame is computed anew for every row of the key or chunk."""
    p = spark.createDataFrame(_rows(), SCHEMA)
    assert "unboundedfollowing" not in _plan(clean.interpolate_linear(p, SPECS[0], ["TEMP"])).lower()


@pytest.mark.parametrize("spec", SPECS, ids=["bucket", "sort"])
def test_fills_deal_rows_to_more_tasks(spark, spec, monkeypatch):
    """what a task sorts does not grow with the table; results are the same."""
    p = spark.createDataFrame(_rows(), SCHEMA)
    want = _collected(clean.handle_missing(p, spec))
    monkeypatch.setattr(sequence, "TASK_ROWS", FEW, raising=False)
    got = clean.handle_missing(p, spec)
    assert ", 18), REPARTITION_BY_NUM" in _plan(got)  # 360 rows
    assert _collected(got) == want
    parts = sequence.with_position(p, spec).withColumn("part", F.spark_partition_id()).collect()
    assert max(Counter(r["part"] for r in parts).values()) <= 3 * FEW


def test_sorted_positions_of_many_keys(spark, monkeypatch):
    """offsets too many to broadcast are joined by key, with the same positions."""
    p = spark.createDataFrame(_rows(), SCHEMA)
    want = _collected(sequence.with_position(p, SPECS[1]))
    monkeypatch.setattr(sequence, "TASK_ROWS", FEW, raising=False)
    monkeypatch.setattr(sequence, "BROADCAST_ROWS", 0, raising=False)
    assert _collected(sequence.with_position(p, SPECS[1])) == want


def test_grid_and_fill_deal_rows_to_more_tasks(spark, monkeypatch):
    """the hourly grid, its join with the rows and the fill."""
    rows = [r for r in _rows(200) if r[1].hour % 3] + [("a", None, 1.0, 2.0, "S"), ("z", hours(1)[0], None, None, None)]
    p, spec = spark.createDataFrame(rows, SCHEMA), PanelSpec(chunk_rows=5, chunk_hours=24)
    want, absent = _collected(clean.regularise(p, spec)), _collected(clean.missing_hours(p, spec))
    assert len(want) == len(rows) + len(absent) and absent
    monkeypatch.setattr(sequence, "TASK_ROWS", FEW, raising=False)
    full = clean.regularise(p, spec)
    assert "REPARTITION_BY_NUM" in _plan(full) and _collected(full) == want
    assert _collected(clean.missing_hours(p, spec)) == absent
    filled = clean.forward_fill(full, spec, ["PM2_5"])
    assert filled.count() == len(want) and "REPARTITION_BY_NUM" in _plan(filled)
