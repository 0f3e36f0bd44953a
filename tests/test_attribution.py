"""Linear attribution takes every test row."""

import random

import pytest

from tessera.plans import modeling


def test_linear_attribution_takes_all_test_rows(spark, monkeypatch):
    rng, target = random.Random(3), modeling.SPEC.target
    rows = [("train" if i < 300 else "test", f"s{i % 5}", i, x := rng.gauss(0, 1), 3 * x) for i in range(1800)]
    df = spark.createDataFrame(rows, f"split string, station string, datetime long, x double, `{target}` double")
    monkeypatch.setattr(modeling, "_engineered_frame", lambda *_: (df, ["x"]))
    got = modeling.linear_attribution(spark, "").collect()
    mean = sum(r[3] for r in rows[:300]) / 300
    want = sum(abs(3 * (r[3] - mean)) for r in rows[300:]) / 1500
    assert len(got) == 1 and got[0].mean_abs_contribution == pytest.approx(want, abs=1e-5)
