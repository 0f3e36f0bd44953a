"""Sources and sinks: Parquet by split, JSON, model persistence, metadata
document, asset check."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.ml import models as ml
from tessera.sources import io


def _frame(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i), 2.0 * i + 1, "train" if i < 8 else "test")
            for i in range(10)]
    return spark.createDataFrame(rows, "station string, datetime timestamp_ntz, x double, y double, split string")


def test_parquet_by_split_and_json(spark):
    out = tempfile.mkdtemp(prefix="tessera-io-")
    df = _frame(spark)
    io.write_panel(df, f"{out}/panel")
    assert sorted(os.listdir(f"{out}/panel"))[-2:] == ["split=test", "split=train"]
    assert io.read_panel(spark, f"{out}/panel", "test").count() == 2
    io.write_json(df.groupBy("split").count(), f"{out}/counts")
    assert spark.read.json(f"{out}/counts").count() == 2


def test_model_save_load_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="tessera-model-")
    df = _frame(spark)
    m = ml.fit("linear", df, ["x"], "y")
    m.save(f"{out}/m")
    back = ml.Fitted.load(f"{out}/m")
    assert back.features == ["x"] and back.kind == "linear"
    a = m.predict(df).select("p").collect()
    b = back.predict(df).select("p").collect()
    assert a == b
    unfitted = ml.Fitted(None, ["x"], "y", "linear")
    try:
        unfitted.predict(df)
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_metadata_and_asset_check(spark):
    root = tempfile.mkdtemp(prefix="tessera-meta-")
    doc = {"dataset_name": "x", "features": {
        "pollutants": {"PM2.5": {"unit": "ug/m3", "range": "0-994", "missing_percentage": 5.1}},
        "meteorological": {"TEMP": {"unit": "C", "range": "-19-42", "missing_percentage": 0.1}}}}
    with open(f"{root}/metadata.json", "w") as f:
        json.dump(doc, f)
    meta = {r["column"]: r for r in io.read_metadata(spark, f"{root}/metadata.json").collect()}
    assert meta["PM2.5"]["unit"] == "ug/m3" and meta["TEMP"]["missing_pct"] == 0.1
    expected = spark.createDataFrame([("metadata.json",), ("absent.csv",)], "path string")
    got = {r["path"]: r["present"] for r in io.assets_check(spark, expected, root).collect()}
    assert got == {"metadata.json": True, "absent.csv": False}


def test_overview_per_split(spark):
    rows = {r["split"]: r for r in io.overview(_frame(spark), target="y").collect()}
    assert rows["train"]["rows"] == 8 and rows["test"]["total_nulls"] == 0
    assert rows["train"]["min_time"] == dt.datetime(2024, 1, 1)
    assert F is not None
