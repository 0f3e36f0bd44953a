"""Files of several headers, result folders that are replaced in part, and
descriptions of any names."""

import gzip
import json

import pytest

from tessera.plans import storage
from tessera.sources import io


def test_files_of_different_headers(spark, tmp_path):
    (tmp_path / "x" / "sub").mkdir(parents=True)
    (tmp_path / "x" / "a.csv").write_text("station,PM2.5,TEMP,year\ns1,1.5,NA,2013\ns1,bad,3,2013\n")
    (tmp_path / "x" / "b.csv").write_text("station,PM2.5,TEMP,year\ns2,2.5,4,2014\n")
    with gzip.open(tmp_path / "x" / "sub" / "c.csv.gz", "wt") as f:
        f.write('year,"station",extra,PM2.5\n2015,s3,z,7\n')
    (tmp_path / "x" / "empty.csv").write_text("")
    (tmp_path / "x" / "_ignored.csv").write_text("nothing\n1\n")
    df = io.read_raw_csv(spark, str(tmp_path / "x"))
    got = [(r.station, r.PM2_5, r.TEMP, r.year, r.malformed) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        ("s1", 1.5, None, 2013, 0), ("s1", None, 3.0, 2013, 1), ("s2", 2.5, 4.0, 2014, 0), ("s3", 7.0, None, 2015, 0)]))
    assert len(io.header_groups(spark, io.csv_files(spark, str(tmp_path / "x")))) == 2
    with pytest.raises(ValueError, match="TEMP"):
        io.read_raw_csv(spark, str(tmp_path / "x"), require=["station", "TEMP"])
    with pytest.raises(ValueError):
        io.read_raw_csv(spark, str(tmp_path / "none" / "*.csv"))
    assert io.read_raw_csv(spark, str(tmp_path / "x" / "empty.csv")).count() == 0


def test_results_are_replaced_by_part(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [(m, s, float(k)) for m in ("a", "b") for s in ("val", "test", None) for k in range(3)]
    df = spark.createDataFrame(rows, "model string, split string, p double")
    io.write_results(df, path)
    for _ in range(2):
        io.write_results(df.where("model = 'a' AND split = 'val' AND p < 2").selectExpr("model", "split", "p + 10 AS p"), path)
    got = sorted(map(str, ((r.model, r.split, r.p) for r in io.read_results(spark, path).collect())))
    want = [x for x in rows if x[:2] != ("a", "val")] + [("a", "val", 10.0), ("a", "val", 11.0)]
    assert got == sorted(map(str, want))
    assert {r.split for r in io.read_results(spark, path, model="b").collect()} == {"val", "test", None}


def test_metadata_of_any_names(spark, tmp_path):
    doc = {"title": "x", "features": {"first group": {"a.b": {"unit": "u", "extra": 1}, "c": {}}, "second": {"d": {"range": "1-2", "missing_percentage": 3}}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = {tuple(r) for r in io.read_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("first group", "a.b", "u", None, None), ("first group", "c", None, None, None), ("second", "d", None, "1-2", 3.0)}
    assert set(storage.QUERIES) == set(storage.SQL)
