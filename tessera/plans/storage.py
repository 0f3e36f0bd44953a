"""Registered queries of sources and sinks that keep what they write (S1, S4,
S5, S7, S9, S10, U1) and their DuckDB SQL. Each writes to a folder of its own
under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.plans import scoring
from tessera.plans.cleaning import SQL as CLEANING_SQL, _scratch, preprocessing_report
from tessera.plans.common import PANEL_EXTRA_SQL, PANEL_SQL, finish, r6, sql_round
from tessera.sources import fixtures as fx
from tessera.sources import io

SPEC = fx.EVENTS_SPEC
REPORT_SQL = CLEANING_SQL["preprocessing_report"]


def results_rerun(spark, sf_dir):
    """The scored rows of two models written by model and split, then one
    model run again, twice, with other forecasts: its part is replaced once,
    the other model's stays; read back whole."""
    path = _scratch(spark, "results")
    scored = scoring.scored(spark, sf_dir)
    io.write_results(scored, path)
    again = scored.where(F.col("model") == scoring.CANDIDATE).withColumn("p", F.col("p") + 1)
    for _ in range(2):
        io.write_results(again, path)
    return finish(io.read_results(spark, path).select("station", "datetime", "model", "split", "y", "p"))


def metrics_json(spark, sf_dir):
    """S4 + S5: the metric table as JSON, read back."""
    path = _scratch(spark, "metrics")
    table = mt.metrics(scoring.scored(spark, sf_dir), ["model", "split"])
    io.write_json(table, path)
    return finish(spark.read.schema(table.schema).json(path))


def report_file(spark, sf_dir):
    """The cleaning report as a text file, read back line by line."""
    path = _scratch(spark, "report")
    io.write_report(preprocessing_report(spark, sf_dir), path)
    return finish(spark.read.text(path).select(F.col("value").alias("line")))


def station_files(spark, sf_dir):
    """S1 + U1: stations as CSV files of two layouts, one with its columns in
    another order and without SO2, read as one panel."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    t = F.col("datetime")
    wide = p.select(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"),
                    F.col("PM2_5").alias("PM2.5"), "PM10", "SO2", "NO2", "TEMP", "PRES", "wd", "WSPM", "station")
    path, odd = _scratch(spark, "stations"), F.length("station") % 2 == 1
    io.write_csv(wide.where(~odd), f"{path}/a")
    io.write_csv(wide.where(odd).select(*reversed([f"`{c}`" for c in wide.columns if c != "SO2"])), f"{path}/b")
    back = io.read_raw_csv(spark, path, require=["station", "PM2.5"])
    at = F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0)).alias("datetime")
    return finish(back.select("station", at, "PM2_5", "PM10", "SO2", "NO2", "TEMP", "PRES", "WSPM", "wd", "malformed"))


GROUPS = {"pollutants": ("PM2_5", "PM10", "SO2", "NO2"), "meteorological": ("TEMP", "WSPM", "PRES")}
UNITS = {"TEMP": "degree", "PRES": "hPa"}


def metadata_table(spark, sf_dir):
    """A nested description of the panel's columns, made from its rows and
    written as one JSON document, read as a table."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    cols = [c for g in GROUPS.values() for c in g]
    row = p.agg(*[x for c in cols for x in (
        F.concat_ws("..", F.floor(F.min(c)).cast("long"), F.floor(F.max(c)).cast("long")).alias(f"{c}_range"),
        (F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}_missing"))])

    def entry(c):
        fields = [F.col(f"{c}_range").alias("range"), F.col(f"{c}_missing").alias("missing_percentage")]
        return F.struct(F.lit(UNITS[c]).alias("unit"), *fields) if c in UNITS else F.struct(*fields)

    features = F.struct(*[F.struct(*[entry(c).alias(c) for c in names]).alias(g) for g, names in GROUPS.items()])
    path = _scratch(spark, "metadata")
    io.write_json(row.select(F.lit("panel").alias("dataset_name"), features.alias("features")), path)
    return finish(io.read_metadata(spark, path))


def asset_check(spark, sf_dir):
    """S10 + J5: one file a station and one that nothing writes, checked against the
    files that are there."""
    path = _scratch(spark, "assets")
    p = fx.hourly_panel(spark, sf_dir)
    io.write_panel(p.withColumnRenamed("station", "split"), path)
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    own = have.select(F.regexp_extract("path", r"(split=[^/]+/part-[^/]+)$", 1).alias("path"))
    expected = own.unionByName(p.select(F.concat(F.lit("reports/"), "station", F.lit(".txt")).alias("path")).distinct())
    got = io.assets_check(spark, expected, path)
    kind = F.when(F.startswith("path", F.lit("reports/")), "report").otherwise("panel")
    station = F.coalesce(F.nullif(F.regexp_extract("path", r"split=([^/]+)/", 1), F.lit("")), F.regexp_extract("path", r"reports/(.*)\.txt", 1))
    return finish(got.select(station.alias("station"), kind.alias("kind"), "present").distinct())


QUERIES = {
    "results_rerun": results_rerun,
    "metrics_json": metrics_json,
    "report_file": report_file,
    "station_files": station_files,
    "metadata_table": metadata_table,
    "asset_check": asset_check,
}


def _metadata_sql() -> str:
    parts = []
    for g, names in GROUPS.items():
        for c in names:
            unit = f"'{UNITS[c]}'" if c in UNITS else "NULL::VARCHAR"
            parts.append(f"""SELECT '{g}' AS "group", '{c}' AS "column", {unit} AS unit,
              floor(min({c}))::BIGINT::VARCHAR || '..' || floor(max({c}))::BIGINT::VARCHAR AS value_range,
              {r6(f'avg(({c} IS NULL)::INT) * 100')} AS missing_pct FROM p""")
    return f"WITH p AS ({PANEL_EXTRA_SQL}) " + " UNION ALL ".join(parts)


SQL = {
    "results_rerun": f"""{scoring.WITH_SCORED}
      SELECT station, datetime, model, split, {r6('y')} AS y, {r6(f"p + CASE WHEN model = '{scoring.CANDIDATE}' THEN 1 ELSE 0 END")} AS p FROM scored""",
    "metrics_json": scoring.SQL["forecast_metrics"],
    "report_file": f"SELECT line FROM ({REPORT_SQL})",
    "station_files": f"""
      SELECT station, datetime, {sql_round(('PM2_5', 'PM10'))},
        {r6('CASE WHEN length(station) % 2 = 0 THEN SO2 END')} AS SO2, {sql_round(('NO2', 'TEMP', 'PRES', 'WSPM'))}, wd, 0::BIGINT AS malformed
      FROM ({PANEL_EXTRA_SQL})""",
    "metadata_table": _metadata_sql(),
    "asset_check": f"""
      SELECT station, kind, present FROM (SELECT DISTINCT station FROM ({PANEL_SQL})),
        (VALUES ('panel', 1::BIGINT), ('report', 0::BIGINT)) AS v(kind, present)""",
}
