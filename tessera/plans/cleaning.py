"""Registered cleaning queries (S11, P1-P3, A1-A5, W1-W3, W12, C1) and their
DuckDB oracle SQL.  Inputs: the F4 hourly panel from ``events``, the raw
``events`` rows, and the F5 daily panel from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import (FORWARD_FILL_LIMIT, IQR_EXTREME_MULTIPLIER, IQR_MULTIPLIER, PHYSICAL_LIMITS)
from tessera.operators import clean
from tessera.plans.common import DAILY_SQL, PANEL_EXTRA_SQL, PANEL_SQL, finish, q, r6, sql_cols, sql_round
from tessera.sources import fixtures as fx
from tessera.sources.io import overview

SPEC = fx.EVENTS_SPEC
POLLUTANTS_F4 = ("PM2_5", "PM10", "SO2", "NO2")
FILLED = POLLUTANTS_F4 + ("wd",)
NUMERIC_F4 = ("hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP")
DOUBLES_F4 = ("PM2_5", "PM10", "SO2", "NO2", "TEMP")


# ------------------------------------------------------------------ Spark side

def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: first event per (user_id, hour) by event_id."""
    raw = fx.raw_events_keyed(spark, sf_dir)
    return finish(clean.remove_duplicates(raw, ["user_id", "datetime"], ["event_id"]))


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 report: rows removed by the (user_id, hour) duplicate filter."""
    raw = fx.raw_events_keyed(spark, sf_dir)
    return finish(clean.duplicate_count(raw, ["user_id", "datetime"]))


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2: pollutants and wind label forward filled, at most 6 rows, per station."""
    p = fx.hourly_panel(spark, sf_dir)
    return finish(clean.forward_fill(p, SPEC, list(SPEC.pollutants) + [SPEC.wind]).drop("_pos"))


def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meteorology linearly interpolated by row position, ends nearest value."""
    p = fx.hourly_panel(spark, sf_dir)
    return finish(clean.interpolate_linear(p, SPEC, SPEC.meteorology).drop("_pos"))


def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: nulls per panel column before filling."""
    return finish(clean.null_profile(fx.hourly_panel(spark, sf_dir)))


def missing_handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W3 + W2 + P3: filled panel with sparse rows dropped."""
    return finish(clean.handle_missing(fx.hourly_panel(spark, sf_dir), SPEC))


def null_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 before/after the missing-value stage and the reduction percent."""
    p = fx.hourly_panel(spark, sf_dir)
    return finish(clean.null_reduction(p, clean.handle_missing(p, SPEC)))


def physical_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: clip to physical limits (NULL stays NULL)."""
    return finish(clean.clip_physical(fx.hourly_panel(spark, sf_dir), SPEC))


def physical_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 report: values outside the physical limits per column."""
    return finish(clean.clip_counts(fx.hourly_panel(spark, sf_dir), SPEC))


def iqr_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: global Q1/Q3 per numeric column (exact), cap beyond 3 IQR."""
    capped, _ = clean.cap_iqr(fx.hourly_panel(spark, sf_dir), SPEC)
    return finish(capped.withColumn("hh", F.col("hh").cast("long")))


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 report: values outside 1.5 IQR per numeric column."""
    _, report = clean.cap_iqr(fx.hourly_panel(spark, sf_dir), SPEC)
    return finish(report)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: negatives, continuity, target range and verdict, one row."""
    s = clean.quality_summary(fx.hourly_panel(spark, sf_dir), SPEC)
    return finish(s.withColumn("high_missing_columns", F.array_join("high_missing_columns", ",")))


def continuity_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 per station: rows against expected hours."""
    return finish(clean.continuity_by_key(fx.hourly_panel(spark, sf_dir), SPEC))


def hour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of absent hours per station."""
    return finish(clean.time_gaps(fx.hourly_panel(spark, sf_dir), SPEC))


def sparse_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 alone on the raw panel: rows with more than 10 % null columns dropped."""
    return finish(clean.drop_sparse_rows(fx.hourly_panel(spark, sf_dir), SPEC))


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on the daily panel: year-based split with midnight bounds."""
    d = clean.temporal_split(fx.daily_panel(spark, sf_dir), fx.ORDERS_SPEC)
    return finish(d.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first"),
                                         F.max("datetime").alias("last")))


def panel_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, time span, nulls per split of the split hourly panel."""
    d = clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC)
    return finish(overview(d))


def cleaned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates -> fills + sparse rows -> physical clip -> IQR cap -> split."""
    d, _ = clean.preprocess(fx.hourly_panel(spark, sf_dir), SPEC, dedupe_tiebreak=["hh"])
    return finish(d.withColumn("hh", F.col("hh").cast("long")))


QUERIES = {
    "dedupe_events": dedupe_events,
    "duplicate_report": duplicate_report,
    "forward_fill": forward_fill,
    "interpolate": interpolate,
    "null_profile": null_profile,
    "missing_handled": missing_handled,
    "null_reduction": null_reduction,
    "physical_clip": physical_clip,
    "physical_outliers": physical_outliers,
    "iqr_capped": iqr_capped,
    "iqr_outliers": iqr_outliers,
    "quality": quality,
    "continuity_by_station": continuity_by_station,
    "hour_gaps": hour_gaps,
    "sparse_rows_dropped": sparse_rows_dropped,
    "temporal_split": temporal_split,
    "panel_overview": panel_overview,
    "cleaned_panel": cleaned_panel,
}


# ------------------------------------------------------------------ SQL side

def ffill_sql(src: str, cols=FILLED, limit: int = FORWARD_FILL_LIMIT) -> str:
    rest = [c for c in ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd") if c not in cols]
    fills = ", ".join(f"last_value({q(c)} IGNORE NULLS) OVER w AS {q(c)}" for c in cols)
    return (f"SELECT {sql_cols(rest)}, {fills} FROM ({src}) "
            f"WINDOW w AS (PARTITION BY station ORDER BY datetime ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)")


def interp_sql(src: str, col: str = "TEMP", others=("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2",
                                                       "wd")) -> str:
    c = q(col)
    return f"""
    SELECT {sql_cols(others)},
      CASE WHEN {c} IS NOT NULL THEN {c}
           WHEN vp IS NOT NULL AND vq IS NOT NULL THEN vp + (vq - vp) * (rn - rp) / (rq - rp)
           ELSE coalesce(vp, vq) END AS {c}
    FROM (
      SELECT *,
        last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS rp,
        last_value({c} IGNORE NULLS) OVER up AS vp,
        first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER down AS rq,
        first_value({c} IGNORE NULLS) OVER down AS vq
      FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY datetime) - 1 AS rn FROM ({src}))
      WINDOW up AS (PARTITION BY station ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             down AS (PARTITION BY station ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    """


def sparse_sql(src: str, cols=("station", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")) -> str:
    import math
    n = len(cols)
    need = math.ceil(n - 0.1 * n)
    nn = " + ".join(f"({q(c)} IS NOT NULL)::INT" for c in cols)
    return f"SELECT * FROM ({src}) WHERE {nn} >= {need}"


def handled_sql(src: str = PANEL_SQL) -> str:
    return sparse_sql(interp_sql(ffill_sql(src)))


def clip_sql(src: str) -> str:
    parts = []
    for c in ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd"):
        if c in PHYSICAL_LIMITS:
            lo, hi = PHYSICAL_LIMITS[c]
            parts.append(f"CASE WHEN {q(c)} IS NULL THEN NULL ELSE least(greatest({q(c)}, {lo}), {hi}) END AS {q(c)}")
        else:
            parts.append(q(c))
    return f"SELECT {', '.join(parts)} FROM ({src})"


def iqr_sql(src: str, report: bool = False) -> str:
    qs = ", ".join(f"quantile_cont({q(c)}::DOUBLE, 0.25) AS {q(c + '_q1')}, "
                   f"quantile_cont({q(c)}::DOUBLE, 0.75) AS {q(c + '_q3')}" for c in NUMERIC_F4)
    if report:
        rows = " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {q(c)} < b.{q(c + '_q1')} - {IQR_MULTIPLIER} * "
            f"(b.{q(c + '_q3')} - b.{q(c + '_q1')}) OR {q(c)} > b.{q(c + '_q3')} + {IQR_MULTIPLIER} * "
            f"(b.{q(c + '_q3')} - b.{q(c + '_q1')}))::BIGINT AS iqr_outliers FROM p, b" for c in NUMERIC_F4)
        return f"WITH p AS ({src}), b AS (SELECT {qs} FROM p) {rows}"
    parts = []
    for c in ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd"):
        if c in NUMERIC_F4:
            q1, q3 = f"b.{q(c + '_q1')}", f"b.{q(c + '_q3')}"
            xlo = f"({q1} - {IQR_EXTREME_MULTIPLIER} * ({q3} - {q1}))"
            xhi = f"({q3} + {IQR_EXTREME_MULTIPLIER} * ({q3} - {q1}))"
            cast = "::BIGINT" if c == "hh" else ""
            parts.append(f"CASE WHEN {q(c)} < {xlo} THEN ({xlo}){cast} WHEN {q(c)} > {xhi} THEN ({xhi}){cast} "
                         f"ELSE {q(c)} END AS {q(c)}")
        else:
            parts.append(f"p.{q(c)}")
    return f"WITH p AS ({src}), b AS (SELECT {qs} FROM p) SELECT {', '.join(parts)} FROM p, b"


def split_sql(src: str, tr: str, vs: str, ve: str, ts: str) -> str:
    return (f"SELECT *, CASE WHEN datetime <= TIMESTAMP '{tr}' THEN 'train' "
            f"WHEN datetime >= TIMESTAMP '{vs}' AND datetime <= TIMESTAMP '{ve}' THEN 'val' "
            f"WHEN datetime >= TIMESTAMP '{ts}' THEN 'test' END AS split FROM ({src})")


def f4_split_sql(src: str) -> str:
    return split_sql(src, SPEC.train_end, SPEC.val_start, SPEC.val_end, SPEC.test_start)


OUT_F4 = f"station, datetime, hh::BIGINT AS hh, {sql_round(DOUBLES_F4)}, wd"


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["dedupe_events"] = f"""
      SELECT event_id, user_id, date_trunc('hour', ts) AS datetime, event_type, {r6('value')} AS value
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) = 1"""
    s["duplicate_report"] = """
      SELECT sum(n - 1)::BIGINT AS duplicates_removed, sum(n)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after
      FROM (SELECT count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts))"""
    s["forward_fill"] = f"SELECT {OUT_F4} FROM ({ffill_sql(PANEL_SQL)})"
    s["interpolate"] = f"SELECT {OUT_F4} FROM ({interp_sql(PANEL_SQL)})"
    s["null_profile"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {q(c)} IS NULL)::BIGINT AS nulls FROM ({PANEL_SQL})"
        for c in ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd"))
    s["missing_handled"] = f"SELECT {OUT_F4} FROM ({handled_sql()})"
    nulls = lambda src: " + ".join(
        f"count(*) FILTER (WHERE {q(c)} IS NULL)" for c in
        ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")) + f" FROM ({src})"
    s["null_reduction"] = f"""
      SELECT b::BIGINT AS nulls_before, a::BIGINT AS nulls_after,
             {r6('CASE WHEN b = 0 THEN NULL ELSE (b - a) * 100.0 / b END')} AS reduction_pct
      FROM (SELECT {nulls(PANEL_SQL)}) AS x(b), (SELECT {nulls(handled_sql())}) AS y(a)"""
    s["physical_clip"] = f"SELECT {OUT_F4} FROM ({clip_sql(PANEL_SQL)})"
    s["physical_outliers"] = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {q(c)} < {PHYSICAL_LIMITS[c][0]} OR "
        f"{q(c)} > {PHYSICAL_LIMITS[c][1]})::BIGINT AS outliers FROM ({PANEL_SQL})"
        for c in PHYSICAL_LIMITS if c in DOUBLES_F4)
    s["iqr_capped"] = f"SELECT {OUT_F4} FROM ({iqr_sql(PANEL_SQL)})"
    s["iqr_outliers"] = iqr_sql(PANEL_SQL, report=True)
    cols9 = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
    high = ", ".join(f"CASE WHEN avg(({q(c)} IS NULL)::INT) * 100 > 10 THEN '{c}' END" for c in cols9)
    negs = ", ".join(f"count(*) FILTER (WHERE {q(c)} < 0)::BIGINT AS {q('neg_' + c)}" for c in POLLUTANTS_F4)
    ok = " AND ".join(f"count(*) FILTER (WHERE {q(c)} < 0) = 0" for c in POLLUTANTS_F4)
    span = "(epoch(max(datetime)) - epoch(min(datetime))) / 3600.0 + 1"
    s["quality"] = f"""
      SELECT {negs}, count(*)::BIGINT AS rows, {r6(span)} AS expected_hours,
             {r6('count(*) * 100.0 / (' + span + ')')} AS continuity_pct,
             array_to_string(list_filter([{high}], lambda x: x IS NOT NULL), ',') AS high_missing_columns,
             {r6('max(PM2_5) - min(PM2_5)')} AS target_range,
             ({ok})::BIGINT AS validation_passed,
             (count(*) * 100.0 / ({span}) >= 80)::BIGINT AS continuity_ok,
             (max(PM2_5) - min(PM2_5) >= 10)::BIGINT AS target_range_ok
      FROM ({PANEL_SQL})"""
    s["continuity_by_station"] = f"""
      SELECT station, count(*)::BIGINT AS rows, {r6(span)} AS expected_hours,
             {r6('count(*) * 100.0 / (' + span + ')')} AS continuity_pct
      FROM ({PANEL_SQL}) GROUP BY station"""
    s["hour_gaps"] = f"""
      SELECT station, prev + INTERVAL 1 HOUR AS gap_start, datetime - INTERVAL 1 HOUR AS gap_end,
             (date_diff('hour', prev, datetime) - 1)::BIGINT AS missing_hours
      FROM (SELECT station, datetime, lag(datetime) OVER (PARTITION BY station ORDER BY datetime) AS prev
            FROM ({PANEL_SQL}))
      WHERE date_diff('hour', prev, datetime) - 1 >= 1"""
    s["sparse_rows_dropped"] = f"SELECT {OUT_F4} FROM ({sparse_sql(PANEL_SQL)})"
    o = fx.ORDERS_SPEC
    s["temporal_split"] = f"""
      SELECT split, count(*)::BIGINT AS rows, min(datetime) AS first, max(datetime) AS last
      FROM ({split_sql(DAILY_SQL, o.train_end, o.val_start, o.val_end, o.test_start)}) GROUP BY split"""
    total_nulls = " + ".join(f"({q(c)} IS NULL)::BIGINT" for c in cols9 + ("split",))
    s["panel_overview"] = f"""
      SELECT split, count(*)::BIGINT AS rows, min(datetime) AS min_time, max(datetime) AS max_time,
             1::BIGINT AS has_target, sum({total_nulls})::BIGINT AS total_nulls, 10::BIGINT AS n_columns
      FROM ({f4_split_sql(PANEL_SQL)}) GROUP BY split"""
    s["cleaned_panel"] = f"SELECT {OUT_F4}, split FROM ({f4_split_sql(iqr_sql(clip_sql(handled_sql())))})"
    return s


SQL = _sql()


# ------------------------------------------------------------------ sources round trips

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid

    from tessera.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-io/{name}-{uuid.uuid4().hex}"


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S2: the split panel written as Parquet partitioned by ``split``,
    read back with a split filter (partition pruning: only ``split=test`` is listed)."""
    from tessera.sources import io
    path = _scratch(spark, "panel")
    io.write_panel(clean.temporal_split(fx.hourly_panel(spark, sf_dir), SPEC).where(F.col("split").isNotNull()), path)
    return finish(io.read_panel(spark, path, split="test").select(*PANEL_COLS, "split"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1: the panel in the raw layout (date parts, ``PM2.5`` header, "NA"
    nulls) written as CSV, scanned with the declared raw schema, time index rebuilt."""
    from tessera.sources import io
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    t = F.col("datetime")
    raw = p.select(F.lit(1).alias("No"), F.year(t).alias("year"), F.month(t).alias("month"),
                   F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.col("PM2_5").alias("PM2.5"),
                   "PM10", "SO2", "NO2", F.lit(None).cast("double").alias("CO"), F.lit(None).cast("double").alias("O3"),
                   "TEMP", "PRES", F.lit(None).cast("double").alias("DEWP"), F.lit(None).cast("double").alias("RAIN"),
                   "wd", "WSPM", "station")
    path = _scratch(spark, "raw-csv")
    io.write_csv(raw, path)
    back = clean.with_time_index(io.read_raw_csv(spark, f"{path}/*.csv"), SPEC)
    return finish(back.select("station", "datetime", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "PRES", "WSPM", "wd"))


def preprocessing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 (cleaning): the report lines of C1, built from its report tables."""
    p = fx.hourly_panel(spark, sf_dir)
    d, reports = clean.preprocess(p, SPEC, dedupe_tiebreak=["hh"])
    return finish(clean.preprocessing_report(reports, p, d))


PANEL_COLS = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
QUERIES.update({"parquet_roundtrip": parquet_roundtrip, "csv_roundtrip": csv_roundtrip,
                "preprocessing_report": preprocessing_report})
SQL["parquet_roundtrip"] = f"SELECT {OUT_F4}, split FROM ({f4_split_sql(PANEL_SQL)}) WHERE split = 'test'"
SQL["csv_roundtrip"] = f"""
  SELECT station, datetime, {sql_round(('PM2_5', 'PM10', 'SO2', 'NO2', 'TEMP', 'PRES', 'WSPM'))}, wd
  FROM ({PANEL_EXTRA_SQL})"""


def _report_sql() -> str:
    """The lines of A22, each from its own step of C1."""
    cols = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
    nulls = " + ".join(f"count(*) FILTER (WHERE {q(c)} IS NULL)" for c in cols)
    limited = [c for c in PHYSICAL_LIMITS if c in DOUBLES_F4]
    outside = lambda c: f"{q(c)} < {PHYSICAL_LIMITS[c][0]} OR {q(c)} > {PHYSICAL_LIMITS[c][1]}"
    negative = " OR ".join(f"bool_or({q(c)} < 0)" for c in POLLUTANTS_F4)
    parts = [
        "SELECT 0 AS part, 'rows read: ' || count(*) AS line FROM raw",
        "SELECT 1, 'duplicate rows dropped: ' || (count(*) - count(DISTINCT (station, datetime))) FROM raw",
        f"SELECT 2, 'null values before and after the fills: ' || (SELECT {nulls} FROM raw) || ', ' || (SELECT {nulls} FROM handled)",
        *[f"""SELECT 3, '{c}: ' || n || ' values set to a physical limit'
              FROM (SELECT count(*) FILTER (WHERE {outside(c)}) AS n FROM handled) WHERE n > 0""" for c in limited],
        f"""SELECT 4, "column" || ': ' || iqr_outliers || ' values outside the quartile range'
            FROM ({iqr_sql('SELECT * FROM clipped', report=True)}) WHERE iqr_outliers > 0""",
        f"SELECT 5, 'negative pollutant values: ' || CASE WHEN {negative} THEN 'some' ELSE 'none' END FROM capped",
        f"SELECT 6, 'rows of no split: ' || count(*) FILTER (WHERE split IS NULL) FROM ({f4_split_sql('SELECT * FROM capped')})",
        "SELECT 7, 'rows kept: ' || count(*) FROM capped",
    ]
    return f"""
      WITH raw AS MATERIALIZED ({PANEL_SQL}), handled AS MATERIALIZED ({handled_sql('SELECT * FROM raw')}),
      clipped AS MATERIALIZED ({clip_sql('SELECT * FROM handled')}), capped AS MATERIALIZED ({iqr_sql('SELECT * FROM clipped')})
      SELECT row_number() OVER (ORDER BY part, line)::BIGINT - 1 AS seq, line FROM ({' UNION ALL '.join(parts)})"""


SQL["preprocessing_report"] = _report_sql()
