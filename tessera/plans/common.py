"""Shared pieces of the registered queries: output normalisation and the SQL
text of the two fixture panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import COMPASS_POINTS

DIGITS = 6


def stable_round(c, digits: int = DIGITS):
    """Round first to 10 decimals (as DECIMAL(38,10)), then to ``digits``,
    halves away from zero: values that differ only in the last bits (sums
    taken in another order) print the same, and the decimal form keeps the
    expression small on wide tables.  NaN and infinities become NULL."""
    return F.round(c.try_cast("decimal(38,10)"), digits).cast("double")


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Output form of every registered query: doubles rounded, integers as
    bigint, booleans as int, timestamps without zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = stable_round(c.cast("double"), digits)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, T.BooleanType):
            c = c.cast("long")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def r6(expr: str) -> str:
    """SQL twin of :func:`stable_round`."""
    return f"round(TRY_CAST(({expr})::DOUBLE AS DECIMAL(38,10)), {DIGITS})::DOUBLE"


def sql_round(cols: Sequence[str]) -> str:
    return ", ".join(f"{r6(q(c))} AS {q(c)}" for c in cols)


def sql_cols(cols: Sequence[str]) -> str:
    return ", ".join(q(c) for c in cols)


_COMPASS = ", ".join(f"'{p}'" for p in COMPASS_POINTS)
HH = "date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', date_trunc('hour', ts))"

# F4 hourly panel (events) as DuckDB SQL; extra adds WSPM and PRES.
PANEL_SQL = f"""
  SELECT station, datetime, hh,
         CASE WHEN hh % 50 BETWEEN 10 AND 17 THEN NULL ELSE v_avg END AS PM2_5,
         PM10, SO2, NO2,
         CASE WHEN hh % 40 BETWEEN 5 AND 7 THEN NULL ELSE k_avg END AS TEMP,
         ([{_COMPASS}])[wd_idx + 1] AS wd
  FROM (
    SELECT event_type AS station, date_trunc('hour', ts) AS datetime, {HH} AS hh,
           avg(value) AS v_avg, max(value) AS PM10, min(value) AS SO2, sum(value) AS NO2,
           avg(json_extract(props, '$.k')::DOUBLE) AS k_avg, min(user_id % 16) AS wd_idx, count(*) AS n
    FROM events GROUP BY 1, 2, 3)
"""

PANEL_EXTRA_SQL = f"""
  SELECT station, datetime, hh,
         CASE WHEN hh % 50 BETWEEN 10 AND 17 THEN NULL ELSE v_avg END AS PM2_5,
         PM10, SO2, NO2,
         CASE WHEN hh % 40 BETWEEN 5 AND 7 THEN NULL ELSE k_avg END AS TEMP,
         ([{_COMPASS}])[wd_idx + 1] AS wd,
         n::DOUBLE AS WSPM, 1000.0 + PM10 / 10 AS PRES
  FROM (
    SELECT event_type AS station, date_trunc('hour', ts) AS datetime, {HH} AS hh,
           avg(value) AS v_avg, max(value) AS PM10, min(value) AS SO2, sum(value) AS NO2,
           avg(json_extract(props, '$.k')::DOUBLE) AS k_avg, min(user_id % 16) AS wd_idx, count(*) AS n
    FROM events GROUP BY 1, 2, 3)
"""

# F5 daily panel (orders).
DAILY_SQL = """
  SELECT o_orderpriority AS station, o_orderdate AS datetime,
         avg(o_totalprice) AS PM2_5, max(o_totalprice) AS PM10
  FROM orders GROUP BY 1, 2
"""

PANEL_COLUMNS = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
