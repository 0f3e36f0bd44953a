"""Row-ordered windows over many chunks per key.

The hourly queries again with chunks of 64 rows, numbered by both position
methods, and the same operators on a row-grain panel of ``lineitem`` (seven keys,
so thousands of rows and many chunks a key at any scale; rows of one day are
ordered by the spec's tiebreak). The SQL is that of the plain queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import COMPASS_POINTS
from tessera.operators import clean, features as ft, stats as st
from tessera.plans import cleaning, featuring, selection
from tessera.plans.common import PANEL_SQL, finish
from tessera.sources import fixtures as fx

SMALL = {"bucket": fx.EVENTS_SPEC.replace(chunk_rows=64), "sort": fx.EVENTS_SPEC.replace(chunk_rows=64, position_method="sort")}
ROWS = {m: s.replace(chunk_rows=500, position_bucket="month", tiebreak=("hh",)) for m, s in SMALL.items()}


def _forward_fill(p: DataFrame, spec) -> DataFrame:
    """W1 + W2."""
    return clean.forward_fill(p, spec, list(spec.pollutants) + [spec.wind]).drop("_pos")


def _interpolate(p: DataFrame, spec) -> DataFrame:
    """W3."""
    return clean.interpolate_linear(p, spec, spec.meteorology).drop("_pos")


def _missing_handled(p: DataFrame, spec) -> DataFrame:
    """W1 + W3 + W2 + P3."""
    return clean.handle_missing(p, spec)


def _systematic_sample(p: DataFrame, spec) -> DataFrame:
    """T5."""
    return st.systematic_sample(p, spec, 100)


def _forecast(p: DataFrame, spec) -> DataFrame:
    """W1/W2 -> W5 lags + W8 rolling -> P4."""
    p = _forward_fill(p, spec)
    return ft.drop_critical_nulls(ft.window_features(p, spec, ft.safe_lags(p, spec), ft.safe_rolls(p, spec)), spec)


def _hour_gaps(p: DataFrame, spec) -> DataFrame:
    """W12."""
    return clean.time_gaps(p, spec)


def _lags(p: DataFrame, spec) -> DataFrame:
    """W4."""
    return ft.window_features(p, spec, ft.full_lags(p, spec))


def _rolling(p: DataFrame, spec) -> DataFrame:
    """W7."""
    return ft.window_features(p, spec, rolls=ft.full_rolls(p, spec))


def _cleaned(p: DataFrame, spec) -> DataFrame:
    """C1."""
    return clean.preprocess(p, spec, dedupe_tiebreak=["hh"])[0].withColumn("hh", F.col("hh").cast("long"))


#: name of the plain query -> (operator, whether its panel has the extra columns)
HOURLY: dict[str, tuple[Callable, bool]] = {
    "forward_fill": (_forward_fill, False), "interpolate": (_interpolate, False), "missing_handled": (_missing_handled, False),
    "systematic_sample": (_systematic_sample, False), "forecast_features": (_forecast, False), "hour_gaps": (_hour_gaps, False),
    "lag_features": (_lags, True), "rolling_features": (_rolling, True), "cleaned_panel": (_cleaned, False),
    "basic_features": (ft.engineer_basic, True), "engineered_optimized": (ft.engineer_optimized, True),
    "engineered_full": (ft.engineer_full, True)}
ROW_GRAIN = ("forward_fill", "interpolate", "missing_handled", "systematic_sample", "forecast_features")


def _hourly(op: Callable, extra: bool, spec):
    def query(spark, sf_dir):
        return finish(op(fx.hourly_panel(spark, sf_dir, extra=extra), spec))
    query.__doc__ = f"{op.__doc__} On the hourly panel, chunks of {spec.chunk_rows} rows, {spec.position_method} positions."
    return query


def _row_grain(op: Callable, spec):
    def query(spark, sf_dir):
        return finish(op(fx.row_panel(spark, sf_dir), spec))
    query.__doc__ = f"{op.__doc__} On lineitem rows, chunks of {spec.chunk_rows} rows, {spec.position_method} positions."
    return query


QUERIES = {f"chunked_{m}_{n}": _hourly(op, extra, SMALL[m]) for m in SMALL for n, (op, extra) in HOURLY.items()}
QUERIES |= {f"rows_{m}_{n}": _row_grain(HOURLY[n][0], ROWS[m]) for m in ROWS for n in ROW_GRAIN}

_COMPASS = ", ".join(f"'{p}'" for p in COMPASS_POINTS)
ROW_PANEL_SQL = f"""
  SELECT 'k' || (l_suppkey % 7)::VARCHAR AS station, l_shipdate::TIMESTAMP AS datetime, l_orderkey * 10 + l_linenumber AS hh,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 50 BETWEEN 10 AND 17 THEN NULL ELSE l_extendedprice::DOUBLE END AS PM2_5,
         l_quantity::DOUBLE AS PM10, l_discount::DOUBLE AS SO2, l_tax::DOUBLE AS NO2,
         CASE WHEN l_orderkey % 3 > 0 THEN NULL ELSE l_quantity::DOUBLE / 7 END AS TEMP, ([{_COMPASS}])[l_partkey % 16 + 1] AS wd
  FROM lineitem
"""
_PLAIN = cleaning.SQL | featuring.SQL | selection.SQL
SQL = {f"chunked_{m}_{n}": _PLAIN[n] for m in SMALL for n in HOURLY}
SQL |= {f"rows_{m}_{n}": _PLAIN[n].replace(PANEL_SQL, ROW_PANEL_SQL).replace("ORDER BY datetime", "ORDER BY datetime, hh")
        for m in ROWS for n in ROW_GRAIN}
