"""Registered queries of windows and grids by time (W4-W9 by hours, W12) on
the per-user panel, whose keys have gaps, and their DuckDB SQL."""

from __future__ import annotations

from tessera import config as C
from tessera.operators import clean, features as ft
from tessera.plans.common import finish, q, r6
from tessera.sources import fixtures as fx

SPEC = fx.EVENTS_SPEC
# Many chunks a key: 30 days are 8 chunks of 96 hours.
CHUNKED = SPEC.replace(chunk_hours=96)
DOUBLES = ("PM2_5", "PM10", "SO2", "NO2", "TEMP", "PRES")
# A panel with these columns, for the lists of lags and windows.
COLUMNS = ("station", "datetime", *DOUBLES)


class _Names:
    """The lag and window lists ask a frame only for its columns."""
    columns = list(COLUMNS)


def hour_lags(spark, sf_dir):
    """W4 by hours: the value k hours before, null where that hour is absent."""
    p = fx.user_panel(spark, sf_dir)
    return finish(ft.window_features(p, CHUNKED, ft.full_lags(p, CHUNKED), by="hours"))


def hour_safe_features(spark, sf_dir):
    """W5 + W8 by hours: lags and rolling statistics with min_periods."""
    p = fx.user_panel(spark, sf_dir)
    return finish(ft.window_features(p, CHUNKED, ft.safe_lags(p, CHUNKED), ft.safe_rolls(p, CHUNKED), by="hours"))


def hour_basic_features(spark, sf_dir):
    """W6 + W9 by hours, one chunk a key."""
    p = fx.user_panel(spark, sf_dir)
    return finish(ft.window_features(p, SPEC, ft.basic_lags(p, SPEC), ft.basic_rolls(p, SPEC), by="hours"))


def hour_rolling(spark, sf_dir):
    """W7 by hours: mean, std, max, min of the last 6 to 48 hours."""
    p = fx.user_panel(spark, sf_dir)
    return finish(ft.window_features(p, CHUNKED, rolls=ft.full_rolls(p, CHUNKED), by="hours"))


def hour_rolling_leak_safe(spark, sf_dir):
    """W7 by hours over the hours before the row's."""
    p = fx.user_panel(spark, sf_dir)
    return finish(ft.window_features(p, CHUNKED, rolls=ft.full_rolls(p, CHUNKED), leak_safe=True, by="hours"))


def missing_hour_rows(spark, sf_dir):
    """Every hour between a user's first and last that has no row."""
    return finish(clean.missing_hours(fx.user_panel(spark, sf_dir), CHUNKED))


def regular_panel(spark, sf_dir):
    """W12 + W1: the panel on its full hourly grid, pollutants carried forward
    over at most six hours."""
    p = clean.regularise(fx.user_panel(spark, sf_dir), CHUNKED)
    return finish(clean.drop_position(clean.forward_fill(p, CHUNKED, CHUNKED.pollutants)))


QUERIES = {
    "hour_lags": hour_lags,
    "hour_safe_features": hour_safe_features,
    "hour_basic_features": hour_basic_features,
    "hour_rolling": hour_rolling,
    "hour_rolling_leak_safe": hour_rolling_leak_safe,
    "missing_hour_rows": missing_hour_rows,
    "regular_panel": regular_panel,
}


# ------------------------------------------------------------------ SQL side

USER_PANEL_SQL = """
  SELECT user_id::VARCHAR AS station, date_trunc('hour', ts) AS datetime, avg(value) AS PM2_5, max(value) AS PM10,
    min(value) AS SO2, sum(value) AS NO2, avg(json_extract(props, '$.k')::DOUBLE) AS TEMP, 1000.0::DOUBLE + count(*) AS PRES
  FROM events GROUP BY 1, 2"""
_STAT = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
_BASE = ", ".join(["station", "datetime", *(f"{r6(c)} AS {c}" for c in DOUBLES)])


def _hours_sql(lags=(), rolls=(), leak_safe=False) -> str:
    over = "PARTITION BY station ORDER BY datetime RANGE BETWEEN"
    cols = [_BASE]
    for lg in lags:
        cols.append(f"{r6(f'max({q(lg.src)}) OVER ({over} INTERVAL {lg.k} HOUR PRECEDING AND INTERVAL {lg.k} HOUR PRECEDING)')} AS {q(lg.name)}")
    for r in rolls:
        frame = (f"INTERVAL {r.n} HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING" if leak_safe
                 else f"INTERVAL {r.n * 3600 - 1} SECOND PRECEDING AND CURRENT ROW")
        x = f"{_STAT[r.stat]}({q(r.src)}) OVER ({over} {frame})"
        if r.min_periods > 1:
            x = f"CASE WHEN count({q(r.src)}) OVER ({over} {frame}) >= {r.min_periods} THEN {x} END"
        cols.append(f"{r6(x)} AS {q(r.name)}")
    return f"SELECT {', '.join(cols)} FROM ({USER_PANEL_SQL})"


_GRID_SQL = f"""
  SELECT station, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
  FROM ({USER_PANEL_SQL}) GROUP BY station"""
_FILLED = ", ".join(
    f"{r6(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY station ORDER BY datetime ROWS BETWEEN {C.FORWARD_FILL_LIMIT} PRECEDING AND CURRENT ROW)')} AS {c}"
    if c in SPEC.pollutants else f"{r6(c)} AS {c}" for c in DOUBLES)
_N = _Names()
SQL = {
    "hour_lags": _hours_sql(ft.full_lags(_N, SPEC)),
    "hour_safe_features": _hours_sql(ft.safe_lags(_N, SPEC), ft.safe_rolls(_N, SPEC)),
    "hour_basic_features": _hours_sql(ft.basic_lags(_N, SPEC), ft.basic_rolls(_N, SPEC)),
    "hour_rolling": _hours_sql(rolls=ft.full_rolls(_N, SPEC)),
    "hour_rolling_leak_safe": _hours_sql(rolls=ft.full_rolls(_N, SPEC), leak_safe=True),
    "missing_hour_rows": f"SELECT station, datetime FROM ({_GRID_SQL}) ANTI JOIN ({USER_PANEL_SQL}) USING (station, datetime)",
    "regular_panel": f"SELECT station, datetime, {_FILLED} FROM ({_GRID_SQL}) LEFT JOIN ({USER_PANEL_SQL}) USING (station, datetime)",
}
