"""Registered feature queries (M1-M8, W4-W10, A6, A8, P4, C2-C4) and their
DuckDB oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tessera import config as C
from tessera.operators import clean, features as ft
from tessera.plans.cleaning import ffill_sql
from tessera.plans.common import DAILY_SQL, PANEL_EXTRA_SQL, PANEL_SQL, finish, q, r6, sql_cols, sql_round
from tessera.sources import fixtures as fx

SPEC = fx.EVENTS_SPEC
BASE = ("station", "datetime", "hh", "PM2_5", "PM10", "SO2", "NO2", "TEMP", "wd")
BASE_EXTRA = BASE + ("WSPM", "PRES")
STRINGS = {"station", "wd", "season", "time_of_day", "split"}
TIMES = {"datetime"}


# ------------------------------------------------------------------ Spark side

def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: panel -> A2 -> W1/W2 -> W5 lags + W8 rolling -> P4."""
    p = fx.hourly_panel(spark, sf_dir)
    p = clean.remove_duplicates(p, [SPEC.key, SPEC.time], ["hh"])
    p = clean.forward_fill(p, SPEC, list(SPEC.pollutants) + [SPEC.wind])
    p = ft.window_features(p, SPEC, ft.safe_lags(p, SPEC), ft.safe_rolls(p, SPEC))
    return finish(ft.drop_critical_nulls(p, SPEC))


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target lags 1..24, pollutant lags 1,3,6,12,24, meteorology 1,6,24."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    return finish(ft.window_features(p, SPEC, ft.full_lags(p, SPEC)))


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean/std/max/min with min_periods 1 over row frames."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    return finish(ft.window_features(p, SPEC, rolls=ft.full_rolls(p, SPEC)))


def leak_safe_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 with ``leak_safe``: frames of the n rows before the row."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    return finish(ft.window_features(p, SPEC, rolls=ft.full_rolls(p, SPEC), leak_safe=True))


def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: weekday, day of year, weekend, lags 1..6, 24-row rolling, ratios, products."""
    return finish(ft.engineer_basic(fx.hourly_panel(spark, sf_dir, extra=True), SPEC))


def calendar_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3-M5 + M1 on the long daily calendar: cyclic parts, season, weekend,
    holiday, time of day and their dummies."""
    return finish(ft.calendar_features(fx.daily_panel(spark, sf_dir), fx.ORDERS_SPEC, holiday=True))


def date_parts_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: hour, weekday (Mon=0), month, day, day of year."""
    return finish(ft.date_parts(fx.daily_panel(spark, sf_dir), fx.ORDERS_SPEC))


def station_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + A6: station dummies, per-station target mean columns, dense mean."""
    return finish(ft.station_features(fx.hourly_panel(spark, sf_dir), SPEC, means=True))


def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of min-max scaled PM2.5, PM10, NO2, SO2."""
    return finish(ft.composite_index(fx.hourly_panel(spark, sf_dir), SPEC))


def wind_ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + M8 + W10 (optimized set): PM ratio, wind degrees and sin/cos,
    temperature change from the 1-row lag."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    p = ft.window_features(p, SPEC, [ft.Lag("TEMP", 1, "TEMP_lag_1h")])
    return finish(ft.advanced_features(p, SPEC, full=False))


def engineered_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 on the hourly panel: calendar, W4 lags, W7 rolling, interactions,
    station features, advanced features, critical-null filter."""
    return finish(ft.engineer_full(fx.hourly_panel(spark, sf_dir, extra=True), SPEC))


def engineered_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 on the hourly panel."""
    return finish(ft.engineer_optimized(fx.hourly_panel(spark, sf_dir, extra=True), SPEC))


def critical_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 report: nulls per critical column and rows the filter removes."""
    p = fx.hourly_panel(spark, sf_dir, extra=True)
    p = ft.window_features(p, SPEC, ft.safe_lags(p, SPEC))
    return finish(ft.critical_null_report(p, SPEC))


def leak_safe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 without any feature that holds its row's own target."""
    return finish(ft.engineer_full(fx.hourly_panel(spark, sf_dir, extra=True), SPEC, leak_safe=True))


def leak_safe_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 without any feature that holds its row's own target."""
    return finish(ft.engineer_optimized(fx.hourly_panel(spark, sf_dir, extra=True), SPEC, leak_safe=True))


QUERIES = {
    "forecast_features": forecast_features,
    "lag_features": lag_features,
    "rolling_features": rolling_features,
    "leak_safe_rolling": leak_safe_rolling,
    "basic_features": basic_features,
    "calendar_daily": calendar_daily,
    "date_parts_daily": date_parts_daily,
    "station_features": station_features,
    "composite_index": composite_index,
    "wind_ratio_features": wind_ratio_features,
    "engineered_full": engineered_full,
    "engineered_optimized": engineered_optimized,
    "leak_safe_full": leak_safe_full,
    "leak_safe_optimized": leak_safe_optimized,
    "critical_nulls": critical_nulls,
}


# ------------------------------------------------------------------ SQL side

def _frame(n: int, leak_safe: bool = False) -> str:
    if leak_safe:
        return f"(PARTITION BY station ORDER BY datetime ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"(PARTITION BY station ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_FN = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}


def lag_sql(src: str, k: int, name: str) -> str:
    return f"lag({q(src)}, {k}) OVER (PARTITION BY station ORDER BY datetime) AS {q(name)}"


def roll_sql(src: str, n: int, stat: str, minp: int, name: str, leak_safe: bool = False) -> str:
    e = f"{_FN[stat]}({q(src)}) OVER {_frame(n, leak_safe)}"
    if minp > 1:
        e = f"CASE WHEN count({q(src)}) OVER {_frame(n, leak_safe)} >= {minp} THEN {e} END"
    return f"{e} AS {q(name)}"


def safe_window_sql(cols_present, leak_safe: bool = False) -> tuple[list[str], list[str]]:
    """SQL items and output names of W5 + W8 for the present columns."""
    t = C.TARGET
    items, names = [], []
    for k in C.SAFE_TARGET_LAGS:
        items.append(lag_sql(t, k, f"{t}_lag_{k}h"))
        names.append(f"{t}_lag_{k}h")
    for c in [c for c in C.POLLUTANTS if c in cols_present and c != t]:
        for k in C.SAFE_OTHER_LAGS:
            items.append(lag_sql(c, k, f"{c}_lag_{k}h"))
            names.append(f"{c}_lag_{k}h")
    for c in [c for c in C.SAFE_METEO if c in cols_present]:
        for k in C.SAFE_OTHER_LAGS:
            items.append(lag_sql(c, k, f"{c}_lag_{k}h"))
            names.append(f"{c}_lag_{k}h")
    for n in C.SAFE_TARGET_WINDOWS:
        items.append(roll_sql(t, n, "mean", n // 2, f"{t}_rolling_mean_{n}h", leak_safe))
        names.append(f"{t}_rolling_mean_{n}h")
        if n >= 12:
            items.append(roll_sql(t, n, "std", n // 2, f"{t}_rolling_std_{n}h", leak_safe))
            names.append(f"{t}_rolling_std_{n}h")
    for c in [c for c in C.POLLUTANTS if c in cols_present and c != t]:
        items.append(roll_sql(c, 24, "mean", 12, f"{c}_rolling_mean_24h", leak_safe))
        names.append(f"{c}_rolling_mean_24h")
    for c in [c for c in C.SAFE_ROLLING_METEO if c in cols_present]:
        items.append(roll_sql(c, 24, "mean", 12, f"{c}_rolling_mean_24h", leak_safe))
        names.append(f"{c}_rolling_mean_24h")
    return items, names


CRITICAL = " AND ".join(f"{q(c)} IS NOT NULL" for c in
                        [C.TARGET] + [f"{C.TARGET}_lag_{k}h" for k in C.CRITICAL_LAGS])


def out_sql(names, ints=(), strings=(), times=()) -> str:
    parts = []
    for c in names:
        if c in strings or c in times:
            parts.append(q(c))
        elif c in ints:
            parts.append(f"{q(c)}::BIGINT AS {q(c)}")
        else:
            parts.append(f"{r6(q(c))} AS {q(c)}")
    return ", ".join(parts)


TWO_PI = f"{2 * math.pi!r}::DOUBLE"
BASE_EXTRA_SET = set(BASE_EXTRA)
METEO_EXTRA = [c for c in C.METEOROLOGY if c in BASE_EXTRA_SET]
POLL = [c for c in C.POLLUTANTS if c in BASE_EXTRA_SET]


def full_lag_sql(present) -> tuple[list[str], list[str]]:
    t = C.TARGET
    items, names = [], []
    for k in C.FULL_TARGET_LAGS:
        items.append(lag_sql(t, k, f"{t}_lag_{k}h"))
        names.append(f"{t}_lag_{k}h")
    for c in [c for c in C.POLLUTANTS if c in present and c != t]:
        for k in C.FULL_POLLUTANT_LAGS:
            items.append(lag_sql(c, k, f"{c}_lag_{k}h"))
            names.append(f"{c}_lag_{k}h")
    for c in [c for c in C.METEOROLOGY if c in present]:
        for k in C.FULL_METEO_LAGS:
            items.append(lag_sql(c, k, f"{c}_lag_{k}h"))
            names.append(f"{c}_lag_{k}h")
    return items, names


def full_roll_sql(present, leak_safe: bool = False) -> tuple[list[str], list[str]]:
    t = C.TARGET
    got: dict[str, str] = {}
    for n in C.FULL_TARGET_WINDOWS:
        for st in ("mean", "std", "max", "min"):
            got[f"{t}_rolling_{st}_{n}h"] = roll_sql(t, n, st, 1, f"{t}_rolling_{st}_{n}h", leak_safe)
    for c in [c for c in C.POLLUTANTS if c in present]:
        for n in C.FULL_POLLUTANT_WINDOWS:
            for st in ("mean", "std"):
                got[f"{c}_rolling_{st}_{n}h"] = roll_sql(c, n, st, 1, f"{c}_rolling_{st}_{n}h", leak_safe)
    for c in [c for c in C.METEOROLOGY if c in present]:
        for n in C.FULL_METEO_WINDOWS:
            got[f"{c}_rolling_mean_{n}h"] = roll_sql(c, n, "mean", 1, f"{c}_rolling_mean_{n}h", leak_safe)
            if c in C.STD_METEO:
                got[f"{c}_rolling_std_{n}h"] = roll_sql(c, n, "std", 1, f"{c}_rolling_std_{n}h", leak_safe)
    return list(got.values()), list(got)


SEASON_CASE = ("CASE WHEN month(datetime) IN (12, 1, 2) THEN 'winter' WHEN month(datetime) IN (3, 4, 5) THEN 'spring' "
               "WHEN month(datetime) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END")
TOD_CASE = ("CASE WHEN hour(datetime) <= 6 THEN 'night' WHEN hour(datetime) <= 12 THEN 'morning' "
            "WHEN hour(datetime) <= 18 THEN 'afternoon' ELSE 'evening' END")
SEASONS = ("autumn", "spring", "summer", "winter")
TODS = ("night", "morning", "afternoon", "evening")


def calendar_sql(src: str, holiday: bool = True) -> tuple[str, list[str]]:
    cyc = []
    for name, e, period in (("hour", "hour(datetime)", 24), ("dow", "(isodow(datetime) - 1)", 7),
                            ("month", "month(datetime)", 12)):
        cyc.append(f"sin({TWO_PI} * {e} / {period}.0::DOUBLE) AS {name}_sin")
        cyc.append(f"cos({TWO_PI} * {e} / {period}.0::DOUBLE) AS {name}_cos")
    hol = ""
    if holiday:
        fixed = " OR ".join(f"(month(datetime) = {m} AND day(datetime) = {d})" for m, d in C.HOLIDAYS)
        hol = f", (isodow(datetime) - 1 IN (5, 6) OR {fixed})::INT AS is_holiday"
    dummies = ", ".join([f"(season = '{x}')::INT AS season_{x}" for x in SEASONS]
                        + [f"(time_of_day = '{x}')::INT AS time_{x}" for x in TODS])
    inner = (f"SELECT *, {', '.join(cyc)}, isodow(datetime) - 1 AS day_of_week, month(datetime) AS month, "
             f"{SEASON_CASE} AS season, (isodow(datetime) - 1 IN (5, 6))::INT AS is_weekend{hol}, "
             f"{TOD_CASE} AS time_of_day FROM ({src})")
    names = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "day_of_week", "month",
             "season", "is_weekend"] + (["is_holiday"] if holiday else []) + ["time_of_day"] + \
            [f"season_{x}" for x in SEASONS] + [f"time_{x}" for x in TODS]
    return f"SELECT *, {dummies} FROM ({inner})", names


CAL_INTS = {"day_of_week", "month", "is_weekend", "is_holiday", *[f"season_{x}" for x in SEASONS],
            *[f"time_{x}" for x in TODS]}
STATIONS = ("click", "error", "purchase", "signup", "view")


def station_sql(src: str, means: bool = True) -> tuple[str, list[str]]:
    items = [f"(station = '{x}')::INT AS station_{x}" for x in STATIONS]
    names = [f"station_{x}" for x in STATIONS]
    if means:
        items.append("avg(PM2_5) OVER (PARTITION BY station) AS station_mean")
        names.append("station_mean")
        items += [f"CASE WHEN station = '{x}' THEN avg(PM2_5) OVER (PARTITION BY station) END AS {q(x + '_mean_PM2_5')}"
                  for x in STATIONS]
        names += [f"{x}_mean_PM2_5" for x in STATIONS]
    return f"SELECT *, {', '.join(items)} FROM ({src})", names


COMPASS_CASE = "CASE wd " + " ".join(f"WHEN '{p}' THEN {i * C.COMPASS_STEP_DEGREES}::DOUBLE"
                                     for i, p in enumerate(C.COMPASS_POINTS)) + " END"


def composite_sql(src: str, leak_safe: bool = False) -> str:
    of = [c for c in C.COMPOSITE_POLLUTANTS if not (leak_safe and c == C.TARGET)]
    parts = [f"(({q(c)} - min({q(c)}) OVER ()) / (max({q(c)}) OVER () - min({q(c)}) OVER () + 1e-8))" for c in of]
    return f"SELECT *, ({' + '.join(parts)}) / {float(len(parts))}::DOUBLE AS composite_aqi FROM ({src})"


def wind_items() -> tuple[list[str], list[str]]:
    return ([f"{COMPASS_CASE} AS wind_direction_numeric", f"sin(radians({COMPASS_CASE})) AS wind_dir_sin",
             f"cos(radians({COMPASS_CASE})) AS wind_dir_cos"],
            ["wind_direction_numeric", "wind_dir_sin", "wind_dir_cos"])


def full_sql(src: str, leak_safe: bool = False) -> tuple[str, list[str]]:
    cal, cal_names = calendar_sql(src, holiday=True)
    li, ln = full_lag_sql(BASE_EXTRA_SET)
    ri, rn = full_roll_sql(BASE_EXTRA_SET, leak_safe)
    known = lambda c: f"{c}_lag_1h" if leak_safe and c == C.TARGET else c
    win = f"SELECT *, {', '.join(li + ri)} FROM ({cal})"
    inter = [f"{q(known(c))} * WSPM AS {q(c + '_wind_interaction')}" for c in POLL]
    inter += ["PRES * TEMP AS pres_temp_interaction", "PM2_5_lag_1h * TEMP AS PM2_5_temp_lag_interaction"]
    inter += [f"season_{x} * TEMP AS season_{x}_temp_interaction" for x in SEASONS]
    inter_names = [f"{c}_wind_interaction" for c in POLL] + ["pres_temp_interaction", "PM2_5_temp_lag_interaction"] \
        + [f"season_{x}_temp_interaction" for x in SEASONS]
    st, st_names = station_sql(f"SELECT *, {', '.join(inter)} FROM ({win})", means=not leak_safe)
    wi, wn = wind_items()
    now, was = ("PM2_5_lag_1h", "PM2_5_lag_2h") if leak_safe else ("PM2_5", "PM2_5_lag_1h")
    adv = [f"({now} - {was}) / ({was} + 1e-8) AS PM2_5_change_rate",
           f"{known('PM2_5')} / (PM10 + 1e-8) AS pm25_pm10_ratio", "TEMP - TEMP_lag_1h AS temp_change_rate",
           "PRES - PRES_lag_6h AS pres_trend"] + wi
    adv_names = ["PM2_5_change_rate", "pm25_pm10_ratio", "temp_change_rate", "pres_trend"] + wn + ["composite_aqi"]
    body = composite_sql(f"SELECT *, {', '.join(adv)} FROM ({st})", leak_safe)
    names = list(BASE_EXTRA) + cal_names + ln + rn + inter_names + st_names + adv_names
    return f"SELECT * FROM ({body}) WHERE {CRITICAL}", names


def optimized_sql(src: str, leak_safe: bool = False) -> tuple[str, list[str]]:
    cal, cal_names = calendar_sql(src, holiday=False)
    li, ln = safe_window_sql(BASE_EXTRA_SET, leak_safe)
    target = "PM2_5_lag_1h" if leak_safe else "PM2_5"
    win = f"SELECT *, {', '.join(li)} FROM ({cal})"
    inter = [f"{target} * WSPM AS PM2_5_wind_interaction", "PRES * TEMP AS pres_temp_interaction"]
    st, st_names = station_sql(f"SELECT *, {', '.join(inter)} FROM ({win})", means=False)
    wi, wn = wind_items()
    adv = [f"{target} / (PM10 + 1e-8) AS pm25_pm10_ratio", "TEMP - TEMP_lag_1h AS temp_change_rate"] + wi
    body = f"SELECT *, {', '.join(adv)} FROM ({st})"
    names = (list(BASE_EXTRA) + cal_names + ln + ["PM2_5_wind_interaction", "pres_temp_interaction"] + st_names
             + ["pm25_pm10_ratio", "temp_change_rate"] + wn)
    return f"SELECT * FROM ({body}) WHERE {CRITICAL}", names


def basic_sql(src: str) -> tuple[str, list[str]]:
    items, names = [], []
    for k in C.BASIC_LAGS:
        for c in C.BASIC_LAG_COLUMNS:
            items.append(lag_sql(c, k, f"{c}_lag_{k}"))
            names.append(f"{c}_lag_{k}")
    for c, st in (("PM2_5", "mean"), ("PM2_5", "std"), ("TEMP", "mean"), ("PRES", "mean")):
        items.append(roll_sql(c, 24, st, 1, f"{c}_rolling_{st}_24"))
        names.append(f"{c}_rolling_{st}_24")
    items += ["PM2_5 / (PM10 + 1e-6) AS PM_ratio", "NO2 / (SO2 + 1e-6) AS NO2_SO2_ratio",
              "TEMP * PRES AS TEMP_x_PRES", "WSPM * TEMP AS WIND_x_TEMP"]
    names += ["PM_ratio", "NO2_SO2_ratio", "TEMP_x_PRES", "WIND_x_TEMP"]
    sql = (f"SELECT *, isodow(datetime) - 1 AS day_of_week, dayofyear(datetime) AS day_of_year, "
           f"(isodow(datetime) - 1 >= 5)::INT AS is_weekend, {', '.join(items)} FROM ({src})")
    return sql, list(BASE_EXTRA) + ["day_of_week", "day_of_year", "is_weekend"] + names


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    ints = {"hh"} | CAL_INTS | {f"station_{x}" for x in STATIONS} | {"day_of_year", "day", "hour"}

    def out(sql, names):
        return f"SELECT {out_sql(names, ints=ints, strings=STRINGS, times=TIMES)} FROM ({sql})"

    li, ln = full_lag_sql(BASE_EXTRA_SET)
    s["lag_features"] = out(f"SELECT *, {', '.join(li)} FROM ({PANEL_EXTRA_SQL})", list(BASE_EXTRA) + ln)
    ri, rn = full_roll_sql(BASE_EXTRA_SET)
    s["rolling_features"] = out(f"SELECT *, {', '.join(ri)} FROM ({PANEL_EXTRA_SQL})", list(BASE_EXTRA) + rn)
    ri, rn = full_roll_sql(BASE_EXTRA_SET, leak_safe=True)
    s["leak_safe_rolling"] = out(f"SELECT *, {', '.join(ri)} FROM ({PANEL_EXTRA_SQL})", list(BASE_EXTRA) + rn)
    s["basic_features"] = out(*basic_sql(PANEL_EXTRA_SQL))
    cal, cal_names = calendar_sql(DAILY_SQL, holiday=True)
    s["calendar_daily"] = out(cal, ["station", "datetime", "PM2_5", "PM10"] + cal_names)
    s["date_parts_daily"] = out(
        f"SELECT *, hour(datetime) AS hour, isodow(datetime) - 1 AS day_of_week, month(datetime) AS month, "
        f"day(datetime) AS day, dayofyear(datetime) AS day_of_year FROM ({DAILY_SQL})",
        ["station", "datetime", "PM2_5", "PM10", "hour", "day_of_week", "month", "day", "day_of_year"])
    st, st_names = station_sql(PANEL_SQL)
    s["station_features"] = out(st, list(BASE) + st_names)
    s["composite_index"] = out(composite_sql(PANEL_SQL), list(BASE) + ["composite_aqi"])
    wi, wn = wind_items()
    s["wind_ratio_features"] = out(
        f"SELECT *, lag(TEMP, 1) OVER (PARTITION BY station ORDER BY datetime) AS TEMP_lag_1h FROM ({PANEL_EXTRA_SQL})",
        [])  # placeholder replaced below
    lagged = f"SELECT *, lag(TEMP, 1) OVER (PARTITION BY station ORDER BY datetime) AS TEMP_lag_1h FROM ({PANEL_EXTRA_SQL})"
    s["wind_ratio_features"] = out(
        f"SELECT *, PM2_5 / (PM10 + 1e-8) AS pm25_pm10_ratio, TEMP - TEMP_lag_1h AS temp_change_rate, "
        f"{', '.join(wi)} FROM ({lagged})",
        list(BASE_EXTRA) + ["TEMP_lag_1h", "pm25_pm10_ratio", "temp_change_rate"] + wn)
    s["engineered_full"] = out(*full_sql(PANEL_EXTRA_SQL))
    s["engineered_optimized"] = out(*optimized_sql(PANEL_EXTRA_SQL))
    s["leak_safe_full"] = out(*full_sql(PANEL_EXTRA_SQL, leak_safe=True))
    s["leak_safe_optimized"] = out(*optimized_sql(PANEL_EXTRA_SQL, leak_safe=True))
    li, ln = safe_window_sql(BASE_EXTRA_SET)
    crit = [C.TARGET] + [f"{C.TARGET}_lag_{k}h" for k in C.CRITICAL_LAGS]
    anyn = " OR ".join(f"{q(c)} IS NULL" for c in crit)
    null_counts = ", ".join(f"count(*) FILTER (WHERE {q(c)} IS NULL)::BIGINT AS {q('nulls_' + c)}" for c in crit)
    s["critical_nulls"] = (
        f"SELECT {null_counts}, "
        f"count(*) FILTER (WHERE {anyn})::BIGINT AS rows_removed, count(*)::BIGINT AS rows_before "
        f"FROM (SELECT *, {', '.join(li)} FROM ({PANEL_EXTRA_SQL}))")
    items, names = safe_window_sql(set(BASE))
    inner = f"SELECT *, {', '.join(items)} FROM ({ffill_sql(PANEL_SQL)})"
    allc = list(BASE) + names
    s["forecast_features"] = (f"SELECT {out_sql(allc, ints={'hh'}, strings=STRINGS, times=TIMES)} "
                              f"FROM ({inner}) WHERE {CRITICAL}")
    return s


SQL = _sql()
