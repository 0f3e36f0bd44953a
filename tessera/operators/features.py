"""Feature operators (W4-W10, M1-M8, A6, A8, P4) and the three feature
pipelines C2 (full), C3 (optimized) and C4 (basic).

All row-ordered window columns of one pipeline are evaluated in a single
chunked window pass (one shuffle, one sort), see :mod:`tessera.operators.sequence`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config as C
from tessera.config import PanelSpec
from tessera.functions import calendar as cal
from tessera.functions.encode import one_hot, safe_ratio, wind_components
from tessera.operators.sequence import chunked_window, drop_position, time_chunked_window


@dataclass(frozen=True)
class Lag:
    src: str
    k: int
    name: str


@dataclass(frozen=True)
class Roll:
    src: str
    n: int
    stat: str          # mean | std | max | min
    min_periods: int
    name: str


_STATS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}


def levels(df: DataFrame, col: str) -> list[str]:
    """Distinct values of a column, in order: the names of its one-hot columns.
    The frame made from them has one column each, so this list is schema, as
    long as the caller's output is wide. Columns of many values are label codes
    (M2) instead."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


def key_levels(df: DataFrame, spec: PanelSpec) -> list[str]:
    return list(spec.key_levels) if spec.key_levels is not None else levels(df, spec.key)


def with_levels(df: DataFrame, spec: PanelSpec) -> PanelSpec:
    """Fix the key levels from the input panel (before any window work), so
    later one-hot columns do not re-run the feature plan to find them."""
    if spec.key_levels is not None or spec.key not in df.columns:
        return spec
    return spec.replace(key_levels=tuple(levels(df, spec.key)))


# ---------------------------------------------------------------- M3-M5, M1

def calendar_features(df: DataFrame, spec: PanelSpec, holiday: bool = True) -> DataFrame:
    """Temporal block of C2/C3: cyclic hour/weekday/month, season and its
    dummies, weekend, holiday (C2 only), time of day and its dummies."""
    t = F.col(spec.time)
    h = cal.hour(t)
    dow = cal.day_of_week(t)
    month = F.month(t)
    hs, hc = cal.cyclic(h, 24)
    ds, dc = cal.cyclic(dow, 7)
    ms, mc = cal.cyclic(month, 12)
    first = {"hour_sin": hs, "hour_cos": hc, "day_of_week": dow, "dow_sin": ds, "dow_cos": dc,
             "month": month, "month_sin": ms, "month_cos": mc, "season": cal.season(month)}
    d = df.withColumns(first)
    second = one_hot(F.col("season"), cal.season_levels(), "season")
    second["is_weekend"] = cal.is_weekend(F.col("day_of_week"))
    d = d.withColumns(second)
    third = {}
    if holiday:
        third["is_holiday"] = cal.is_holiday(t, F.col("is_weekend"))
    third["time_of_day"] = cal.time_of_day(h)
    d = d.withColumns(third)
    return d.withColumns(one_hot(F.col("time_of_day"), cal.time_of_day_levels(), "time"))


def date_parts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """M3 date parts: hour, day_of_week (Mon=0), month, day, day_of_year."""
    t = F.col(spec.time)
    return df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t),
                           "day": F.dayofmonth(t), "day_of_year": F.dayofyear(t)})


# ---------------------------------------------------------------- W4-W9

def window_features(df: DataFrame, spec: PanelSpec, lags: Sequence[Lag] = (), rolls: Sequence[Roll] = (),
                    leak_safe: bool = False, by: str = "rows") -> DataFrame:
    """Lags and rolling statistics per key in one window pass. by="rows": by
    row order, k rows back. by="hours": by time, so a gap in the panel counts:
    a lag is the value k hours before (the greatest of several, null if that time
    is absent), a rolling frame holds the rows of the last n hours. ``leak_safe``
    moves every rolling frame to *before* the row (by hours: to before its time),
    so no window contains the same-row value."""
    lags, rolls = list(lags), list(rolls)
    if not lags and not rolls:
        return df
    if by == "hours":
        return _window_features_by_hours(df, spec, lags, rolls, leak_safe)
    if by != "rows":
        raise ValueError("by must be 'rows' or 'hours'")
    halo = max([lg.k for lg in lags] + [r.n if leak_safe else r.n - 1 for r in rolls] + [0])

    def compute(w):
        out: dict[str, Column] = {}
        for lg in lags:
            out[lg.name] = F.lag(lg.src, lg.k).over(w)
        for r in rolls:
            frame = w.rowsBetween(-r.n, -1) if leak_safe else w.rowsBetween(-(r.n - 1), 0)
            stat = _STATS[r.stat](r.src).over(frame)
            if r.min_periods > 1:
                stat = F.when(F.count(r.src).over(frame) >= r.min_periods, stat)
            out[r.name] = stat
        return out

    return drop_position(chunked_window(df, spec, halo, compute))


def _window_features_by_hours(df: DataFrame, spec: PanelSpec, lags: list[Lag], rolls: list[Roll], leak_safe: bool) -> DataFrame:
    hour = 3600
    halo = max([lg.k for lg in lags] + [r.n for r in rolls])

    def compute(w):
        out: dict[str, Column] = {}
        for lg in lags:
            # The greatest value among several rows of that hour: no order among them is given.
            out[lg.name] = F.max(lg.src).over(w.rangeBetween(-lg.k * hour, -lg.k * hour))
        for r in rolls:
            # The last n hours: after t - n h, up to t (leak-safe: from t - n h, before t).
            frame = w.rangeBetween(-r.n * hour, -1) if leak_safe else w.rangeBetween(-r.n * hour + 1, 0)
            stat = _STATS[r.stat](r.src).over(frame)
            if r.min_periods > 1:
                stat = F.when(F.count(r.src).over(frame) >= r.min_periods, stat)
            out[r.name] = stat
        return out

    return time_chunked_window(df, spec, halo, compute)


def full_lags(df: DataFrame, spec: PanelSpec) -> list[Lag]:
    """Target 1..24, other pollutants 1,3,6,12,24, meteorology 1,6,24."""
    t = spec.target
    out = [Lag(t, k, f"{t}_lag_{k}h") for k in C.FULL_TARGET_LAGS] if t in df.columns else []
    for c in spec.present(df, spec.pollutants):
        if c != t:
            out += [Lag(c, k, f"{c}_lag_{k}h") for k in C.FULL_POLLUTANT_LAGS]
    for c in spec.present(df, spec.meteorology):
        out += [Lag(c, k, f"{c}_lag_{k}h") for k in C.FULL_METEO_LAGS]
    return out


def safe_lags(df: DataFrame, spec: PanelSpec) -> list[Lag]:
    """Target 1,6,12,24; other pollutants 1,6; TEMP, PRES, WSPM 1,6."""
    t = spec.target
    out = [Lag(t, k, f"{t}_lag_{k}h") for k in C.SAFE_TARGET_LAGS if k <= C.MAX_LAG_HOURS]
    for c in spec.present(df, spec.pollutants):
        if c != t:
            out += [Lag(c, k, f"{c}_lag_{k}h") for k in C.SAFE_OTHER_LAGS]
    for c in spec.present(df, C.SAFE_METEO):
        out += [Lag(c, k, f"{c}_lag_{k}h") for k in C.SAFE_OTHER_LAGS]
    return out


def basic_lags(df: DataFrame, spec: PanelSpec) -> list[Lag]:
    """PM2.5, TEMP, PRES lags 1..6 named ``X_lag_k``."""
    return [Lag(c, k, f"{c}_lag_{k}") for k in C.BASIC_LAGS for c in spec.present(df, C.BASIC_LAG_COLUMNS)]


def full_rolls(df: DataFrame, spec: PanelSpec) -> list[Roll]:
    """W7 (min_periods 1): target mean/std/max/min over 6,12,24,48; pollutants
    mean/std over 12,24; meteorology mean over 6,24 and std for TEMP, PRES, WSPM."""
    t = spec.target
    out: dict[str, Roll] = {}
    if t in df.columns:
        for n in C.FULL_TARGET_WINDOWS:
            for s in ("mean", "std", "max", "min"):
                out[f"{t}_rolling_{s}_{n}h"] = Roll(t, n, s, 1, f"{t}_rolling_{s}_{n}h")
    for c in spec.present(df, spec.pollutants):
        for n in C.FULL_POLLUTANT_WINDOWS:
            for s in ("mean", "std"):
                out[f"{c}_rolling_{s}_{n}h"] = Roll(c, n, s, 1, f"{c}_rolling_{s}_{n}h")
    for c in spec.present(df, spec.meteorology):
        for n in C.FULL_METEO_WINDOWS:
            out[f"{c}_rolling_mean_{n}h"] = Roll(c, n, "mean", 1, f"{c}_rolling_mean_{n}h")
            if c in C.STD_METEO:
                out[f"{c}_rolling_std_{n}h"] = Roll(c, n, "std", 1, f"{c}_rolling_std_{n}h")
    return list(out.values())


def safe_rolls(df: DataFrame, spec: PanelSpec) -> list[Roll]:
    """Target mean 6,12,24 and std 12,24 with min_periods n//2; other
    pollutants, TEMP, PRES mean over 24 with min_periods 12."""
    t = spec.target
    out = []
    if t in df.columns:
        for n in C.SAFE_TARGET_WINDOWS:
            out.append(Roll(t, n, "mean", n // 2, f"{t}_rolling_mean_{n}h"))
            if n >= 12:
                out.append(Roll(t, n, "std", n // 2, f"{t}_rolling_std_{n}h"))
    for c in spec.present(df, spec.pollutants):
        if c != t:
            out.append(Roll(c, 24, "mean", 12, f"{c}_rolling_mean_24h"))
    for c in spec.present(df, C.SAFE_ROLLING_METEO):
        out.append(Roll(c, 24, "mean", 12, f"{c}_rolling_mean_24h"))
    return out


def basic_rolls(df: DataFrame, spec: PanelSpec) -> list[Roll]:
    """PM2.5 mean/std, TEMP mean, PRES mean over 24 rows, min_periods 1."""
    out = []
    for c, s in (("PM2_5", "mean"), ("PM2_5", "std"), ("TEMP", "mean"), ("PRES", "mean")):
        if c in df.columns:
            out.append(Roll(c, 24, s, 1, f"{c}_rolling_{s}_24"))
    return out


# ---------------------------------------------------------------- M7

def full_interactions(df: DataFrame, spec: PanelSpec, leak_safe: bool = False) -> DataFrame:
    cols = set(df.columns)
    new = {}
    if {"TEMP", "DEWP"} <= cols:
        new["temp_dewp_interaction"] = F.col("TEMP") * F.col("DEWP")
    if "WSPM" in cols:
        for c in spec.present(df, spec.pollutants):
            new[f"{c}_wind_interaction"] = known(df, spec, c, leak_safe) * F.col("WSPM")
    if {"PRES", "TEMP"} <= cols:
        new["pres_temp_interaction"] = F.col("PRES") * F.col("TEMP")
    lag1 = f"{spec.target}_lag_1h"
    if lag1 in cols and "TEMP" in cols:
        new[f"{spec.target}_temp_lag_interaction"] = F.col(lag1) * F.col("TEMP")
    if "TEMP" in cols:
        for s in [c for c in df.columns if c.startswith("season_")]:
            new[f"{s}_temp_interaction"] = F.col(s).cast("int") * F.col("TEMP")
    return df.withColumns(new) if new else df


def known(df: DataFrame, spec: PanelSpec, col: str, leak_safe: bool) -> Column:
    """A value that a forecast of the row may use: with ``leak_safe`` the
    target's is the previous row's."""
    return F.col(f"{col}_lag_1h") if leak_safe and col == spec.target else F.col(col)


def safe_interactions(df: DataFrame, spec: PanelSpec, leak_safe: bool = False) -> DataFrame:
    cols = set(df.columns)
    new = {}
    if {"TEMP", "DEWP"} <= cols:
        new["temp_dewp_interaction"] = F.col("TEMP") * F.col("DEWP")
    if "WSPM" in cols and spec.target in cols:
        new[f"{spec.target}_wind_interaction"] = known(df, spec, spec.target, leak_safe) * F.col("WSPM")
    if {"PRES", "TEMP"} <= cols:
        new["pres_temp_interaction"] = F.col("PRES") * F.col("TEMP")
    return df.withColumns(new) if new else df


# ---------------------------------------------------------------- M1 + A6

def key_stats(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row a key: ``station_mean`` of the target, and ``{column}__lo, __hi`` of
    the composite's columns. Means by key and global bounds both come from it, so
    the panel is aggregated once."""
    parts = spec.present(df, C.COMPOSITE_POLLUTANTS)
    aggs = [f(c).alias(f"{c}__{n}") for c in parts for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(spec.key).agg((F.avg(spec.target) if spec.target in df.columns else F.lit(None).cast("double")).alias("station_mean"), *aggs)


def station_features(df: DataFrame, spec: PanelSpec, means: bool = True, stats: DataFrame | None = None) -> DataFrame:
    """Key dummies ``{key}_{level}`` and (C2) per-level target mean
    ``{level}_mean_{target}`` on that level's rows, NULL elsewhere, plus a
    dense ``station_mean``.  The means are one grouped aggregate (``stats``, see
    :func:`key_stats`) joined back; the planner broadcasts it if it is small."""
    lv = key_levels(df, spec)
    d = df.withColumns(one_hot(F.col(spec.key), lv, spec.key))
    if not means or spec.target not in df.columns:
        return d
    m = (stats if stats is not None else key_stats(df, spec)).select(spec.key, "station_mean")
    d = d.join(m, spec.key, "left")
    return d.withColumns({f"{x}_mean_{spec.target}": F.when(F.col(spec.key) == F.lit(x), F.col("station_mean"))
                          for x in lv})


# ---------------------------------------------------------------- W10, M6, M8, A8

def composite_index(df: DataFrame, spec: PanelSpec, stats: DataFrame | None = None, leak_safe: bool = False) -> DataFrame:
    """Mean of min-max scaled PM2.5, PM10, NO2, SO2 (those present, at
    least two); NULL if any part is NULL.  Min and max are one global
    aggregate row (over ``stats``, see :func:`key_stats`), broadcast onto the
    panel. ``leak_safe`` leaves the target out."""
    parts = [c for c in spec.present(df, C.COMPOSITE_POLLUTANTS) if not (leak_safe and c == spec.target)]
    if len(parts) < 2:
        return df
    if stats is None:
        stats = key_stats(df if spec.key in df.columns else df.withColumn(spec.key, F.lit("all")), spec)
    mm = stats.agg(*[F.min(f"{c}__lo").alias(f"_{c}_min") for c in parts], *[F.max(f"{c}__hi").alias(f"_{c}_max") for c in parts])
    d = df.crossJoin(F.broadcast(mm))
    scaled = [(F.col(c) - F.col(f"_{c}_min")) / (F.col(f"_{c}_max") - F.col(f"_{c}_min") + F.lit(C.MINMAX_EPS))
              for c in parts]
    total = scaled[0]
    for s in scaled[1:]:
        total = total + s
    d = d.withColumn("composite_aqi", total / F.lit(float(len(parts))))
    return d.drop(*[f"_{c}_min" for c in parts], *[f"_{c}_max" for c in parts])


def advanced_features(df: DataFrame, spec: PanelSpec, full: bool = True, stats: DataFrame | None = None,
                      leak_safe: bool = False) -> DataFrame:
    """C2 / C3 advanced block: change rate (C2), PM ratio, temperature change,
    pressure trend (C2), wind direction numeric/sin/cos, composite index (C2).
    ``leak_safe``: the change rate is the previous row's, the ratio takes the
    target from there, the composite leaves it out."""
    cols = set(df.columns)
    t, lag1 = spec.target, f"{spec.target}_lag_1h"
    new = {}
    if full and lag1 in cols:
        now, was = (F.col(lag1), F.col(f"{t}_lag_2h")) if leak_safe else (F.col(t), F.col(lag1))
        new[f"{t}_change_rate"] = safe_ratio(now - was, was, C.RATIO_EPS)
    if {"PM2_5", "PM10"} <= cols:
        new["pm25_pm10_ratio"] = safe_ratio(known(df, spec, "PM2_5", leak_safe), known(df, spec, "PM10", leak_safe), C.RATIO_EPS)
    if "TEMP_lag_1h" in cols:
        new["temp_change_rate"] = F.col("TEMP") - F.col("TEMP_lag_1h")
    if full and "PRES_lag_6h" in cols:
        new["pres_trend"] = F.col("PRES") - F.col("PRES_lag_6h")
    if spec.wind in cols:
        from tessera.functions.encode import compass_degrees
        new["wind_direction_numeric"] = compass_degrees(F.col(spec.wind))
        new.update(wind_components(F.col(spec.wind)))
    d = df.withColumns(new) if new else df
    return composite_index(d, spec, stats, leak_safe) if full else d


# ---------------------------------------------------------------- P4

def critical_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    names = [spec.target] + [f"{spec.target}_lag_{k}h" for k in C.CRITICAL_LAGS]
    return spec.present(df, names)


def drop_critical_nulls(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Drop rows with a NULL target or NULL target lag 1/6/12/24 h."""
    crit = critical_columns(df, spec)
    return df.dropna(subset=crit) if crit else df


def critical_null_report(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Null count per critical column and rows the P4 filter removes, one scan."""
    crit = critical_columns(df, spec)
    anynull = F.lit(False)
    for c in crit:
        anynull = anynull | F.col(c).isNull()
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(f"nulls_{c}") for c in crit],
                  F.count_if(anynull).cast("long").alias("rows_removed"),
                  F.count(F.lit(1)).cast("long").alias("rows_before"))


# ---------------------------------------------------------------- C2, C3, C4

def engineer_full(df: DataFrame, spec: PanelSpec, station: bool = True, leak_safe: bool = False) -> DataFrame:
    """Calendar -> lags (W4) -> rolling (W7) -> interactions -> station
    features -> advanced -> P4."""
    spec = with_levels(df, spec) if station else spec
    d = calendar_features(df, spec, holiday=True)
    d = window_features(d, spec, full_lags(d, spec), full_rolls(d, spec), leak_safe=leak_safe)
    d = full_interactions(d, spec, leak_safe)
    # Station means and min/max read raw columns of the same rows: take them
    # from the input, not from the windowed frame.
    stats = key_stats(df, spec) if spec.key in df.columns else None
    if station and spec.key in d.columns:
        # A level's mean holds the row's own target: not with leak_safe.
        d = station_features(d, spec, means=not leak_safe, stats=stats)
    d = advanced_features(d, spec, full=True, stats=stats, leak_safe=leak_safe)
    return drop_critical_nulls(d, spec)


def engineer_optimized(df: DataFrame, spec: PanelSpec, station: bool = True, leak_safe: bool = False) -> DataFrame:
    """Calendar (no holiday) -> lags (W5) -> rolling (W8) -> interactions
    -> station dummies -> advanced (ratio, temperature change, wind) -> P4."""
    spec = with_levels(df, spec) if station else spec
    d = calendar_features(df, spec, holiday=False)
    d = window_features(d, spec, safe_lags(d, spec), safe_rolls(d, spec), leak_safe=leak_safe)
    d = safe_interactions(d, spec, leak_safe)
    if station and spec.key in d.columns:
        d = station_features(d, spec, means=False)
    d = advanced_features(d, spec, full=False, leak_safe=leak_safe)
    return drop_critical_nulls(d, spec)


def engineer_basic(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """C4: weekday, day of year, weekend -> lags 1..6 (W6) -> 24-row rolling
    (W9) -> ratios (M6) -> products (M7).  No rows are dropped."""
    t = F.col(spec.time)
    d = df.withColumns({"day_of_week": F.weekday(t), "day_of_year": F.dayofyear(t)})
    d = d.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    d = window_features(d, spec, basic_lags(d, spec), basic_rolls(d, spec))
    cols = set(d.columns)
    new = {}
    if {"PM2_5", "PM10"} <= cols:
        new["PM_ratio"] = safe_ratio(F.col("PM2_5"), F.col("PM10"), C.BASIC_RATIO_EPS)
    if {"NO2", "SO2"} <= cols:
        new["NO2_SO2_ratio"] = safe_ratio(F.col("NO2"), F.col("SO2"), C.BASIC_RATIO_EPS)
    if {"TEMP", "PRES"} <= cols:
        new["TEMP_x_PRES"] = F.col("TEMP") * F.col("PRES")
    if {"WSPM", "TEMP"} <= cols:
        new["WIND_x_TEMP"] = F.col("WSPM") * F.col("TEMP")
    return d.withColumns(new) if new else d
