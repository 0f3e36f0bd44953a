"""Panel description: column roles, limits, split dates, level lists.

Operators never hard-code column names; they read them from a ``PanelSpec``
so the same code runs on the 12-station air-quality panel and on the panels
derived from the test tables.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Fixed values.  These must equal the studied project's values for equal
# results; they are stated here plainly and in their natural order.
# --------------------------------------------------------------------------

# Target and column roles (the raw header "PM2.5" is renamed to PM2_5 on ingest).
TARGET = "PM2_5"
POLLUTANTS = ("PM2_5", "PM10", "SO2", "NO2", "CO", "O3")
METEOROLOGY = ("TEMP", "PRES", "DEWP", "RAIN", "WSPM")
WIND_DIRECTION = "wd"
DATE_PARTS = ("year", "month", "day", "hour")

# Physical limits (lower, upper) per measurement.
PHYSICAL_LIMITS = {
    "PM2_5": (0.0, 500.0),
    "PM10": (0.0, 1000.0),
    "SO2": (0.0, 1000.0),
    "NO2": (0.0, 1000.0),
    "CO": (0.0, 100.0),
    "O3": (0.0, 1000.0),
    "TEMP": (-50.0, 60.0),
    "PRES": (900.0, 1100.0),
    "DEWP": (-50.0, 40.0),
    "RAIN": (0.0, 200.0),
    "WSPM": (0.0, 50.0),
}

IQR_MULTIPLIER = 1.5          # rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR are counted
IQR_EXTREME_MULTIPLIER = 3.0  # values beyond Q1 - 3 IQR .. Q3 + 3 IQR are capped
MISSING_DATA_THRESHOLD = 0.1  # a row may have at most 10 % null columns
FORWARD_FILL_LIMIT = 6        # at most 6 rows are forward filled
MAX_LAG_HOURS = 24

# Temporal split (inclusive bounds compared as midnight timestamps).
TRAIN_END = "2015-12-31"
VAL_START = "2016-01-01"
VAL_END = "2016-12-31"
TEST_START = "2017-01-01"

# 16-point compass, clockwise from north, 22.5 degrees apart.
COMPASS_POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
                  "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_STEP_DEGREES = 22.5

# Month -> season.
SEASONS = {12: "winter", 1: "winter", 2: "winter",
           3: "spring", 4: "spring", 5: "spring",
           6: "summer", 7: "summer", 8: "summer",
           9: "autumn", 10: "autumn", 11: "autumn"}
SEASON_LEVELS = ("autumn", "spring", "summer", "winter")

# Fixed-date holidays (month, day); weekends count as holidays too.
HOLIDAYS = ((1, 1), (2, 14), (5, 1), (10, 1), (12, 25))

# Time of day: hours 0-6 night, 7-12 morning, 13-18 afternoon, 19-23 evening.
TIME_OF_DAY = (("night", 0, 6), ("morning", 7, 12), ("afternoon", 13, 18), ("evening", 19, 23))

# Lag and rolling-window sets of the three feature pipelines.
FULL_TARGET_LAGS = tuple(range(1, MAX_LAG_HOURS + 1))
FULL_POLLUTANT_LAGS = (1, 3, 6, 12, 24)
FULL_METEO_LAGS = (1, 6, 24)
FULL_TARGET_WINDOWS = (6, 12, 24, 48)
FULL_POLLUTANT_WINDOWS = (12, 24)
FULL_METEO_WINDOWS = (6, 24)
STD_METEO = ("TEMP", "PRES", "WSPM")

SAFE_TARGET_LAGS = (1, 6, 12, 24)
SAFE_OTHER_LAGS = (1, 6)
SAFE_METEO = ("TEMP", "PRES", "WSPM")
SAFE_TARGET_WINDOWS = (6, 12, 24)
SAFE_ROLLING_METEO = ("TEMP", "PRES")

BASIC_LAGS = (1, 2, 3, 4, 5, 6)
BASIC_LAG_COLUMNS = ("PM2_5", "TEMP", "PRES")

CRITICAL_LAGS = (1, 6, 12, 24)   # rows without these target lags are dropped

RAW_MODEL_COLUMNS = ("PM10", "SO2", "NO2", "CO", "O3", "TEMP", "PRES", "DEWP", "RAIN", "WSPM")
RAW_MODEL_TIME_COLUMNS = ("hour", "month", "day_of_week")

DOMAIN_FEATURES_TAIL = ("TEMP", "PRES", "WSPM", "DEWP",
                        "hour_sin", "hour_cos", "month_sin", "month_cos", "is_weekend")
MAX_SELECTED_FEATURES = 50

GUIDELINE = 25.0               # guideline level of the target (same unit)
LARGE_ERROR = 50.0             # |residual| above this is a large error
WITHIN_THRESHOLDS = (5, 10, 15, 25)
LOWER_IS_BETTER = ("rmse", "mae", "mape")
RATIO_EPS = 1e-8
BASIC_RATIO_EPS = 1e-6
MINMAX_EPS = 1e-8
COMPOSITE_POLLUTANTS = ("PM2_5", "PM10", "NO2", "SO2")

# Boosted-tree defaults and the search space of the tuner.
GBT_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": 42}
SEARCH_SPACE = {
    "maxDepth": ("int", 3, 10),
    "stepSize": ("logfloat", 0.01, 0.3),
    "maxIter": ("int", 100, 1000),
    "subsamplingRate": ("float", 0.6, 1.0),
    "featureSubsetFraction": ("float", 0.6, 1.0),
}
RANDOM_STATE = 42
CV_SPLITS = 5
SEARCH_TRIALS = 50
TOP_FEATURES = 15
EARLY_STOPPING_ROUNDS = 50
EARLY_STOPPING_MIN_DELTA = 0.001

# --------------------------------------------------------------------------


def _ts(value: str | _dt.datetime) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    return _dt.datetime.fromisoformat(value)


@dataclass(frozen=True)
class PanelSpec:
    """Column roles and parameters of one panel.

    ``chunk_rows`` and ``halo`` control how row-ordered windows are spread
    over tasks (see :mod:`tessera.operators.sequence`), ``chunk_hours`` does it
    for windows and grids by time; ``position_bucket``
    is the time grain used to number rows without one task per key.
    """

    key: str = "station"
    time: str = "datetime"
    target: str = TARGET
    pollutants: tuple = POLLUTANTS
    meteorology: tuple = METEOROLOGY
    wind: str = WIND_DIRECTION
    limits: dict = field(default_factory=lambda: dict(PHYSICAL_LIMITS))
    train_end: str = TRAIN_END
    val_start: str = VAL_START
    val_end: str = VAL_END
    test_start: str = TEST_START
    key_levels: tuple | None = None
    fill_limit: int = FORWARD_FILL_LIMIT
    chunk_rows: int = 1 << 18
    chunk_hours: int = 1 << 13
    position_bucket: str = "day"
    position_method: str = "bucket"
    tiebreak: tuple = ()
    seed: int = RANDOM_STATE

    def replace(self, **kw) -> "PanelSpec":
        return dataclasses.replace(self, **kw)

    def present(self, df, names) -> list[str]:
        cols = set(df.columns)
        return [c for c in names if c in cols]

    @property
    def split_bounds(self):
        return (_ts(self.train_end), _ts(self.val_start), _ts(self.val_end), _ts(self.test_start))


AIR_QUALITY = PanelSpec()
