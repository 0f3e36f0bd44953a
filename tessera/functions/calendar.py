"""Calendar expressions (M3-M5): date parts, cyclic encodings, season,
weekend, holiday, time of day.  All are built-in column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import HOLIDAYS, SEASON_LEVELS, SEASONS, TIME_OF_DAY


def hour(t: Column) -> Column:
    return F.hour(t)


def day_of_week(t: Column) -> Column:
    """Monday = 0 .. Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(t)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month: Column) -> Column:
    lookup = F.create_map(*[x for m, s in SEASONS.items() for x in (F.lit(m), F.lit(s))])
    return F.try_element_at(lookup, month)


def is_weekend(dow: Column) -> Column:
    return dow.isin(5, 6).cast("int")


def is_holiday(t: Column, weekend: Column) -> Column:
    fixed = F.lit(False)
    for m, d in HOLIDAYS:
        fixed = fixed | ((F.month(t) == m) & (F.dayofmonth(t) == d))
    return ((weekend == 1) | fixed).cast("int")


def time_of_day(h: Column) -> Column:
    expr = None
    for label, lo, hi in TIME_OF_DAY:
        cond = h.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def time_of_day_levels() -> list[str]:
    return [label for label, _, _ in TIME_OF_DAY]


def season_levels() -> list[str]:
    return list(SEASON_LEVELS)
