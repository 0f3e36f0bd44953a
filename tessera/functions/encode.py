"""Encodings and lookups (M1, M6, M7, M8, J4): one-hot by declared levels,
literal-map lookups, wind direction, safe ratios, products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import COMPASS_POINTS, COMPASS_STEP_DEGREES


def one_hot(value: Column, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """M1: ``{prefix}_{level}`` = 1 when equal, else 0 (NULL value -> 0).
    Levels are declared, so every split gets the same columns."""
    return {f"{prefix}_{lv}": F.coalesce((value == F.lit(lv)).cast("int"), F.lit(0)) for lv in levels}


def lookup(value: Column, mapping: dict) -> Column:
    """Literal-map lookup; unmapped or NULL -> NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, value)


def compass_degrees(label: Column) -> Column:
    """M8: 16-point label -> degrees clockwise from north."""
    return lookup(label, {p: i * COMPASS_STEP_DEGREES for i, p in enumerate(COMPASS_POINTS)})


def wind_components(label: Column) -> dict[str, Column]:
    deg = compass_degrees(label)
    return {"wind_dir_sin": F.sin(F.radians(deg)), "wind_dir_cos": F.cos(F.radians(deg))}


def safe_ratio(num: Column, den: Column, eps: float) -> Column:
    """M6: ``num / (den + eps)``; a zero denominator gives NULL, not an error."""
    return F.try_divide(num, den + F.lit(eps))
