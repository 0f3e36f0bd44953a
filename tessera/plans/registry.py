"""All registered queries and their oracle SQL, gathered from the domain
modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import chunked, cleaning, featuring, modeling, scoring, selection, storage, timed


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featuring.forecast_features(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for mod in (cleaning, featuring, scoring, selection, modeling, chunked, timed, storage):
        out.update(mod.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in (cleaning, featuring, scoring, selection, modeling, chunked, timed, storage):
        out.update(mod.SQL)
    return out
