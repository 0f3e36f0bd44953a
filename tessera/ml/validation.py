"""Time-ordered validation folds.

Folds follow expanding-window time-series splitting over the distinct time
steps: with ``n`` steps and ``k`` splits, the test size is ``n // (k + 1)``;
fold ``i`` tests on steps ``[s_i, s_i + size)`` with ``s_i = n - (k - i) * size``
and trains on every step before ``s_i``.  Steps are numbered without a global
window: see :func:`tessera.operators.sequence.with_position`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CV_SPLITS, PanelSpec
from tessera.operators.sequence import POS, with_position


def time_steps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct time steps with their 0-based order ``step``."""
    steps = df.select(spec.time).distinct().withColumn("_all", F.lit(0))
    numbered = with_position(steps, spec.replace(key="_all"))
    return numbered.select(spec.time, F.col(POS).alias("step"))


def fold_bounds(steps: DataFrame, n_splits: int = CV_SPLITS) -> DataFrame:
    """One row per fold: ``(fold, test_start, test_end)`` in step numbers
    (end exclusive).  A ``n_splits``-row table."""
    n = steps.agg(F.count(F.lit(1)).alias("n"))
    folds = steps.sparkSession.range(n_splits).withColumnRenamed("id", "fold")
    size = F.floor(F.col("n") / F.lit(n_splits + 1))
    b = folds.crossJoin(n).select(
        F.col("fold").cast("int").alias("fold"),
        (F.col("n") - (F.lit(n_splits) - F.col("fold")) * size).alias("test_start"))
    return b.crossJoin(n).select("fold", "test_start", (F.col("test_start") + size).alias("test_end"))


def assign_folds(df: DataFrame, spec: PanelSpec, n_splits: int = CV_SPLITS) -> DataFrame:
    """Rows of ``df`` with ``(fold, role)``; a row appears once per fold it
    belongs to (train of later folds, test of one fold)."""
    steps = time_steps(df, spec)
    bounds = fold_bounds(steps, n_splits)
    roles = steps.crossJoin(F.broadcast(bounds)).select(
        spec.time, "fold",
        F.when(F.col("step") < F.col("test_start"), "train")
        .when(F.col("step") < F.col("test_end"), "test").alias("role"))
    roles = roles.where(F.col("role").isNotNull())
    return df.join(roles, spec.time)


def fold_summary(df: DataFrame, spec: PanelSpec, n_splits: int = CV_SPLITS) -> DataFrame:
    a = assign_folds(df, spec, n_splits)
    return a.groupBy("fold", "role").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                         F.min(spec.time).alias("first"), F.max(spec.time).alias("last"))
