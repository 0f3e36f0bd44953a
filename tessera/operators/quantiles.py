"""Global quantiles of many columns in one job.

``exact`` reproduces linear interpolation between order statistics
(``percentile`` / DuckDB ``quantile_cont`` / pandas ``quantile``) without
sending a column's values to one task: values of all columns are unpivoted
to ``(name, v)`` and counted per distinct value (summed within tasks first, so a
value that fills most of a column is one row a task). The distinct values are
range-partitioned and sorted; their running counts, per partition and then over the
partitions' totals (one row per partition and column), give each value its ranks,
and only the values that hold a needed rank are kept.

``approx`` uses ``percentile_approx`` (one pass, bounded memory per task)
with a relative rank error of ``1 / accuracy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact",
              accuracy: int = 10000) -> DataFrame:
    """Long table ``(name, prob, value)``; ``value`` is null when the column has
    no non-null value."""
    cols = list(cols)
    probs = [float(p) for p in probs]
    spark = df.sparkSession
    grid = spark.createDataFrame([(c, p) for c in cols for p in probs], "name string, prob double")
    if method == "approx":
        long = _long_values(df, cols)
        got = long.groupBy("name").agg(
            F.percentile_approx("v", F.array(*[F.lit(p) for p in probs]), accuracy).alias("qs"))
        got = got.select("name", F.posexplode("qs").alias("i", "value"))
        idx = spark.createDataFrame([(i, p) for i, p in enumerate(probs)], "i int, prob double")
        got = got.join(F.broadcast(idx), "i").select("name", "prob", "value")
        return grid.join(got, ["name", "prob"], "left")
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")

    values = _long_values(df, cols).groupBy("name", "v").agg(F.count(F.lit(1)).alias("c"))
    # Range bounds come from sampling the input, and an unordered input may be
    # sampled differently by two evaluations: the distinct values are written once.
    ordered = materialize(values.repartitionByRange("name", "v").withColumn("_part", F.spark_partition_id()))
    # One row per (partition, column): bounded by partitions x columns.
    per_part = ordered.groupBy("_part", "name").agg(F.sum("c").alias("_n"))
    wpart = Window.partitionBy("name").orderBy("_part")
    offsets = per_part.select(
        "_part", "name", F.coalesce(F.sum("_n").over(wpart.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    totals = per_part.groupBy("name").agg(F.sum("_n").alias("n"))
    targets = grid.join(totals, "name", "left").select(
        "name", "prob", "n",
        ((F.col("n") - 1) * F.col("prob")).alias("_h"))
    targets = targets.select("name", "prob", "n", F.floor("_h").cast("long").alias("lo"),
                             F.ceil("_h").cast("long").alias("hi"),
                             (F.col("_h") - F.floor("_h")).alias("frac"))
    need = (targets.select("name", F.explode(F.array("lo", "hi")).alias("rank"))
            .where(F.col("rank").isNotNull()).distinct())
    upto = Window.partitionBy("_part", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("_upto", F.sum("c").over(upto)).join(offsets, ["_part", "name"]).select(
        "name", "v", (F.col("_off") + F.col("_upto") - F.col("c")).alias("_from"), (F.col("_off") + F.col("_upto")).alias("_to"))
    # ``need`` has at most 2 x columns x probabilities rows.
    picked = ranked.join(F.broadcast(need), "name").where(
        (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))).select("name", "rank", "v")
    lo = picked.select("name", F.col("rank").alias("lo"), F.col("v").alias("vlo"))
    hi = picked.select("name", F.col("rank").alias("hi"), F.col("v").alias("vhi"))
    out = (targets.join(lo, ["name", "lo"], "left").join(hi, ["name", "hi"], "left")
           .select("name", "prob", (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("value")))
    return out


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact",
                 fmt: str = "{name}__q{i}") -> DataFrame:
    """One-row table with a column per (column, probability); a one-row table
    is safe to broadcast onto every row of the panel."""
    q = quantiles(df, cols, probs, method)
    aggs = []
    for c in cols:
        for i, p in enumerate(probs):
            aggs.append(F.max(F.when((F.col("name") == c) & (F.col("prob") == float(p)), F.col("value")))
                        .alias(fmt.format(name=c, i=i)))
    return q.agg(*aggs)
