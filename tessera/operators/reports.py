"""Report tables (A21, A22, P9): shapes of frames, coverage of features, and
features by name category. Counts are Spark aggregates over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name fragments of each feature category (groups overlap).
CATEGORY_PATTERNS = (
    ("temporal", ("hour", "day", "month", "season", "weekend", "holiday", "time")),
    ("lag", ("lag",)),
    ("rolling", ("rolling",)),
    ("interaction", ("interaction",)),
    ("station", ("station",)),
    ("advanced", ("change_rate", "ratio", "trend", "wind_dir", "composite")),
)


def shape_table(frames: Mapping[str, DataFrame]) -> DataFrame:
    """``(stage, n_columns, n_rows)`` per named frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("stage"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.col("n_rows").cast("long").alias("n_rows")) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_coverage(df: DataFrame, names: Sequence[str], by: str = "split") -> DataFrame:
    """P9 over the rows: ``(by, feature, rows, non_null)`` of each feature in each
    part, one aggregate for all of them."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                *[F.count(F.col(f"`{c}`")).cast("long").alias(f"n{j}") for j, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{j}").alias("non_null")) for j, c in enumerate(names)])
    return counts.select(by, "rows", F.inline(pairs)).select(by, "feature", "rows", "non_null")


def feature_categories(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A22 over the rows: ``(category, features, cells, non_null)``: the features
    whose name holds one of a category's fragments (groups overlap; ``total`` is
    all), their cells, and how many of these are not null."""
    one = feature_coverage(df.withColumn("_all", F.lit(0)), names, "_all")
    kinds = [F.struct(F.lit("total").alias("category"), F.lit(True).alias("of"))]
    for cat, pats in CATEGORY_PATTERNS:
        cond = F.lit(False)
        for p in pats:
            cond = cond | F.col("feature").contains(p)
        kinds.append(F.struct(F.lit(cat).alias("category"), cond.alias("of")))
    d = one.select("rows", "non_null", F.inline(F.array(*kinds)))
    return d.groupBy("category").agg(F.count_if("of").cast("long").alias("features"),
                                     F.coalesce(F.sum(F.when(F.col("of"), F.col("rows"))), F.lit(0)).cast("long").alias("cells"),
                                     F.coalesce(F.sum(F.when(F.col("of"), F.col("non_null"))), F.lit(0)).cast("long").alias("non_null"))
