"""Scoring metrics over any scored table ``(…, model, split, y, p)``
(M10, A12-A18, P13, P14).  Every metric set is one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config as C


def residuals(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Residual and absolute residual."""
    return df.withColumns({"residual": F.col(y) - F.col(p), "abs_residual": F.abs(F.col(y) - F.col(p))})


def _err(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def regression_aggs(y: str = "y", p: str = "p", within: bool = True) -> list[Column]:
    """RMSE, MAE, R² (1 - SSE / SST), MAPE over rows with y != 0 (the
    skipped rows are counted), share within 10."""
    e = _err(y, p)
    ae = F.abs(e)
    sst = F.var_pop(y) * F.count(y)
    out = [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(ae).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), sst)).alias("r2"),
        (F.avg(F.abs(F.try_divide(e, F.col(y)))) * 100).alias("mape"),
        F.count_if(F.col(y) == 0).cast("long").alias("mape_skipped"),
        F.count(F.lit(1)).cast("long").alias("n"),
    ]
    if within:
        out.append((F.avg((ae <= 10).cast("double")) * 100).alias("pct_within_10"))
    return out


def full_aggs(y: str = "y", p: str = "p") -> list[Column]:
    """A12 plus means, population std of actual / predicted / residual,
    mean residual and shares within 5, 10, 15, 25."""
    e = _err(y, p)
    ae = F.abs(e)
    out = regression_aggs(y, p, within=False)
    out += [F.avg(y).alias("mean_actual"), F.avg(p).alias("mean_predicted"),
            F.stddev_pop(y).alias("std_actual"), F.stddev_pop(p).alias("std_predicted"),
            F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual")]
    out += [(F.avg((ae <= t).cast("double")) * 100).alias(f"pct_within_{t}") for t in C.WITHIN_THRESHOLDS]
    return out


def metrics(df: DataFrame, by: Sequence[str] = ("model", "split"), full: bool = False,
            y: str = "y", p: str = "p") -> DataFrame:
    aggs = full_aggs(y, p) if full else regression_aggs(y, p)
    by = [b for b in by if b in df.columns]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


METRIC_NAMES = ("rmse", "mae", "r2", "mape", "pct_within_10")


def metrics_long(m: DataFrame, by: Sequence[str], names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return m.select(*by, F.inline(pairs))


def compare_two(df: DataFrame, baseline: str, candidate: str, split: str = "test",
                y: str = "y", p: str = "p") -> DataFrame:
    """Per metric the baseline value, the candidate value and the
    improvement percent (lower is better for rmse, mae, mape)."""
    d = df.where((F.col("split") == split) & F.col("model").isin(baseline, candidate))
    long = metrics_long(metrics(d, ["model"], y=y, p=p), ["model"])
    wide = long.groupBy("metric").pivot("model", [baseline, candidate]).agg(F.first("value"))
    b, c = F.col(f"`{baseline}`"), F.col(f"`{candidate}`")
    lower = F.col("metric").isin(*C.LOWER_IS_BETTER)
    imp = F.when(lower, F.try_divide((b - c) * 100, b)).otherwise(F.try_divide((c - b) * 100, b))
    return wide.select("metric", b.alias("baseline"), c.alias("candidate"), imp.alias("improvement_pct"))


def model_table(df: DataFrame, split: str = "test", y: str = "y", p: str = "p") -> DataFrame:
    """Rmse, mae, r2, within 10, within 25 for every model."""
    d = df.where(F.col("split") == split)
    m = d.groupBy("model").agg(*full_aggs(y, p))
    return m.select("model", "rmse", "mae", "r2", "pct_within_10", "pct_within_25")


def improvement_summary(df: DataFrame, baseline: str, candidate: str, split: str = "test") -> DataFrame:
    """RMSE, R², MAE improvement percent and absolute RMSE drop."""
    c = compare_two(df, baseline, candidate, split)
    g = lambda m, col: F.max(F.when(F.col("metric") == m, F.col(col)))
    return c.agg(g("rmse", "improvement_pct").alias("rmse_improvement_pct"),
                 g("r2", "improvement_pct").alias("r2_improvement_pct"),
                 g("mae", "improvement_pct").alias("mae_improvement_pct"),
                 (g("rmse", "baseline") - g("rmse", "candidate")).alias("rmse_drop"))


def overfit_check(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Val and test RMSE per model, their gap, and whether it is the
    smallest gap of all models."""
    m = df.where(F.col("split").isin("val", "test")).groupBy("model").pivot("split", ["val", "test"]).agg(
        F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2)))
    m = m.select("model", F.col("val").alias("val_rmse"), F.col("test").alias("test_rmse"),
                 (F.col("val") - F.col("test")).alias("gap"))
    best = m.agg(F.min(F.abs("gap")).alias("_best"))
    return m.crossJoin(F.broadcast(best)).withColumn("smallest_gap", F.abs("gap") == F.col("_best")).drop("_best")


def guideline_ratio(df: DataFrame, split: str = "test", guideline: float = C.GUIDELINE,
                    y: str = "y", p: str = "p") -> DataFrame:
    """Test mean of the target and RMSE as percent of the guideline."""
    d = df.where(F.col("split") == split)
    return d.groupBy("model").agg(F.avg(y).alias("mean_actual"),
                                  (F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2)) / guideline * 100).alias("rmse_pct_of_guideline"))


def large_errors(df: DataFrame, threshold: float = C.LARGE_ERROR, y: str = "y", p: str = "p") -> DataFrame:
    """Count and percent of rows with |y - p| above ``threshold``."""
    big = F.abs(F.col(y) - F.col(p)) > threshold
    return df.groupBy("model", "split").agg(F.count_if(big).cast("long").alias("large_errors"),
                                            (F.avg(big.cast("double")) * 100).alias("large_error_pct"))


def negative_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a negative value, per column, as ``(column, negatives)``."""
    cols = [c for c in cols if c in df.columns]
    agg = df.agg(*[F.count_if(F.col(c) < 0).cast("long").alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("negatives")) for c in cols])
    return agg.select(F.inline(pairs))
