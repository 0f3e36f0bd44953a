"""Statistics, fills, selection and sampling (A7, A9-A11, A19-A21, T2-T7,
P5-P10, M2, U1-U2)."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config as C
from tessera.config import PanelSpec
from tessera.operators.quantiles import quantile_row, quantiles
from tessera.operators.sequence import POS, drop_position, with_position
from tessera.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# ---------------------------------------------------------------- P9, P10, U1, U2

def numeric_names(df: DataFrame, exclude: Sequence[str] = (), include_bool: bool = False) -> list[str]:
    """P10: numeric columns (``select_dtypes(number)`` excludes booleans)."""
    kinds = NUMERIC + ((T.BooleanType,) if include_bool else ())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def common_numeric(frames: Sequence[DataFrame], exclude: Sequence[str] = ()) -> list[str]:
    """Columns numeric (or boolean) in the first frame and present in
    all frames, minus ``exclude``; sorted for a stable order.  Schema work
    only, no data is read."""
    first = set(numeric_names(frames[0], exclude, include_bool=True))
    for f in frames[1:]:
        first &= set(f.columns)
    return sorted(first)


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of per-station frames, missing columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- A7

def monthly_mean(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean target per calendar month."""
    return df.groupBy(F.month(spec.time).alias("month")).agg(F.avg(spec.target).alias(f"mean_{spec.target}"))


# ---------------------------------------------------------------- A9, A10

def median_fill(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                method: str = "exact") -> DataFrame:
    """NULLs of numeric ``cols`` replaced by the median of ``fit`` (default:
    the frame itself; pass the train split to apply train medians to all)."""
    cols = list(cols)
    if not cols:
        return df
    med = quantile_row(fit if fit is not None else df, cols, [0.5], method, fmt="_med_{name}")
    d = df.crossJoin(F.broadcast(med))   # one row
    d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}").cast(df.schema[c].dataType)) for c in cols})
    return d.drop(*[f"_med_{c}" for c in cols])


def mode_fill(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
              default: str = "unknown") -> DataFrame:
    """A10: NULLs of string ``cols`` replaced by the most frequent value of
    ``fit`` (smallest on ties), else ``default``."""
    cols = list(cols)
    if not cols:
        return df
    src = fit if fit is not None else df
    # Counted by value (summed within tasks first), then the best per column:
    # the smallest (-count, value). No buffer holds a column's values.
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = src.select(F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    modes = best.agg(*[F.max(F.when(F.col("name") == c, F.col("b.v"))).alias(f"_mode_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(modes))   # one row
    d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}"), F.lit(default)) for c in cols})
    return d.drop(*[f"_mode_{c}" for c in cols])


# ---------------------------------------------------------------- A11, T2, T3, T4

def target_correlation(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``(feature, abs_corr)`` of every numeric column with the target,
    pairwise-complete, one aggregate for all columns; null for a column that
    doesn't vary (``corr`` would divide by zero)."""
    cols = [c for c in (cols or numeric_names(df, include_bool=True)) if c != target]
    y = F.col(f"`{target}`").cast("double")

    def abs_corr(c: str):
        x = F.col(f"`{c}`").cast("double")
        both = lambda v, other: F.stddev_pop(F.when(other.isNotNull(), v))
        return F.abs(F.try_divide(F.covar_pop(x, y), both(x, y) * both(y, x)))

    agg = df.agg(*[abs_corr(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("abs_corr")) for c in cols])
    out = agg.select(F.inline(pairs))
    return out.withColumn("abs_corr", F.when(~F.isnan("abs_corr"), F.col("abs_corr")))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A11, full form: ``(feature_a, feature_b, n, corr)`` of every two numeric
    columns in their order, over the rows where both are there; null where one of
    them doesn't vary. Each task folds its rows into the sums of all pairs (matrix
    products of the values and their null masks), so p columns send p² / 2 rows of
    sums a task, whatever the rows. Values are taken from a middle value of their
    column, so that large means cost no digits."""
    cols = list(cols or numeric_names(df, include_bool=True))
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{j}") for j, c in enumerate(cols)])
    row = d.agg(*[F.avg(c).alias(c) for c in d.columns]).first() if cols else None
    if row is None:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n long, corr double")
    middle = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in row])
    a, b = np.triu_indices(len(cols), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            m = ~np.isnan(x)
            x, m = np.where(m, x - middle, 0.0), m.astype(np.float64)
            # Of each pair: rows, sum and square sum of the one and of the other, products.
            s, q = x.T @ m, (x * x).T @ m
            part = np.stack([g[a, b] for g in (m.T @ m, s, s.T, q, q.T, x.T @ x)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, total)], names=["a", "b", "n", "sa", "sb", "qa", "qb", "p"])

    got = d.mapInArrow(sums, "a int, b int, n double, sa double, sb double, qa double, qb double, p double").groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    va, vb = (F.col("n") * F.col(f"q{x}") - F.col(f"s{x}") ** 2 for x in "ab")
    cov = F.col("n") * F.col("p") - F.col("sa") * F.col("sb")
    # A column without variance leaves rounding noise of its squares.
    flat = lambda v, x: v <= F.col("n") * F.col(f"q{x}") * 1e-12
    corr = F.when(~flat(va, "a") & ~flat(vb, "b"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(va * vb))))
    name = lambda c: F.get(F.array(*map(F.lit, cols)), F.col(c))
    return got.select(name("a").alias("feature_a"), name("b").alias("feature_b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))


def domain_features(spec: PanelSpec) -> list[str]:
    t = spec.target
    return ([f"{t}_lag_{k}h" for k in C.CRITICAL_LAGS] + list(C.DOMAIN_FEATURES_TAIL)
            + [f"{t}_rolling_mean_24h", f"{t}_rolling_std_24h", "temp_dewp_interaction", "pm25_pm10_ratio"])


def select_features(df: DataFrame, spec: PanelSpec, max_features: int = C.MAX_SELECTED_FEATURES) -> DataFrame:
    """Domain features first (those present, in their order), then the
    most correlated remaining features, up to ``max_features``.
    Returns ``(rank, feature, abs_corr, source)``. Correlations that agree to ten
    decimals (of a column and its multiple, say) are ties, in order of name."""
    corr = target_correlation(df, spec.target)
    present = [c for c in dict.fromkeys(domain_features(spec)) if c in df.columns and c != spec.target]
    spark = df.sparkSession
    pri = spark.createDataFrame([(c, i) for i, c in enumerate(present)], "feature string, priority int") \
        if present else spark.createDataFrame([], "feature string, priority int")
    ranked = corr.join(F.broadcast(pri), "feature", "full")
    ranked = ranked.withColumn("source", F.when(F.col("priority").isNotNull(), "domain").otherwise("correlation"))
    top = ranked.orderBy(*_rank_order()).limit(max_features)
    # The limit above is the feature (top-k); ranks are taken within those rows.
    return top.select(F.row_number().over(_rank_window()).alias("rank"), "feature", "abs_corr", "source")


def _rank_order():
    return F.col("priority").asc_nulls_last(), F.round("abs_corr", 10).desc_nulls_last(), F.col("feature")


def _rank_window():
    return Window.orderBy(*_rank_order())


def top_k(df: DataFrame, score: str, k: int, name: str = "feature") -> DataFrame:
    """The ``k`` highest scores, ties broken by name."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(name)).limit(k)


# ---------------------------------------------------------------- A19, A20

def histogram(df: DataFrame, col: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins between min and max (last edge
    inclusive) per group; count and density n / (N * width)."""
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n")) \
        if by else df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    # Counted by value first: what meets a group's range is its distinct values.
    d = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    # One row overall: broadcast.  Per group the table grows with the number of
    # groups, so the join strategy is left to the planner / AQE.
    d = d.join(rng, by) if by else d.crossJoin(F.broadcast(rng))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide((F.col(col) - F.col("_lo")) * F.lit(float(bins)), F.col("_hi") - F.col("_lo")))
    d = d.withColumn("bin", F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("long"))
    counts = d.groupBy(*by, "bin", "_lo", "_hi", "_n").agg(F.sum("_c").alias("count"))
    w = width
    return counts.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"), (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.col("count").cast("long").alias("count"),
        F.try_divide(F.col("count").cast("double"), F.col("_n") * w).alias("density"))


def filliben_positions(m: int) -> list[float]:
    """Plotting positions of a normal probability plot with ``m`` points."""
    if m == 1:
        return [0.5]
    last = 0.5 ** (1.0 / m)
    mid = [(i - 0.3175) / (m + 0.365) for i in range(2, m)]
    return [1 - last] + mid + [last]


def qq_points(df: DataFrame, col: str, m: int = 100, method: str = "exact") -> DataFrame:
    """``m`` points of a normal Q-Q plot: sample quantile of ``col`` at
    each plotting position against the standard normal quantile."""
    ps = filliben_positions(m)
    nd = statistics.NormalDist()
    spark = df.sparkSession
    theo = spark.createDataFrame([(i + 1, p, nd.inv_cdf(p)) for i, p in enumerate(ps)],
                                 "point int, prob double, theoretical double")
    got = quantiles(df, [col], ps, method).select("prob", F.col("value").alias("sample"))
    return theo.join(got, "prob").select("point", "prob", "theoretical", "sample")


# ---------------------------------------------------------------- T5, T6, T7

def systematic_sample(df: DataFrame, spec: PanelSpec, every: int = 100) -> DataFrame:
    """T5: every ``every``-th row of each key in time order (rows 0, every, ...)."""
    d = with_position(df, spec)
    return drop_position(d.where(F.col(POS) % every == 0))


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = C.RANDOM_STATE) -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of the key
    columns: repeatable whatever the partitioning, and in any SQL engine."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def first_rows(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """First ``n`` rows by ``order``."""
    return df.orderBy(*order).limit(n)


# ---------------------------------------------------------------- P5, P6, P7

def complete_cases(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """P5: rows with no NULL in the features and the target."""
    return df.dropna(subset=list(features) + [target])


def complete_case_report(df: DataFrame, features: Sequence[str], target: str, name: str = "data",
                         by: str | None = None) -> DataFrame:
    """NULL cells in X, in y, total rows, rows kept and retention percent,
    for the frame as ``name`` or for each value of ``by``, in one scan."""
    feats = list(features)
    x_nulls = sum((F.col(c).isNull().cast("long") for c in feats), F.lit(0).cast("long"))
    anynull = F.lit(False)
    for c in feats + [target]:
        anynull = anynull | F.col(c).isNull()
    label = F.lit(name) if by is None else F.col(by)
    return df.groupBy(label.alias("dataset")).agg(F.sum(x_nulls).cast("long").alias("nulls_x"),
                  F.count_if(F.col(target).isNull()).cast("long").alias("nulls_y"),
                  F.count(F.lit(1)).cast("long").alias("rows"),
                  F.count_if(~anynull).cast("long").alias("rows_kept"),
                  F.try_divide(F.count_if(~anynull) * 100.0, F.count(F.lit(1))).alias("retention_pct"))


def raw_model_columns(df: DataFrame) -> list[str]:
    """The raw measurement columns present, plus hour, month, day_of_week
    when ``hour`` exists; raises when none is present."""
    cols = list(C.RAW_MODEL_COLUMNS)
    if "hour" in df.columns:
        cols += list(C.RAW_MODEL_TIME_COLUMNS)
    got = [c for c in cols if c in df.columns]
    if not got:
        raise ValueError("none of the raw model columns is in the frame")
    return got


# ---------------------------------------------------------------- M2

def label_encode(df: DataFrame, col: str, fit: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """M2: string -> code (double) in alphabetical order of the ``fit`` frame's
    values; unseen values and NULL get the next code. The distinct values are
    range-partitioned, numbered by partition offsets and joined: no label
    passes through the driver."""
    name = out or f"{col}_index"
    labels = (fit if fit is not None else df).select(F.col(col).alias("_label")).where(F.col("_label").isNotNull()).distinct()
    labels = materialize(labels.repartitionByRange("_label").sortWithinPartitions("_label")
                         .withColumn("_part", F.spark_partition_id()))
    sizes = labels.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_label"))
    codes = labels.withColumn("_r", rank).join(sizes.select("_part", "_off"), "_part").select(
        "_label", (F.col("_off") + F.col("_r") - 1).cast("double").alias(name))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("_next"))  # one row
    d = df.join(codes, F.col(col) == F.col("_label"), "left").crossJoin(F.broadcast(total))
    return d.withColumn(name, F.coalesce(F.col(name), F.col("_next"))).drop("_label", "_next")
