"""Cleaning operators: time index, duplicates, fills, outliers, quality, split.

Every operator takes and returns a DataFrame; report values come back as
small DataFrames, never as driver-side Python loops over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import IQR_EXTREME_MULTIPLIER, IQR_MULTIPLIER, MISSING_DATA_THRESHOLD, PanelSpec
from tessera.operators.quantiles import quantile_row
from tessera.operators.sequence import POS, carry_fill, chunked_window, drop_position, epoch_seconds, spread
from tessera.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# ---------------------------------------------------------------- P1, T1

def with_time_index(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Timestamp from year, month, day, hour.  No global sort: order only
    matters inside windows (T1 ``orderBy`` is for final output only)."""
    ts = F.make_timestamp_ntz(F.col("year"), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0))
    return df.withColumn(spec.time, ts)


# ---------------------------------------------------------------- A2

def remove_duplicates(df: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """A2: keep the first row per ``keys`` by ``tiebreak`` order, NULLs last.

    Written as an aggregate (``min`` of a struct led by the tiebreak), so every
    task pre-aggregates before the shuffle and a key holding a third of all
    rows costs one small partial row per task rather than one huge group."""
    keys, tiebreak = list(keys), list(tiebreak)
    rest = [c for c in df.columns if c not in keys and c not in tiebreak]
    packed = F.struct(*(x for c in tiebreak for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))), *rest)
    firsts = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return firsts.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in tiebreak + rest]).select(*df.columns)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows removed by A2: ``count(*) - count(distinct keys)`` as one row."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum(F.col("n") - 1).cast("long").alias("duplicates_removed"),
                       F.sum("n").cast("long").alias("rows_before"),
                       F.count(F.lit(1)).cast("long").alias("rows_after"))


# ---------------------------------------------------------------- A1

def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: long table ``(column, nulls)``, one scan for every column."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return counts.select(F.inline(pairs))


def null_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """Total nulls before and after, and the reduction in percent (0/0 -> null)."""
    tb = null_profile(before).agg(F.sum("nulls").alias("nulls_before"))
    ta = null_profile(after).agg(F.sum("nulls").alias("nulls_after"))
    return tb.crossJoin(ta).withColumn(
        "reduction_pct",
        F.try_divide((F.col("nulls_before") - F.col("nulls_after")) * 100.0, F.col("nulls_before")))


# ---------------------------------------------------------------- W1-W3

def forward_fill(df: DataFrame, spec: PanelSpec, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Carry the last non-null value forward over at most ``limit``
    rows of the same key (a run longer than the limit keeps its tail null)."""
    limit = spec.fill_limit if limit is None else limit
    cols = spec.present(df, cols)
    if not cols:
        return df

    def compute(w):
        frame = w.rowsBetween(-limit, 0)
        return {c: F.last(c, ignorenulls=True).over(frame) for c in cols}

    return chunked_window(df, spec, limit, compute)


def interpolate_linear(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Linear interpolation by row position between the nearest non-null
    neighbours of the same key; leading and trailing nulls take the nearest
    value.  The neighbours may be any distance away (see ``carry_fill``)."""
    cols = spec.present(df, cols)
    if not cols:
        return df
    d = carry_fill(df, spec, cols).withColumns({c: _between(c) for c in cols})
    return d.drop(*[f"{c}__{s}" for c in cols for s in ("pv", "pp", "nv", "np")])


def _between(c: str) -> Column:
    """The value on the line between the neighbours that ``carry_fill`` found."""
    pv, pp, nv, np_ = (F.col(f"{c}__{s}") for s in ("pv", "pp", "nv", "np"))
    between = pv + (nv - pv) * (F.col(POS) - pp) / (np_ - pp)
    return (F.when(F.col(c).isNotNull(), F.col(c))
            .when(pv.isNotNull() & nv.isNotNull(), between)
            .otherwise(F.coalesce(pv, nv)))


def handle_missing(df: DataFrame, spec: PanelSpec, drop_sparse: bool = True) -> DataFrame:
    """W1 + W3 + W2 + P3 as in the cleaning stage: pollutants forward filled,
    meteorology interpolated, wind label forward filled, then sparse rows dropped.
    Both fills read one numbering and one layout: the last value before a row
    fills it forward if it stands at most ``fill_limit`` rows back."""
    forward = spec.present(df, list(spec.pollutants) + [spec.wind])
    linear = [c for c in spec.present(df, spec.meteorology) if c not in forward]
    d = carry_fill(df, spec, linear, back=forward)
    near = {c: F.when(F.col(POS) - F.col(f"{c}__pp") <= spec.fill_limit, F.col(f"{c}__pv")) for c in forward}
    d = d.withColumns(near | {c: _between(c) for c in linear})
    d = drop_position(d.drop(*[f"{c}__{s}" for c in [*forward, *linear] for s in ("pv", "pp", "nv", "np")]))
    if drop_sparse:
        d = drop_sparse_rows(d, spec)
    return d


# ---------------------------------------------------------------- P3

def drop_sparse_rows(df: DataFrame, spec: PanelSpec, threshold: float = MISSING_DATA_THRESHOLD) -> DataFrame:
    """Keep rows whose null count is at most ``threshold`` of the columns.
    The time column plays the role of the index and is not counted."""
    subset = [c for c in df.columns if c not in (spec.time, POS)]
    n = len(subset)
    need = math.ceil(n - threshold * n)
    return df.dropna(thresh=need, subset=subset)


# ---------------------------------------------------------------- A3

def clip_physical(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A3: clip measurements to their physical limits; NULL stays NULL."""
    new = {}
    for c, (lo, hi) in spec.limits.items():
        if c in df.columns:
            new[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
    return df.withColumns(new) if new else df


def clip_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows outside the physical limits per column, as ``(column, outliers)``."""
    cols = [c for c in spec.limits if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    counts = df.agg(*[F.count_if((F.col(c) < spec.limits[c][0]) | (F.col(c) > spec.limits[c][1]))
                      .cast("long").alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in cols])
    return counts.select(F.inline(pairs))


# ---------------------------------------------------------------- A4

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude and f.name != POS]


def iqr_bounds(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Q1 and Q3 of every column over all rows as one row ``{c}__q0, {c}__q1``."""
    return quantile_row(df, cols, [0.25, 0.75], method)


def cap_iqr(df: DataFrame, spec: PanelSpec, cols: Sequence[str] | None = None, method: str = "exact",
            skip_zero_iqr: bool = False) -> tuple[DataFrame, DataFrame]:
    """A4: per column, count values outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR and cap
    values beyond Q1 - 3 IQR .. Q3 + 3 IQR.  Quantiles are global (all keys).
    Returns ``(capped panel, (column, iqr_outliers) counts)``.  Columns with no
    1.5-IQR outlier are left untouched; ``skip_zero_iqr`` leaves IQR = 0 alone."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=(spec.key, spec.time))
    if not cols:
        return df, df.sparkSession.createDataFrame([], "column string, iqr_outliers long")
    bounds = iqr_bounds(df, cols, method)
    # A one-row table: broadcasting it is bounded by the number of columns.
    d = df.crossJoin(F.broadcast(bounds))
    counts, capped = [], {}
    for c in cols:
        q1, q3 = F.col(f"{c}__q0"), F.col(f"{c}__q1")
        iqr = q3 - q1
        lo, hi = q1 - IQR_MULTIPLIER * iqr, q3 + IQR_MULTIPLIER * iqr
        xlo, xhi = q1 - IQR_EXTREME_MULTIPLIER * iqr, q3 + IQR_EXTREME_MULTIPLIER * iqr
        counts.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).cast("long").alias(c))
        # A value beyond 3 IQR is also beyond 1.5 IQR, so capping it implies the
        # column has an outlier: no separate "any outlier" pass is needed.
        keep = (iqr == 0) if skip_zero_iqr else F.lit(False)
        # Bounds of whole numbers are fractions: such columns become doubles.
        typ = df.schema[c].dataType
        typ = typ if isinstance(typ, (T.FloatType, T.DoubleType, T.DecimalType)) else T.DoubleType()
        capped[c] = (F.when(~keep & (F.col(c) < xlo), xlo.cast(typ))
                     .when(~keep & (F.col(c) > xhi), xhi.cast(typ))
                     .otherwise(F.col(c).cast(typ)))
    stats = d.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("iqr_outliers")) for c in cols])
    report = stats.select(F.inline(pairs))
    d = d.withColumns(capped)
    return d.select(*df.columns), report


# ---------------------------------------------------------------- A5, W12

def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end`` as a double, on zone-less timestamps
    (independent of the session time zone)."""
    return F.timestamp_diff("SECOND", start, end).cast("double") / 3600.0


def quality_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A5: one row with negatives per pollutant, share of null per column above
    10 %, continuity (rows over expected hours) and target range, plus the
    verdict ``validation_passed`` (no negative pollutant)."""
    pol = spec.present(df, spec.pollutants)
    neg = [F.count_if(F.col(c) < 0).cast("long").alias(f"neg_{c}") for c in pol]
    span_h = hours_between(F.min(spec.time), F.max(spec.time)) + 1
    high = F.array_compact(F.array(*[
        F.when(F.avg(F.col(c).isNull().cast("double")) * 100 > 10, F.lit(c)) for c in df.columns]))
    aggs = neg + [
        F.count(F.lit(1)).cast("long").alias("rows"),
        span_h.alias("expected_hours"),
        (F.count(F.lit(1)) * 100.0 / span_h).alias("continuity_pct"),
        high.alias("high_missing_columns"),
    ]
    if spec.target in df.columns:
        aggs.append((F.max(spec.target) - F.min(spec.target)).alias("target_range"))
    s = df.agg(*aggs)
    ok = F.lit(True)
    for c in pol:
        ok = ok & (F.col(f"neg_{c}") == 0)
    s = s.withColumn("validation_passed", ok).withColumn("continuity_ok", F.col("continuity_pct") >= 80)
    if spec.target in df.columns:
        s = s.withColumn("target_range_ok", F.col("target_range") >= 10)
    return s


def continuity_by_key(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """A5 per key: rows, expected hours, continuity percent."""
    span_h = hours_between(F.min(spec.time), F.max(spec.time)) + 1
    return df.groupBy(spec.key).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), span_h.alias("expected_hours"),
        (F.count(F.lit(1)) * 100.0 / span_h).alias("continuity_pct"))


def time_gaps(df: DataFrame, spec: PanelSpec, min_gap_hours: int = 1) -> DataFrame:
    """Gaps per key, ``(key, gap_start, gap_end, missing_hours)``: each run
    of absent hours between two present rows.  Computed from consecutive rows
    (a bounded look-back window), so it never materialises the full grid."""

    def compute(w):
        return {"_prev": F.lag(spec.time, 1).over(w)}

    d = chunked_window(df.select(spec.key, spec.time), spec, 1, compute)
    hours = hours_between(F.col("_prev"), F.col(spec.time))
    d = d.withColumn("missing_hours", (hours - 1).cast("long"))
    d = d.where(F.col("missing_hours") >= min_gap_hours)
    return d.select(spec.key, (F.col("_prev") + F.expr("INTERVAL 1 HOUR")).alias("gap_start"),
                    (F.col(spec.time) - F.expr("INTERVAL 1 HOUR")).alias("gap_end"), "missing_hours")


def _hour(spec: PanelSpec) -> Column:
    return F.date_trunc("hour", F.col(spec.time)).cast("timestamp_ntz")


def _hour_spans(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """First and last hour of every key, with its rows that have a time."""
    d = df.where(F.col(spec.time).isNotNull()).select(F.col(spec.key), F.floor(epoch_seconds(_hour(spec)) / 3600).alias("_h"))
    return d.groupBy(spec.key).agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.count(F.lit(1)).alias("_n"))


def hour_grid(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``(key, time)`` of every hour from each key's first to its last. The
    span is first cut into chunks of ``spec.chunk_hours``, dealt out by key and
    chunk, and each chunk makes its own hours: no row holds a key's whole span."""
    span = materialize(_hour_spans(df, spec))
    return _grid_of(span, spec, _grid_rows(span)[0])


def _grid_rows(span: DataFrame) -> tuple[int, int]:
    """Hours of the grid, and rows that have a time."""
    both = (F.col("_hi") - F.col("_lo") + 1, F.col("_n"))
    return tuple(span.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in zip(both, ("hours", "rows")))).first())


def _grid_of(span: DataFrame, spec: PanelSpec, rows: int) -> DataFrame:
    n = int(spec.chunk_hours)
    chunks = span.select("*", F.explode(F.sequence(F.floor(F.col("_lo") / n), F.floor(F.col("_hi") / n))).alias("_c"))
    chunks = spread(chunks, rows, spec.key, "_c")
    hours = chunks.select(spec.key, F.explode(F.sequence(
        F.greatest("_lo", F.col("_c") * n), F.least("_hi", F.col("_c") * n + (n - 1)))).alias("_h"))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return hours.select(spec.key, F.timestamp_add("HOUR", F.col("_h").cast("int"), start).alias(spec.time))


def _beside_grid(df: DataFrame, spec: PanelSpec, how: str) -> DataFrame:
    """``_g`` (key and time of the grid) joined with ``_r`` (the rows) on key and
    hour, dealt to as many tasks as grid and rows are worth."""
    # Written once: the spans also say how many hours the grid has.
    span = materialize(_hour_spans(df, spec))
    hours, n = _grid_rows(span)
    # A struct is never NULL itself and compares its NULL fields as equal.
    at = F.struct(F.col(spec.key).alias("k"), _hour(spec).alias("h")).alias("_kh")
    grid = spread(_grid_of(span, spec, hours).select(at, F.struct(spec.key, spec.time).alias("_g")), hours + n, "_kh")
    rows = spread(df.select(at, F.struct(*df.columns).alias("_r")), hours + n, "_kh")
    return grid.join(rows, "_kh", how)


def missing_hours(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """``(key, time)`` of the hours of the grid that no row of the key has."""
    return _beside_grid(df.select(spec.key, spec.time), spec, "left_anti").select("_g.*")


def regularise(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The panel with a row for every hour of the grid; hours that were
    absent have nulls. Rows within an hour keep their times; so do rows without a time."""
    both = _beside_grid(df, spec, "full_outer")
    own = {c: F.col(f"_r.`{c}`") for c in df.columns}
    own |= {c: F.when(F.col("_r").isNotNull(), own[c]).otherwise(F.col(f"_g.`{c}`")) for c in (spec.key, spec.time)}
    return both.select(*(x.alias(c) for c, x in own.items()))


# ---------------------------------------------------------------- P2

def temporal_split(df: DataFrame, spec: PanelSpec, whole_days: bool = False) -> DataFrame:
    """``split`` column; bounds compare as midnight timestamps, so hours
    after midnight on the train-end and val-end days belong to no split (NULL).
    ``whole_days`` takes these days whole (``unsplit_rows`` counts what is lost)."""
    # ISO strings cast straight to TIMESTAMP_NTZ: no session or process time
    # zone is involved (a Python datetime literal would be zone-aware).
    tr, vs, ve, ts = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in spec.split_bounds)
    t = F.col(spec.time)
    if whole_days:
        day = F.expr("INTERVAL 1 DAY")
        s = F.when(t < tr + day, "train").when((t >= vs) & (t < ve + day), "val").when(t >= ts, "test")
    else:
        s = F.when(t <= tr, "train").when((t >= vs) & (t <= ve), "val").when(t >= ts, "test")
    return df.withColumn("split", s)


def unsplit_rows(df: DataFrame) -> DataFrame:
    """One row: rows that belong to no split."""
    return df.agg(F.count_if(F.col("split").isNull()).cast("long").alias("unsplit_rows"))


# ---------------------------------------------------------------- C1

def preprocess(df: DataFrame, spec: PanelSpec, method: str = "exact", dedupe_tiebreak: Sequence[str] | None = None,
               with_index: bool = False, cut_lineage: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Index -> duplicates -> fills + sparse rows -> physical clip -> IQR cap
    -> split.  Returns the cleaned panel and the report tables (lazy).
    The filled, clipped panel is checkpointed before the quantile step, which
    reads it several times (sort, rank lookup, capping)."""
    d = with_time_index(df, spec) if with_index else df
    keys = [spec.key, spec.time]
    if spec.key not in d.columns:  # one unnamed series
        out, reports = preprocess(d.withColumn(spec.key, F.lit("all")), spec, method, dedupe_tiebreak, False, cut_lineage)
        return out.drop(spec.key), reports
    tiebreak = list(dedupe_tiebreak or [c for c in d.columns if c not in keys])
    reports = {"duplicates": duplicate_count(d, keys)}
    d = remove_duplicates(d, keys, tiebreak)
    before = d
    d = handle_missing(d, spec)
    reports["nulls"] = null_reduction(before, d)
    reports["physical"] = clip_counts(d, spec)
    d = clip_physical(d, spec)
    if cut_lineage:
        d = materialize(d)
    d, reports["iqr"] = cap_iqr(d, spec, method=method)
    reports["quality"] = quality_summary(d, spec)
    d = temporal_split(d, spec)
    reports["unsplit"] = unsplit_rows(d)
    return d, reports


def preprocessing_report(reports: dict[str, DataFrame], rows_in: DataFrame, rows_out: DataFrame) -> DataFrame:
    """A22 (cleaning): ``(seq, line)`` report made from the report tables, with
    a line for each column that had values beyond its limits or quartile range."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    flag = F.when(F.col("validation_passed"), "none").otherwise("some")
    parts = [
        count(rows_in).select(F.format_string("rows read: %d", "n").alias("line")),
        reports["duplicates"].select(F.format_string("duplicate rows dropped: %d", F.coalesce("duplicates_removed", F.lit(0))).alias("line")),
        reports["nulls"].select(F.format_string("null values before and after the fills: %d, %d", F.coalesce("nulls_before", F.lit(0)),
                                                F.coalesce("nulls_after", F.lit(0))).alias("line")),
        reports["physical"].where("outliers > 0").select(
            F.format_string("%s: %d values set to a physical limit", "column", "outliers").alias("line")),
        reports["iqr"].where("iqr_outliers > 0").select(
            F.format_string("%s: %d values outside the quartile range", "column", "iqr_outliers").alias("line")),
        reports["quality"].select(F.format_string("negative pollutant values: %s", flag).alias("line")),
        reports["unsplit"].select(F.format_string("rows of no split: %d", "unsplit_rows").alias("line")),
        count(rows_out).select(F.format_string("rows kept: %d", "n").alias("line")),
    ]
    lines = union_parts([p.select(F.lit(k).alias("part"), "line") for k, p in enumerate(parts)])
    # A few lines and two a column: one task numbers them.
    return lines.select((F.row_number().over(Window.orderBy("part", "line")) - 1).alias("seq"), "line")


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
