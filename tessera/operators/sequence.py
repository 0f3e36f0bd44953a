"""Row-ordered windows that scale past a few hot keys.

A panel window such as "the 6 previous rows of this station" is naturally
``Window.partitionBy(key).orderBy(time)``.  With a dozen keys that runs in a
dozen tasks, and one key holding a third of all rows lands in one task.  The
helpers here keep the exact row semantics but cut every key into chunks of
``spec.chunk_rows`` rows:

1. :func:`with_position` numbers the rows of every key 0, 1, 2, ... in time
   order.  By default it numbers inside ``(key, time bucket)`` groups and adds
   per-key offsets from bucket counts (a small aggregate), so no task holds a
   whole key; ``position_method="sort"`` ranks a range-partitioned sort of
   ``(key, time)`` instead (no group of any grain in one task, at the cost of
   one checkpoint write).
2. :func:`chunked_window` gives each chunk a *halo*: copies of the last
   ``halo`` rows of the chunks before it.  Any frame that looks back at most
   ``halo`` rows is then exact inside ``partitionBy(key, chunk)``.  Halo rows
   are dropped after the window.
3. :func:`carry_fill` handles unbounded look-back / look-ahead (last or next
   non-null value at any distance) with a per-chunk summary whose carries are
   computed by a window over the summary and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.session import materialize

POS = "_pos"
CHUNK = "_chunk"
HOME = "_home"
SECONDS = "_seconds"
#: Rows that one task sorts. Larger tables are dealt to more tasks than the session's setting.
TASK_ROWS = 250_000
#: Rows of per-group offsets up to which they are broadcast.
BROADCAST_ROWS = 50_000


def tasks_for(df: DataFrame, rows: int) -> int | None:
    """Tasks that ``rows`` rows are worth, or None where the session's number of
    shuffle partitions is enough (these may still be coalesced)."""
    n = math.ceil(rows / TASK_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, rows: int, *cols: str | Column) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt out by ``cols``: what a task holds stays
    the same however large the table is and whatever the session's setting."""
    n = tasks_for(df, rows)
    return df.repartition(n, *cols) if n else df.repartition(*cols)


def time_bucket(spec, col: str | Column | None = None) -> Column:
    c = F.col(col or spec.time) if not isinstance(col, Column) else col
    return F.date_trunc(spec.position_bucket, c)


def row_order(df: DataFrame, spec) -> list[str]:
    """The time column, then the tiebreak columns that are there."""
    return [spec.time, *spec.present(df, spec.tiebreak)]


def with_position(df: DataFrame, spec, order: Sequence[str] | None = None) -> DataFrame:
    """Add ``_pos``: 0-based row number within ``spec.key`` in ``order``
    (default: the time column, then ``spec.tiebreak``).  Reuses an existing ``_pos``.
    ``spec.position_method``: ``"bucket"`` numbers inside (key, time bucket)
    groups; ``"sort"`` ranks by a range-partitioned sort, so no group of any
    grain is ever one task."""
    return _numbered(df, spec, order)[0]


def _numbered(df: DataFrame, spec, order: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """:func:`with_position` and the number of rows."""
    if POS in df.columns:
        return df, df.count()
    if getattr(spec, "position_method", "bucket") == "sort":
        return _position_by_sort(df, spec, list(order or row_order(df, spec)))
    # A struct is never NULL itself and compares its NULL fields as equal, so the
    # numbering and the join share one plain key: rows are shuffled once.
    group = F.struct(F.col(spec.key).alias("k"), time_bucket(spec).alias("b"))
    d = df.withColumn("_kb", group)
    # Written once: the sizes of the groups also say how many tasks the rows need.
    counts = materialize(d.groupBy("_kb").agg(F.count(F.lit(1)).alias("_n")))
    rows, groups = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    before = Window.partitionBy("_kb.k").orderBy("_kb.b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread(counts, groups, "_kb.k").select("_kb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_kb").orderBy(*(order or row_order(df, spec))))
    d = spread(d, rows, "_kb").withColumn("_rn", rn).join(offsets, "_kb")
    return d.withColumn(POS, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_kb", "_off", "_rn"), rows


_LOW_BITS = (1 << 33) - 1


def _position_by_sort(df: DataFrame, spec, order: list[str]) -> tuple[DataFrame, int]:
    """Rows range-partitioned and sorted by (key, order); the id of a row
    inside its sorted partition plus the row counts of the same key in
    earlier partitions (a table of at most partitions + keys rows) give its
    position.  ``order`` must make rows of a key unique for stable numbers."""
    key = spec.key
    rows = df.count()
    n = tasks_for(df, rows)
    o = (df.repartitionByRange(*([n] if n else []), key, *order).sortWithinPartitions(key, *order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    o = o.withColumns({"_part": F.shiftright("_mid", 33), "_local": F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))})
    # The range bounds come from sampling the input; two evaluations of an
    # unordered input may sample differently.  Write the numbered rows once so
    # the counts and the rows agree.
    o = materialize(o)
    o = o.withColumn("_kp", F.struct(F.col("_part").alias("p"), F.col(key).alias("k")))
    per = materialize(o.groupBy("_kp").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first")))
    groups = per.count()
    before = Window.partitionBy("_kp.k").orderBy("_kp.p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread(per, groups, "_kp.k").select("_kp", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # Few keys: the rows stay where they are. Many keys: dealt out once more.
    few = groups <= BROADCAST_ROWS
    d = o.join(F.broadcast(offsets), "_kp") if few else spread(o, rows, "_kp").join(offsets, "_kp")
    return d.withColumn(POS, (F.col("_off") + F.col("_local") - F.col("_first")).cast("long")).drop(
        "_mid", "_part", "_local", "_kp", "_first", "_off"), rows


def drop_position(df: DataFrame) -> DataFrame:
    return df.drop(POS, CHUNK, HOME)


def chunked_window(df: DataFrame, spec, halo: int,
                   compute: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Evaluate window columns over ``partitionBy(key).orderBy(_pos)`` exactly,
    for frames reaching back at most ``halo`` rows (forward frames are not
    supported).  ``compute`` receives the window spec and returns
    ``{name: column}``."""
    if halo < 0:
        raise ValueError("halo must be >= 0")
    d, rows = _numbered(df, spec)
    size = int(spec.chunk_rows)
    d = d.withColumn(HOME, F.expr(f"{POS} div {size}"))
    if halo:
        d = d.withColumn(CHUNK, F.explode(F.sequence(F.col(HOME), F.expr(f"({POS} + {halo}) div {size}"))))
    else:
        d = d.withColumn(CHUNK, F.col(HOME))
    w = Window.partitionBy(spec.key, CHUNK).orderBy(POS)
    cols = compute(w)
    # A chunk has at most a halo more than its own rows.
    out = spread(d, rows + rows * halo // size, spec.key, CHUNK).withColumns(cols)
    if halo:
        out = out.where(F.col(CHUNK) == F.col(HOME))
    return out.drop(CHUNK, HOME)


def epoch_seconds(c: str | Column) -> Column:
    """Seconds of a zone-less timestamp since 1970 (independent of the session zone)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c) if isinstance(c, str) else c)


def time_chunked_window(df: DataFrame, spec, halo_hours: int,
                        compute: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Window columns over ``partitionBy(key)`` ordered by seconds, exact for range
    frames that reach back at most ``halo_hours``. Every key is cut into chunks
    of ``spec.chunk_hours`` hours, whatever its rows; rows less than the halo
    before a chunk are copied into it. No rows are numbered: one shuffle in all.
    Rows without a time are in no frame and get nulls."""
    size, halo = int(spec.chunk_hours) * 3600, int(halo_hours) * 3600
    d = df.withColumn(SECONDS, epoch_seconds(spec.time)).withColumn(HOME, F.floor(F.col(SECONDS) / F.lit(size)))
    last = F.floor((F.col(SECONDS) + halo) / F.lit(size))
    d = d.withColumn(CHUNK, F.explode_outer(F.sequence(F.col(HOME), last)))
    cols = compute(Window.partitionBy(spec.key, CHUNK).orderBy(SECONDS))
    out = d.withColumns({n: F.when(F.col(SECONDS).isNotNull(), c) for n, c in cols.items()})
    return out.where(F.col(CHUNK).eqNullSafe(F.col(HOME))).drop(SECONDS, HOME, CHUNK)


def carry_fill(df: DataFrame, spec, cols: Sequence[str], back: Sequence[str] = ()) -> DataFrame:
    """For each column ``c`` add ``c__pv, c__pp`` (last non-null value and its
    position at or before the row) and, but for columns of ``back``, ``c__nv,
    c__np`` (first non-null value and position at or after the row), over the whole
    key, at any distance. All columns share one numbering and one layout by chunk."""
    d, rows = _numbered(df, spec)
    size = int(spec.chunk_rows)
    key = spec.key
    d = d.withColumn(CHUNK, F.struct(F.col(key).alias("k"), F.expr(f"{POS} div {size}").alias("c")))
    if getattr(spec, "position_method", "bucket") == "bucket":
        # Read twice below, for the summary and for the rows: numbered once.
        d = materialize(d)
    every = [*cols, *back]
    pair = lambda c: F.struct(F.col(POS).alias("p"), F.col(c).alias("v"))
    aggs = [F.max(F.when(F.col(c).isNotNull(), pair(c))).alias(f"{c}__last") for c in every]
    aggs += [F.min(F.when(F.col(c).isNotNull(), pair(c))).alias(f"{c}__first") for c in cols]
    summary = d.groupBy(CHUNK).agg(*aggs)
    # Looking ahead is looking back in falling order: a frame that ends with the
    # partition is computed anew for every row, in time that grows with its square.
    key_of = Window.partitionBy(f"{CHUNK}.k")
    before, after = (key_of.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
                     for o in (F.asc(f"{CHUNK}.c"), F.desc(f"{CHUNK}.c")))
    carries = [F.last(f"{c}__last", ignorenulls=True).over(before).alias(f"{c}__cin") for c in every]
    carries += [F.last(f"{c}__first", ignorenulls=True).over(after).alias(f"{c}__cout") for c in cols]
    carried = summary.select(CHUNK, *carries)
    upto, onward = (Window.partitionBy(CHUNK).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
                    for o in (F.asc(POS), F.desc(POS)))
    here = lambda c: F.when(F.col(c).isNotNull(), pair(c))
    # The windows come before the join, so the rows that are sorted are narrow.
    d = spread(d, rows, CHUNK)
    d = d.withColumns({f"{c}__next": F.last(here(c), ignorenulls=True).over(onward) for c in cols})
    d = d.withColumns({f"{c}__prev": F.last(here(c), ignorenulls=True).over(upto) for c in every})
    d = d.join(carried, CHUNK)
    d = d.withColumns({f"{c}__prev": F.coalesce(f"{c}__prev", f"{c}__cin") for c in every}
                      | {f"{c}__next": F.coalesce(f"{c}__next", f"{c}__cout") for c in cols})
    flat = {f"{c}__p{x}": F.col(f"{c}__prev.{x}") for c in every for x in "vp"}
    flat |= {f"{c}__n{x}": F.col(f"{c}__next.{x}") for c in cols for x in "vp"}
    helpers = [f"{c}__{s}" for c in every for s in ("cin", "prev")] + [f"{c}__{s}" for c in cols for s in ("cout", "next")]
    return d.withColumns(flat).drop(CHUNK, *helpers)
