"""Line deduplication (operator 2) over a distributed suffix array of line ids,
DataFrame functions only.

A document is the sequence of its lines' ids (128 hash bits a line). Suffixes
are ranked by prefix doubling: a suffix's rank is the number of suffixes whose
first 2^t ids are smaller, so equal ranks are an LCP interval: the suffixes that
share (at least) 2^t lines, and the rank is where the interval begins. A round pairs
each rank with the one 2^t lines on, counts the pairs, and adds to a rank the
number of its interval's suffixes with smaller pairs. Suffixes alone in their
interval, and those whose pair includes the document's end, are final and take
no further part; documents without open suffixes leave the rounds.

Runs are repeated if they have at least ``min_lines`` lines (a power of two), or
one to three lines of at least ``min_chars`` characters in all. The LCP
intervals of depth 1, 2 and ``min_lines`` hold the places of such runs, those of
three lines are pairs of neighbouring intervals of depth 2; overlapping places join
to the maximal repeated runs. In each interval the first place by (document id,
text hash, line) stays, and the lines of later places are deleted. Deeper rounds
only tell how far a run goes on, which the overlaps do as well: the deletion stops
at the depth it needs, ``suffix_ranks`` goes on to the end.

No group is brought together: pairs are counted with partial sums, so a line or
run that a third of all lines share is one row a task; sums over the pairs of one
rank go over ``BUCKETS`` ranges of the second rank first; ranks return
to the suffixes by joins that adaptive execution can split. Each round ends in
a checkpoint.

Defined results: a null id is an id like others, and comes first; a null text has no lines and stays null; an empty text has one
empty line; lines are what stands between \\n; rows with one id and one text
are one document (each such row gets the same result), rows with one id and
different texts are different documents; an empty table gives an empty result.
Only the id and text take part; other columns are carried (a column named
like one of the three counts gives way to it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.session import materialize

MIN_LINES = 4
MIN_CHARS = 100
BUCKETS = 4096
KEY = ["id", "k"]


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, line, h1, h2, chars): one row per line of each distinct (id, text)."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.split(text_col, "\n", -1).alias("lines"))
    d = d.select(*KEY, F.posexplode("lines").alias("line", "s"))
    return d.select(*KEY, "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"),
                    F.length("s").alias("chars")).distinct()


def smaller(groups: DataFrame, within: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``groups`` with ``below``: the sum of ``c`` over the groups of the same
    ``within`` that come before it in the order (bucket, order). Summed by
    bucket first, so what one window brings together is a bucket's rows or one row a bucket."""
    g = groups.withColumn("_b", bucket)
    sums = g.groupBy(*within, "_b").agg(F.sum("c").alias("_c"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return g.join(sums, [*within, "_b"]).withColumn(
        "below", F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).drop("_b", "_before")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(id, k, line, chars, r, c, first): rank, interval size and first place by
    the first line; only documents with a repeated line."""
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "line")).alias("first"))
    # Hash values are spread evenly, so equal ranges of them are equal buckets.
    bucket = F.floor((F.col("h1") / 2.0**64 + 0.5) * BUCKETS).cast("int")
    ids = smaller(ids.withColumn("_all", F.lit(0)), ["_all"], ["h1", "h2"], bucket)
    r = lines.join(ids.select("h1", "h2", F.col("below").alias("r"), "c", "first"), ["h1", "h2"])
    open_ = F.max(F.col("c") > 1).over(Window.partitionBy(*KEY))
    return r.withColumn("_open", open_).where("_open").select(*KEY, "line", "chars", "r", "c", "first", (F.col("c") > 1).alias("open"))


def double(r: DataFrame, step: int, n: int) -> DataFrame:
    """Ranks by the first 2 * step lines from ranks by the first ``step``;
    ``n``: a bound of the ranks."""
    nxt = F.lead("r", step, -1).over(Window.partitionBy(*KEY).orderBy("line"))
    r = r.select(*KEY, "line", "chars", "r", "open", nxt.alias("r2"))
    live = r.where("open")
    pairs = live.groupBy("r", "r2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "line")).alias("first"))
    width = max(1, n // BUCKETS)
    pairs = smaller(pairs, ["r"], ["r2"], F.floor(F.col("r2") / width))
    live = live.join(pairs, ["r", "r2"]).select(
        *KEY, "line", "chars", (F.col("r") + F.col("below")).alias("r"), "c", "first",
        ((F.col("c") > 1) & (F.col("r2") >= 0)).alias("open"))
    final = r.where(~F.col("open")).select(*KEY, "line", "chars", "r", F.lit(None).cast("long").alias("c"),
                                           F.lit(None).cast(live.schema["first"].dataType).alias("first"), "open")
    return live.unionByName(final)


def still_open(r: DataFrame) -> DataFrame:
    return r.withColumn("_any", F.max("open").over(Window.partitionBy(*KEY))).where("_any").drop("_any")


def suffix_ranks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Yields (depth, ranks) for depth 1, 2, 4, ...: stored rows (id, k, line,
    chars, r, c, first, open); c and first describe the LCP interval of that depth
    and are null for suffixes that were final before. The last one ranks every
    suffix of the documents that were open until then."""
    r = materialize(first_ranks(line_rows(docs, id_col, text_col)))
    n, depth = (r.agg(F.max("r")).first()[0] or 0) + 1, 1
    yield depth, r
    while r.where("open").limit(1).count():
        r = materialize(double(still_open(r), depth, n))
        depth *= 2
        yield depth, r


def triples(r: DataFrame) -> DataFrame:
    """(id, k, line, n, c, first) of the runs of three lines from the ranks by
    two: neighbouring ranks, counted; n: characters of the run."""
    here = Window.partitionBy(*KEY).orderBy("line")
    d = r.select(*KEY, "line", "r", "open", (F.col("chars") + F.lead("chars", 1).over(here) + F.lead("chars", 2).over(here)).alias("n"),
                 F.lead("r", 1).over(here).alias("r2"), F.lead("open", 1).over(here).alias("open2"))
    # Equal runs have equal ranks, both shared; a run that leaves the document has no n.
    d = d.where("open AND open2 AND n IS NOT NULL")
    runs = d.groupBy("r", "r2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "line")).alias("first")).where("c > 1")
    return d.join(runs, ["r", "r2"]).select(*KEY, "line", "n", "c", "first")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all lines of documents with a repeated line, the deleted ones), both
    with (id, k, line)."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    later = F.struct(*KEY, "line") > F.col("first")
    here = Window.partitionBy(*KEY).orderBy("line")
    span = lambda df, n: df.select(*KEY, F.explode(F.sequence("line", F.col("line") + (n - 1))).alias("line"))
    lines, deleted = None, []
    for depth, r in suffix_ranks(docs, id_col, text_col):
        if depth == 1:
            lines = r.select(*KEY, "line")
            deleted.append(r.where((F.col("c") > 1) & later & (F.col("chars") >= min_chars)).select(*KEY, "line"))
        if depth == 2 < min_lines:
            two = r.withColumn("n", F.col("chars") + F.lead("chars", 1).over(here))
            deleted.append(span(two.where((F.col("c") > 1) & later & (F.col("n") >= min_chars)), 2))
            deleted.append(span(triples(r).where(later & (F.col("n") >= min_chars)), 3))
        if depth == min_lines:
            # An interval of this depth also holds shorter suffixes that are
            # equal up to the document's end; those are closed.
            last = F.max("line").over(Window.partitionBy(*KEY))
            whole = (F.col("line") + depth - 1 <= last) if depth > 1 else F.lit(True)
            runs = r.withColumn("whole", whole).where((F.col("c") > 1) & F.col("whole") & later)
            deleted.append(span(runs, depth))
            break
    gone = deleted[0]
    for d in deleted[1:]:
        gone = gone.unionByName(d)
    return lines, gone.distinct()


def line_masks(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, k, gone array<boolean>): for each document that loses lines, which."""
    lines, gone = repeated_lines(docs, min_lines, min_chars, id_col, text_col)
    gone = gone.select(F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("line").alias("_line"), F.lit(True).alias("_gone"))
    m = lines.join(gone, lines["id"].eqNullSafe(gone["_id"]) & (lines["k"] == gone["_k"]) & (lines["line"] == gone["_line"]), "left")
    m = m.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("line", F.coalesce("_gone", F.lit(False)).alias("gone")))).alias("m"))
    return m.select(*KEY, F.transform("m", lambda x: x["gone"]).alias("gone")).where(F.exists("gone", lambda x: x))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
               text_col: str = "text", drop_empty: bool = False) -> DataFrame:
    """``docs`` with its later copies of repeated line runs deleted, and the
    columns n_lines, n_removed, n_runs (maximal removed runs; long).
    ``drop_empty``: rows that lost lines and have no word left go."""
    masks = line_masks(docs, min_lines, min_chars, id_col, text_col)
    i, k, gone = fresh(docs, "_id", "_k", "_gone")
    out = docs.join(masks.select(F.col("id").alias(i), F.col("k").alias(k), F.col("gone").alias(gone)),
                    F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k)), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, n: ~F.get(gone, n)), "\n")
    n_gone = F.size(F.filter(gone, lambda x: x))
    n_runs = F.size(F.filter(gone, lambda x, n: x & ~F.coalesce(F.get(gone, n - 1), F.lit(False))))
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
              "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(n_gone).cast("long"),
              "n_runs": F.when(F.col(gone).isNull(), 0).otherwise(n_runs).cast("long")}
    text = F.coalesce(F.when(F.col(gone).isNotNull(), kept), F.col(text_col)).alias(text_col)
    out = out.select(*(text if c == text_col else F.col(c) for c in docs.columns if c.lower() not in counts),
                     *(c.alias(n) for n, c in counts.items()))
    if drop_empty:
        out = out.where((F.col("n_removed") == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _short_sql(n: int) -> str:
    """Later copies of runs of ``n`` lines with enough characters."""
    frame = f"OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""short{n} AS (SELECT doc_id, text, unnest(range(i, i + {n})) AS i FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM (
    SELECT doc_id, text, i, list(s) {frame} AS run, sum(length(s)) {frame} AS chars FROM l) WHERE len(run) = {n} AND chars >= {MIN_CHARS})
  WHERE copy > 1)"""


OP2_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (SELECT *, list(s) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_LINES - 1} FOLLOWING) AS run FROM l),
one AS (SELECT doc_id, text, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS copy FROM l)
        WHERE copy > 1 AND length(s) >= {MIN_CHARS}),
many AS (SELECT doc_id, text, unnest(range(i, i + {MIN_LINES})) AS i FROM (
           SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM w WHERE len(run) = {MIN_LINES}) WHERE copy > 1),
{_short_sql(2)},
{_short_sql(3)},
gone AS (SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT * FROM many UNION ALL SELECT * FROM short2 UNION ALL SELECT * FROM short3)),
m AS (SELECT l.*, gone.i IS NOT NULL AS gone FROM l LEFT JOIN gone USING (doc_id, text, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, text ORDER BY i), false) AS starts FROM m),
k AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
             coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id, text)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id AND documents.text = k.text
"""
