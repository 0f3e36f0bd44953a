"""Benchmark decontamination (operator 9), DataFrame functions only.

Every run of ``window`` consecutive words of a benchmark item is a window (an
item of fewer words is one window). The distinct windows form a hash set. Each
text is cut into words once and each word hashed once; a window's hash is that of
its words' hashes. These are looked up in the set, and every hit is verified
word by word in the same pipelined pass, so only true hits are ever shuffled.

The window set is counted first: up to ``broadcast_windows`` windows it is
broadcast, beyond that the hashes meet it by a shuffled join.

Words: A-Z lower-cased, then runs of characters other than ASCII ones outside
0-9 and a-z.

Defined results: a null or empty text has no words, no hits and is not
contaminated; a null or wordless item has no window; items may share windows
and ids; windows of an item whose id is null hit, but add no id; documents are rows: equal rows give equal results, and rows with one
id and different texts are told apart by their text's hash; an empty benchmark
leaves every document clean. Only the id and text columns take part, other
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.session import materialize

WINDOW = 10
# The alphabet to lower-case and the word pattern.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct (item_id string, size int, win array<string>, h long)."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("size"))
    w = w.select("item_id", "size", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("win"))
    return w.distinct().withColumn("hs", F.transform("win", lambda x: F.xxhash64(x))).withColumn("h", F.coalesce(
        *(F.when(F.col("size") == n, F.xxhash64(*(F.get("hs", F.lit(i)) for i in range(n)))) for n in range(1, window + 1)))).drop("hs")


def places(docs: DataFrame, sizes: list[int], key: list[str], text_col: str) -> DataFrame:
    """(key columns, n_words, w, at, size, h): for every word the hash of the
    window that begins there, one row a size; and one row a document at place -1,
    without a hash. Each text is cut into words once, each word hashed once."""
    d = docs.select(*key, words(F.col(text_col)).alias("w")).select(
        *key, "w", F.size("w").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("hs"))
    d = d.select(*key, "w", "n_words", "hs", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at"))
    whole = lambda n: (F.col("at") >= 0) & (F.col("at") + n <= F.col("n_words"))
    h = lambda n: F.when(whole(n), F.xxhash64(*(F.get("hs", F.col("at") + i) for i in range(n))))
    if len(sizes) == 1:
        return d.select(*key, "n_words", "w", "at", F.lit(sizes[0]).alias("size"), h(sizes[0]).alias("h"))
    each = F.array(*(F.struct(F.lit(n).alias("size"), h(n).alias("h")) for n in sizes))
    one = F.array(F.struct(F.lit(0).alias("size"), F.lit(None).cast("long").alias("h")))
    return d.select(*key, "n_words", "w", "at", F.inline(F.when(F.col("at") < 0, one).otherwise(each)))


def hits(docs: DataFrame, windows: DataFrame, key: list[str], text_col: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key columns, n_words, at, size, items): every occurrence of a window in
    a document with the ids of its items; ``at`` counts words from 0. One row a
    document stands at place -1. ``windows`` must be stored."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` rows
    sets = windows.groupBy(F.col("h").alias("_h"), F.col("size").alias("_size"), "win").agg(F.collect_set("item_id").alias("items"))
    x = places(docs, sizes or [1], key, text_col)
    same = (F.col("h") == F.col("_h")) & (F.col("size") == F.col("_size"))
    # Filtered after the join: as a join key, the words would be cut out at every place.
    true = (F.col("at") < 0) | (F.col("items").isNotNull() & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("win")))
    out = [*key, "n_words", "at", "size", "items"]
    if windows.count() <= broadcast_windows:
        return x.join(F.broadcast(sets), same, "left").where(true).select(*out)
    # Rows without a hash have no part in a shuffled join.
    none = F.lit(None).cast("array<string>").alias("items")
    return x.where("at >= 0").join(sets, same).where(true).select(*out).unionByName(x.where("at < 0").select(*key, "n_words", "at", "size", none))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each document row: (id, n_words, n_hit, n_items, items array<string>
    sorted, hit_at array<int> of hit word positions, contaminated)."""
    windows = materialize(benchmark_windows(benchmark, window, item_col, item_text_col))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    rows = materialize(hits(d, windows, ["id", "k"], "text", broadcast_windows))
    found = rows.where("at >= 0")
    at = found.select("id", "k", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("p")).distinct().groupBy(
        "id", "k").agg(F.count("*").alias("n_hit"), F.sort_array(F.collect_list("p")).alias("hit_at"))
    # A window of items without an id hits all the same.
    items = found.select("id", "k", F.explode_outer("items").alias("item_id")).groupBy("id", "k").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = at.join(items, (at["id"].eqNullSafe(items["id"])) & (at["k"] == items["k"])).select(
        at["id"].alias("_id"), at["k"].alias("_k"), "n_hit", "hit_at", "items")
    n = rows.where("at < 0").select("id", "k", F.col("n_words").cast("long").alias("n_words"))
    out = n.join(hit, n["id"].eqNullSafe(hit["_id"]) & (n["k"] == hit["_k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), F.col("k").alias("text_key"), "n_words", n_hit.alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      F.coalesce("hit_at", F.array().cast("array<int>")).alias("hit_at"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "documents", id_col: str = "doc_id",
           text_col: str = "text", **options) -> DataFrame:
    """``docs`` without its hits, same columns. how="documents": rows with a
    hit go. how="spans": the hit words and what stands between two hit words
    go, the other characters of the text stay."""
    i, k, hit = fresh(docs, "_id", "_k", "_hit")
    s = scan(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select(
        F.col(id_col).alias(i), F.col("text_key").alias(k), F.col("hit_at").alias(hit)).dropDuplicates([i, k])
    on = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k))
    if how == "documents":
        return docs.join(s, on, "left_anti")
    if how != "spans":
        raise ValueError("how must be 'documents' or 'spans'")
    # The text as gap, word, gap, word, ..., gap; a gap goes between two hit words.
    # (The pattern also takes A-Z: the text keeps its case.) ``hit`` is sorted, so
    # per word a look into an array of flags does.
    own = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    j = docs.join(s, on, "left")
    w, g, flag = fresh(j, "_w", "_g", "_flag")
    j = j.withColumns({w: F.regexp_extract_all(text_col, F.lit(own), F.lit(0)), g: F.split(text_col, own, -1)})
    # Flags from the hit places: as many false as words lie between two hits.
    gap = lambda x, n: F.get(hit, n) - F.when(n == 0, F.lit(-1)).otherwise(F.get(hit, n - 1)) - 1
    j = j.withColumn(flag, F.flatten(F.transform(hit, lambda x, n: F.concat(
        F.array_repeat(F.lit(False), gap(x, n)), F.array(F.lit(True))))))
    is_hit = lambda n: F.coalesce(F.get(flag, n), F.lit(False))
    parts = F.transform(g, lambda x, n: F.concat(
        F.when(is_hit(n - 1) & is_hit(n), F.lit("")).otherwise(x),
        F.when(is_hit(n), F.lit("")).otherwise(F.coalesce(F.get(w, n), F.lit("")))))
    cut = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(F.concat_ws("", parts))
    return j.withColumn(text_col, cut).select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return s.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    "contaminated")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS size, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, w[i:i + size - 1] AS win FROM bw),
dw AS (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT DISTINCT r, i, size, item_id FROM (SELECT r, size, i, w[i:i + size - 1] AS win FROM dw) JOIN win USING (size, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, coalesce(list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)), []) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
