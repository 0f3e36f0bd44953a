"""Quality rules with host verdicts (operator 6).

1. One pass over whole texts measures each document (``measure``): no shuffle,
   a few numbers per row, written once to the checkpoint folder.
2. Rule failures are summed by host (``host_rates``); Spark adds up within
   tasks first, so a host with a third of all rows costs one row per task.
   Each rule's rates over hosts give a beta prior by the method of moments,
   and a host's rate is shrunk towards it: (failures + a) / (n + a + b).
3. A host is rejected if the shrunk rate of any rule exceeds the rule's limit.
   The rejected hosts are joined back to the measured rows: as a broadcast set
   up to ``broadcast_hosts`` of them (counted first), else by a join on host
   and salt, so a large host's rows spread over ``salts`` keys.

Defined results: a null text has no words (so it fails ``n_words < min_words``);
a null host belongs to no host: it is neither counted nor rejected; repeated
rows are separate documents; an empty table gives an empty result; with fewer
than two hosts, or hosts of equal rates, the prior is ``strongest`` rows of the
mean rate. Only the id, text and host columns are read, other columns
cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.llm.pieces import byte_batches
from tessera.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BATCH_BYTES = 4 << 20


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs (a[i], b[i])."""
    if not len(a):
        return a
    key = a * (int(b.max()) + 1) + b
    order = np.argsort(key)
    s = key[order]
    out = np.empty_like(key)
    out[order] = np.cumsum(np.r_[0, (s[1:] != s[:-1]).astype(np.int64)])
    return out


def repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """For each document the number of its words that lie in a ``window``-word
    run found twice or more in it. ``ids``: a number per distinct word;
    ``doc``: the document of each word, ascending."""
    if len(ids) < window:
        return np.zeros(n_docs, dtype=np.int64)
    name = ids[:len(ids) - window + 1]
    for k in range(1, window):
        name = pair_names(name, ids[k:len(ids) - window + 1 + k])
    at = np.flatnonzero(doc[:len(name)] == doc[window - 1:])
    key = pair_names(doc[at], name[at])
    again = np.bincount(key, minlength=1)[key] > 1
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(depth, at[again], 1)
    np.add.at(depth, at[again] + window, -1)
    return np.bincount(doc[np.cumsum(depth[:-1]) > 0], minlength=n_docs)


def measure_texts(texts: list[str]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    n_words, chars, symbols, dup, n_lines, ids = [], [], [], [], [], []
    for t in texts:
        words = WORD.findall(t)
        n_words.append(len(words))
        chars.append(sum(map(len, words)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        dup.append(len(lines) - len(set(lines)))
        n_lines.append(len(lines))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    return [*(np.array(x, dtype=np.int64) for x in (n_words, chars, symbols, dup)),
            repeat_words(np.concatenate(ids), doc, len(texts)), np.array(n_lines, dtype=np.int64)]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The measures, and the lines with a word, which the rules count by.
COUNTS = (*MEASURES, "n_lines")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the six measures as long) for each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in byte_batches(b.column(2).to_pylist(), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)),
                     *(pa.array(x, pa.int64()) for x in measure_texts(texts))], names=["id", "host", *COUNTS])
                at += len(texts)

    return docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_col).mapInArrow(
        run, f"id {id_type}, host string, " + ", ".join(f"{m} long" for m in COUNTS))


def rules(min_words: int = 10, repeat_pct: int = 20, symbol_pct: int = 10, dup_line_pct: int = 50) -> dict[str, Column]:
    """Rule name -> failed?, over the measures. The first two are the base."""
    return {
        "few_words": F.col("n_words") < min_words,
        "repeats": 100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > symbol_pct * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > dup_line_pct * F.col("n_lines"),
    }


def host_rates(measured: DataFrame, failed: dict[str, Column], strongest: float = 1e6) -> DataFrame:
    """(host, n, <rule>_rate): each host's shrunk failure rate per rule. The
    prior comes from the n-weighted mean and variance of the hosts' rates; its
    weight a + b lies between 1 and ``strongest`` rows."""
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(f"{r}_failed") for r, c in failed.items()))
    total = hosts.agg(
        F.sum("n").alias("_n"),
        *(F.sum(f"{r}_failed").alias(f"_{r}_s") for r in failed),
        *(F.sum(F.col(f"{r}_failed").cast("double") * F.col(f"{r}_failed") / F.col("n")).alias(f"_{r}_q") for r in failed))
    # One row; broadcast without a hint, as an aggregate without keys.
    out = hosts.crossJoin(total)
    for r in failed:
        mean = F.col(f"_{r}_s") / F.col("_n")
        var = F.greatest(F.col(f"_{r}_q") / F.col("_n") - mean * mean, F.lit(0.0))
        weight = F.when(var <= mean * (1 - mean) / (strongest + 1), F.lit(float(strongest))).otherwise(
            F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0)))
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + mean * weight) / (F.col("n") + weight))
    return out.select("host", "n", *(f"{r}_rate" for r in failed))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_limit: float = 0.5, min_words: int = 10, repeat_pct: int = 20,
          broadcast_hosts: int = 100_000, salts: int = 64) -> DataFrame:
    """(id, the six measures, base_failed, host_rejected, kept) for each row.
    ``kept``: the base rules hold and the host isn't rejected; a host is
    rejected if any rule's shrunk rate exceeds ``host_limit``."""
    failed = rules(min_words, repeat_pct)
    # checkpoint(): three jobs read the measures, and the texts are read once.
    measured = materialize(measure(docs, id_col, text_col, host_col))
    rates = host_rates(measured, failed)
    bad = materialize(rates.where(reduce(Column.__or__, (F.col(f"{r}_rate") > host_limit for r in failed))).select(
        "host", F.lit(True).alias("host_rejected")))
    if bad.count() <= broadcast_hosts:
        joined = measured.join(F.broadcast(bad), "host", "left")
    else:
        spread = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = measured.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(
            spread, ["host", "_salt"], "left")
    base = failed["few_words"] | failed["repeats"]
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(F.col("id").alias(id_col), *COUNTS, base.alias("base_failed"),
                         rejected.alias("host_rejected"), (~base & ~rejected).alias("kept"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all their columns. Rows with
    the same id and text share a verdict per host, so the join is on id; of ids
    used for several texts, a row stays if its own measures pass."""
    d = docs.select(F.struct(F.col(id_col).alias("a"), F.xxhash64(text_col).alias("b"), F.col(host_col).alias("c")).alias("key"),
                    F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    a, b, c = fresh(docs, "_a", "_b", "_c")
    keys = judge(d, "key", "text", "host", **options).where("kept").select(
        F.col("key.a").alias(a), F.col("key.b").alias(b), F.col("key.c").alias(c)).distinct()
    return docs.join(keys, F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(text_col) == F.col(b))
                     & F.col(host_col).eqNullSafe(F.col(c)), "left_semi")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_RULES_SQL = """
    n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeats,
    100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup_lines"""


def _rate_sql(rule: str) -> str:
    mean = f"(sum({rule}_f) OVER () / sum(n) OVER ())"
    var = f"greatest(sum({rule}_f::DOUBLE * {rule}_f / n) OVER () / sum(n) OVER () - {mean} * {mean}, 0.0)"
    weight = (f"CASE WHEN {var} <= {mean} * (1 - {mean}) / 1000001.0 THEN 1000000.0 "
              f"ELSE greatest({mean} * (1 - {mean}) / {var} - 1, 1.0) END")
    return f"({rule}_f + {mean} * {weight}) / (n + {weight}) AS {rule}_rate"


_RULE_NAMES = ("few_words", "repeats", "symbols", "dup_lines")

OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
word AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
gram AS (SELECT r, i, len(ws5) AS k, ws5 FROM (
  SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws5 FROM word)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ws5) AS c FROM gram WHERE k = 5) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS o) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line
        WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, {_RULES_SQL} FROM m),
h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({x}) AS {x}_f" for x in _RULE_NAMES)}
      FROM f WHERE host IS NOT NULL GROUP BY host),
v AS (SELECT host, {", ".join(_rate_sql(x) for x in _RULE_NAMES)} FROM h),
bad AS (SELECT host FROM v WHERE {" OR ".join(f"{x}_rate > 0.5" for x in _RULE_NAMES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, few_words OR repeats AS base_failed,
       bad.host IS NOT NULL AS host_rejected, NOT (few_words OR repeats) AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON f.host = bad.host
"""
