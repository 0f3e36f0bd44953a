"""Source divergence audit by in-mapper stripes (operator 12): how far the
vocabulary of each source of a language stands from each other source's, and
which terms set it apart from its language.

Each task folds whole documents into a hash table of stripes: (language, term) ->
(document frequency, count for each source). A table that has grown to
``STRIPE_CELLS`` cells is spilled: its stripes are sent out, one row each, and the
table begins anew. Stripes of one key are merged by key: dealt by (language,
term), their cells are summed within the partition; no key gets more stripes than
there are tasks and spills. Merged stripes of at least ``min_docs`` documents are
kept, and written.

The kept stripes give every group (language, source) its number of tokens, and
each language its vocabulary size V. Those headers, one row a language and tile
of ``TILE`` sources, join the stripes, and each task turns its stripes straight
into divergences: sums for every two sources, and the ten best terms a group among
its stripes. Sums and best terms meet once more by group.

All arithmetic is exact in 64 bits: p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
f = floor((p - q)^2 / (p + q)); the quotient is made in three steps of 10^3, so
counts may go up to 9 * 10^15.

Defined results: null text, language and source read as ''; a group whose
documents have no term is reported like any other (count 0); a language without
kept terms has the value 0 for each two of its sources and no term rows; repeated
rows and ids are documents of their own; ties rank by the item's UTF-8 bytes; an
empty table gives an empty result. Only text, language and source are read, other
columns cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.steps import settle

MIN_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS = 3  # of 10^3
STRIPE_CELLS = 300_000
STRIPE_BYTES = 16 << 20
TILE = 128
ROWS = 256
BROADCAST_GROUPS = 100_000

# The characters of a term (all above 0x7F, a-z once A-Z are lower-cased).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8: every byte of a character above 0x7F is
    itself above 0x7F."""
    return text.encode().translate(_TABLE).split()


def folded(docs: DataFrame, text_col: str, lang_col: str, source_col: str, stripe_cells: int = STRIPE_CELLS) -> DataFrame:
    """(lang, term, df, cells array<struct<source, n>>): the stripes of each task."""
    cell = pa.struct([("source", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By language and term: the counts by source, and under None the document frequency.
        langs: dict[str, dict[bytes, dict[str | None, int]]] = defaultdict(dict)
        cells = size = 0

        def spill() -> Iterator[pa.RecordBatch]:
            rows = [(lang, term, s.pop(None), s) for lang, stripes in langs.items() for term, s in stripes.items()]
            for a in range(0, len(rows), 20_000):
                part = rows[a:a + 20_000]
                flat = pa.StructArray.from_arrays(
                    [pa.array([x for r in part for x in r[3]], pa.string()), pa.array([n for r in part for n in r[3].values()], pa.int64())],
                    fields=list(cell))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.string()), pa.array([r[1].decode() for r in part], pa.string()),
                     pa.array([r[2] for r in part], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r[3]) for r in part])], pa.int32()), flat)],
                    names=["lang", "term", "df", "cells"])

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                stripes = langs[lang]
                for term, n in Counter(terms(text)).items():
                    s = stripes.get(term)
                    if s is None:
                        stripes[term] = s = {None: 0}
                        size += len(term)
                    s[None] += 1
                    if source in s:
                        s[source] += n
                    else:
                        s[source] = n
                        cells += 1
                if cells > stripe_cells or size > STRIPE_BYTES:
                    yield from spill()
                    langs.clear()
                    cells = size = 0
        yield from spill()

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(blank(text_col), blank(lang_col), blank(source_col)).mapInArrow(
        run, "lang string, term string, df long, cells array<struct<source: string, n: long>>")


def merged(stripes: DataFrame) -> DataFrame:
    """(lang, term, df, cells): one stripe a key. Dealt by (lang, term) once;
    the sums by cell and the gathering of a key's cells need no further exchange."""
    dealt = stripes.repartition("lang", "term")
    # The document frequency rides on a stripe's first cell.
    cells = dealt.select("lang", "term", "df", F.posexplode("cells").alias("i", "cell")).select(
        "lang", "term", F.when(F.col("i") == 0, F.col("df")).otherwise(F.lit(0)).alias("df"), "cell.source", "cell.n")
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return cells.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))


def headers(kept: DataFrame, docs: DataFrame, lang_col: str, source_col: str, tile: int = TILE) -> DataFrame:
    """(lang, tile, v, n_lang, names, ns): every source of the language, in order,
    and its tokens; one row for each tile of sources."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source")).distinct()
    tokens = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    g = groups.join(tokens, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("g"))
    g = g.join(size, "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.col("g.source").alias("names"), F.col("g.n").alias("ns"),
        F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_lang"))
    return g.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / F.lit(tile)).cast("int"))))


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exact: long division by thousands."""
    d = n + 2 * v
    whole, rest = np.divmod(count + 2, d)
    for _ in range(SCALE_STEPS):
        q, rest = np.divmod(rest * 1000, d)
        whole = whole * 1000 + q
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergences(stripes: DataFrame, width: int = TILE) -> DataFrame:
    """Two kinds of rows from stripes with their headers: (lang, source, sums
    array<long>), the part of a task in the sums against each source of the
    language; (lang, source, term, value), the best terms among a task's stripes.
    Rows come sorted by language and tile."""
    names = ["lang", "source", "sums", "term", "value"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, held, acc, best = None, None, [], None, {}

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        def add() -> None:
            nonlocal acc
            place, ns, v, n_lang, lo, hi = head
            m = np.zeros((len(held), len(ns)), dtype=np.int64)
            r = [k for k, (_, cells) in enumerate(held) for _ in cells]
            m[r, [place[c["source"]] for _, cells in held for c in cells]] = [c["n"] for _, cells in held for c in cells]
            p = shares(m, ns[None, :], v)
            for s in range(lo, hi):
                acc[s - lo] += distance(p[:, s:s + 1], p).sum(axis=0)
            if lo == 0:  # once for each stripe
                q = shares(m.sum(axis=1), np.int64(n_lang), v)[:, None]
                f = np.where((m > 0) & (p > q), distance(p, q), -1)
                for s in np.flatnonzero((f >= 0).any(axis=0)).tolist():
                    at = np.flatnonzero(f[:, s] >= 0)
                    more = [(-int(f[k, s]), held[k][0].encode()) for k in at]
                    best[s] = sorted(best.get(s, []) + more)[:TOP_TERMS]
            held.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            order, lo, hi = list(head[0]), head[4], head[5]
            for s in range(lo, hi):
                yield rows([(key[0], order[s], acc[s - lo].tolist(), None, None)])
            out = [(key[0], order[s], None, t.decode(), -f) for s, x in best.items() for f, t in x]
            if out:
                yield rows(out)

        for b in batches:
            lang, tile, term, cells, v, n_lang, order, ns = (c for c in b.columns)
            langs, tiles, term, cells = lang.to_pylist(), tile.to_pylist(), term.to_pylist(), cells.to_pylist()
            for k in range(b.num_rows):
                if (langs[k], tiles[k]) != key:
                    if key is not None:
                        yield from finish()
                    key, best = (langs[k], tiles[k]), {}
                    place = {x: j for j, x in enumerate(order[k].as_py())}
                    lo, hi = tiles[k] * width, min(tiles[k] * width + width, len(place))
                    head = (place, np.array(ns[k].as_py(), dtype=np.int64), v[k].as_py(), n_lang[k].as_py(), lo, hi)
                    acc = np.zeros((hi - lo, len(place)), dtype=np.int64)
                held.append((term[k], cells[k]))
                if len(held) == ROWS:
                    add()
        if key is not None:
            yield from finish()

    cols = stripes.select("lang", "tile", "term", "cells", "v", "n_lang", "names", "ns").sortWithinPartitions("lang", "tile")
    return cols.mapInArrow(run, "lang string, source string, sums array<bigint>, term string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS, stripe_cells: int = STRIPE_CELLS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank). part 'pair': item is each other
    source of the language; part 'term': the ``top`` (ten at most) terms that
    the source uses more than its language does."""
    if not 0 < top <= TOP_TERMS:
        raise ValueError(f"top must be 1 to {TOP_TERMS}")
    kept = settle(merged(folded(docs, text_col, lang_col, source_col, stripe_cells)).where(F.col("df") >= min_docs))
    head = settle(headers(kept, docs, lang_col, source_col, tile))
    # A header holds one entry a group: counted, then broadcast while they are few.
    entries = head.agg(F.sum(F.size("names"))).first()[0] or 0
    found = settle(divergences(kept.join(F.broadcast(head) if entries <= BROADCAST_GROUPS else head, "lang"), tile))
    names = head.where("tile = 0").select("lang", "names")
    sums = found.where("sums IS NOT NULL").select("lang", "source", F.posexplode("sums").alias("at", "value")).groupBy(
        "lang", "source", "at").agg(F.sum("value").alias("value"))
    # Every two sources of a language, also where there is no term.
    slots = names.select("lang", F.explode("names").alias("source"), "names").select(
        "lang", "source", F.posexplode("names").alias("at", "item")).where("source <> item")
    pair = slots.join(sums, ["lang", "source", "at"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    term = found.where("term IS NOT NULL").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pair.unionByName(term).withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
ng AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(c) AS n FROM cl GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(ng.n, 0) + 2 * v.v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN ng USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (cl.c + 2)) // (nl.n + 2 * v.v) AS q FROM cl JOIN nl USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pair.value, 0) AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
