"""Substring dedup by relative Lempel-Ziv parsing (operator 11): every word in a
window of ``length`` words that also starts earlier is removed.

The reference is the whole corpus, cut into blocks so that equal windows share
one, and each text is factored against the blocks that can hold a match:

1. Each window belongs to the smallest hash of its ``gram``-word grams.
   Neighbouring windows of one smallest hash are a run: a short row (hash,
   digest of its words, document, place). Equal windows have equal hashes, so
   hashes of one run only (and not twice in it) go.
2. Of runs with equal words only the earliest is parsed; the others are factors as
   a whole.
3. Run texts are dealt by hash. A task gathers whole classes to blocks of about
   ``share`` words, in document order, indexes all windows of the block by their
   hash, and parses each text greedily against what stands before it: at a window
   whose earliest place in the index lies before, the factor extends as far as
   the words agree; otherwise one word is a literal. Factors shorter than a
   window don't count. After a factor, the windows across its boundary, the
   first that it doesn't hold, are looked up in turn, so none is missed.
4. A class of over ``share`` words (a frequent gram amid ever other words) is
   dealt anew the same way by longer grams, at last by whole windows, where
   a class is one window.
5. Factors return to their documents, their words are cut.

Hot keys: a hash or run text that holds more than a thousandth of the rows is
one of fewer than a thousand, so these are broadcast and their rows stay where
they are; all other keys meet by shuffled joins. Steps are written to the
shared checkpoint folder; each drops what it no longer needs.

Order of documents: by id, null first, then by the text's hash. Words are
compared by 64-bit hash, run texts by 128 bits of two hashes.

Defined results: a null text has no words; texts shorter than a window lose
nothing; rows of equal id and text are one document and equal results; rows of one
id and other texts are documents of their own; an empty table gives an empty
result. Only the id and text are read, other columns cannot clash. Long texts are
hashed in blocks.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import byte_batches
from tessera.llm.shingles import BASE, mix, span_hashes
from tessera.llm.steps import Scratch, settle
from tessera.llm.suffix_dedup import merged, often_smallest, sliding

LENGTH = 20
GRAMS = (6, 13, 20)
BATCH_BYTES = 8 << 20
BLOCK = 1 << 20
LONGEST_RUN = 512
SHARE = 1_000_000
HOT_KEYS = 1000
INVERSE = pow(BASE, -1, 1 << 64)


def word_hashes(bodies: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each body). A body is a text, of which words
    are what ASCII white space leaves, or the bytes of word hashes."""
    if bodies and isinstance(bodies[0], bytes):
        return np.frombuffer(b"".join(bodies), dtype=np.uint64), np.array([len(b) // 8 for b in bodies], dtype=np.int64)
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in (t.encode().split() for t in bodies)]
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    ids = np.concatenate(words) if words else np.zeros(0, np.int64)
    return table[ids], np.fromiter(map(len, words), np.int64, len(words))


def digests(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the values h[a:b] each, from running sums."""
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(h), BASE, dtype=np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(h), INVERSE, dtype=np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum(mix(h) * up[:-1])]
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def runs(h: np.ndarray, count: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(body, first window, windows, hash, digest, whether the hash may stand
    twice near it) of the runs of bodies of ``count`` words each."""
    out = []
    end = np.cumsum(count)
    width = length - gram + 1
    for a in range(0, len(h) - length + 1, BLOCK):
        part = h[a:a + BLOCK + length - 1]
        g = span_hashes(part, gram)
        m = sliding(np.minimum, g, width)
        often = often_smallest(g, m, width)
        at = a + np.arange(len(m))
        body = np.searchsorted(end, at, side="right")
        ok = at + length <= end[body]
        at, body, m = at[ok], body[ok], m[ok]
        if not len(at):
            continue
        head = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (body[1:] != body[:-1]) | (at[1:] != at[:-1] + 1)])
        n = np.diff(np.r_[head, len(at)])
        # Very long runs (periodic text) in pieces.
        pieces = -(-n // LONGEST_RUN)
        which = np.repeat(np.arange(len(head)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = head[which] + k * LONGEST_RUN
        n = np.minimum(n[which] - k * LONGEST_RUN, LONGEST_RUN)
        d = digests(part, at[first] - a, at[first] - a + n + length - 1)
        out.append((body[first], at[first] - (end - count)[body[first]], n, m[first], d, np.isin(m[first], often)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


def run_rows(bodies: DataFrame, gram: int, length: int) -> DataFrame:
    """(h, d, id, k, base, at, n, often) of the runs of (id, k, base, body): a
    body's words stand in its document from ``base`` on, ``at`` counts from the
    document's first."""
    id_type = bodies.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in byte_batches(b.column(3).to_pylist(), BATCH_BYTES):
                h, count = word_hashes(part)
                body, first, n, m, d, often = runs(h, count, gram, length)
                ids, k, base = (b.column(c).slice(at, len(part)) for c in range(3))
                to = pa.array(body.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(d.view(np.int64)), ids.take(to), k.take(to), base.take(to),
                     pa.array(first + base.to_numpy()[body] if len(body) else first), pa.array(n.astype(np.int32)), pa.array(often.astype(bool))],
                    names=["h", "d", "id", "k", "base", "at", "n", "often"])
                at += len(part)

    return bodies.select("id", "k", "base", "body").mapInArrow(
        run, f"h long, d long, id {id_type}, k long, base long, at long, n int, often boolean")


def meet(left: DataFrame, right: DataFrame, key: list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and, as ``c``, the
    number of its rows in ``left``; ``total`` is the number of all. Keys of more
    than a thousandth of the rows are fewer than a thousand: broadcast."""
    hot = F.col("c") * HOT_KEYS > total
    few = F.broadcast(right.where(hot))
    rest = left.join(few.select(*key), key, "left_anti").join(right.where(~hot), key)
    return left.join(few, key).unionByName(rest)


def cut_out(bodies: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, id, k, at, large, words binary): the word hashes of the run texts that
    ``wanted`` (h, id, k, at, base, n, large) asks for."""
    id_type = bodies.schema["id"].dataType.simpleString()
    asked = wanted.groupBy("id", "k", "base").agg(F.collect_list(F.struct("at", "n", "h", "large")).alias("runs")).select(
        F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("base").alias("_base"), "runs")
    on = bodies["id"].eqNullSafe(asked["_id"]) & (bodies["k"] == asked["_k"]) & (bodies["base"] == asked["_base"])
    j = bodies.join(asked, on).select("id", "k", "base", "body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows of a document: the join has brought them together
        for b in batches:
            mine = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            new = [j for j, key in enumerate(mine) if key not in seen and not seen.add(key)]
            b = b.take(pa.array(new, pa.int64()))
            at = 0
            for part in byte_batches(b.column(3).to_pylist(), BATCH_BYTES):
                h, count = word_hashes(part)
                start = np.cumsum(count) - count
                rows, which = [], []
                for j, (base, asked) in enumerate(zip(b.column(2).slice(at, len(part)).to_pylist(), b.column(4).slice(at, len(part)).to_pylist())):
                    for r in asked:
                        a = int(start[j]) + r["at"] - base
                        rows.append((r["h"], r["at"], r["large"], h[a:a + r["n"] + length - 1].tobytes()))
                        which.append(at + j)
                to = pa.array(which, pa.int64())
                hs, ats, large, words = zip(*rows) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hs, pa.int64()), b.column(0).take(to), b.column(1).take(to), pa.array(ats, pa.int64()),
                     pa.array(large, pa.bool_()), pa.array(words, pa.binary())], names=["h", "id", "k", "at", "large", "words"])
                at += len(part)

    return j.mapInArrow(run, f"h long, id {id_type}, k long, at long, large boolean, words binary")


def sources(words: np.ndarray, at: np.ndarray, length: int, exact: bool = False) -> np.ndarray:
    """The index of a block: for every place, where its window stands first; the
    place itself where no window starts. ``at``: the places of windows."""
    src = np.arange(len(words))
    if exact:
        name = np.unique(np.lib.stride_tricks.sliding_window_view(words, length)[at], axis=0, return_inverse=True)[1].ravel()
    else:
        name = span_hashes(words, length)[at]
    order = np.argsort(name, kind="stable")
    head = np.r_[True, name[order][1:] != name[order][:-1]]
    src[at[order]] = at[order][head][np.cumsum(head) - 1]
    return src


def factors(words: np.ndarray, size: np.ndarray, length: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of the factors of at least ``length``
    words of texts of ``size`` words that stand one after another in ``words``."""
    end = np.cumsum(size)
    start = end - size
    text = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(words)) + length <= end[text]) if len(words) else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    src = sources(words, at, length, exact)
    cur, stop, out = start.copy(), end - length, []
    active = np.flatnonzero(cur <= stop)
    while len(active):
        here = cur[active]
        hit = src[here] < here
        cur[active[~hit]] += 1
        who, c, s = active[hit], here[hit], src[here[hit]]
        n, room = np.zeros(len(who), np.int64), np.minimum(end[who] - c, end[text[s]] - s)
        go = np.arange(len(who))
        while len(go):
            go = go[n[go] < room[go]]
            go = go[words[c[go] + n[go]] == words[s[go] + n[go]]]
            n[go] += 1
        if (n < length).any():  # two windows with one hash
            return factors(words, size, length, True)
        out.append((who, c - start[who], c - start[who] + n))
        cur[who] = c + n - length + 1
        active = active[cur[active] <= stop[active]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def parsed(texts: DataFrame, length: int, share: int) -> DataFrame:
    """(id, k, start, end): the factors of the run texts, block by block."""
    id_type = texts.schema["id"].dataType.simpleString()
    rows = texts.select("h", "id", "k", "at", "words").repartition("h").sortWithinPartitions("h", "id", "k", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parse(block) -> pa.RecordBatch:
            words = np.frombuffer(b"".join(x[3] for x in block), dtype=np.uint64)
            who, a, z = factors(words, np.array([len(x[3]) // 8 for x in block], dtype=np.int64), length)
            at = np.array([x[2] for x in block], dtype=np.int64)[who]
            who = who.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([block[j][0] for j in who], id_arrow), pa.array([block[j][1] for j in who], pa.int64()),
                 pa.array(at + a), pa.array(at + z)], names=["id", "k", "start", "end"])

        block, size, last, place, id_arrow = [], 0, None, None, pa.null()
        for b in batches:
            id_arrow = b.column(1).type
            for h, i, k, at, words in zip(*(c.to_pylist() for c in b.columns)):
                if h != last:  # only between classes
                    if size > share:
                        yield parse(block)
                        block, size = [], 0
                    last, place = h, None
                if place != (i, k, at):  # repeated rows of a document
                    block.append((i, k, at, words))
                    size += len(words) // 8
                    place = (i, k, at)
        if block:
            yield parse(block)

    return rows.mapInArrow(run, f"id {id_type}, k long, start long, end long")


def repeats(bodies: DataFrame, scratch: Scratch, length: int, grams: tuple[int, ...], share: int) -> DataFrame:
    """(id, k, start, end): ranges of words that together cover the windows of
    ``bodies`` that also start earlier. Stored."""
    level, key = f"{len(grams)}", ["h", "d", "n"]
    rows = scratch.keep(run_rows(bodies, grams[0], length), f"runs{level}")
    classes = scratch.keep(rows.groupBy("h").agg(F.count("*").alias("c"), F.max("often").alias("often")).where(
        (F.col("c") > 1) | F.col("often")).select("h", "c"), f"classes{level}")
    shared = scratch.keep(meet(rows, classes, ["h"], rows.count()).drop("c"), f"shared{level}")
    scratch.drop(f"runs{level}", f"classes{level}")
    texts = scratch.keep(shared.groupBy(*key).agg(
        F.min(F.struct("id", "k", "at", "base")).alias("first"), F.count("*").alias("c"), F.max("often").alias("often")), f"texts{level}")
    # Copies of a run text are factors as a whole, but for the first.
    copies = meet(shared, texts.where("c > 1").select(*key, "c", "first"), key, shared.count())
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k") == F.col("first.k")) & (F.col("at") == F.col("first.at"))
    found = copies.where(~same).select("id", "k", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("end"))
    # To be parsed: classes of several texts, or of one that may hold a window twice.
    last = len(grams) == 1  # a class is one window: none is large
    large = F.sum(F.col("n") + (length - 1)) > (2**62 if last else share)
    sizes = texts.groupBy("h").agg(F.count("*").alias("c"), F.max("often").alias("often"), large.alias("large")).where(
        (F.col("c") > 1) | F.col("often")).select("h", "c", "large")
    wanted = scratch.keep(meet(texts.select(*key, "first"), scratch.keep(sizes, f"sizes{level}"), ["h"], texts.count()).select(
        "h", "d", "n", "first.*", "large"), f"wanted{level}")
    cut = cut_out(bodies, wanted, length)
    if wanted.where("large").limit(1).count():
        cut = scratch.keep(cut, f"cut{level}")
        again = cut.where("large").dropDuplicates(["id", "k", "at"]).select(
            "id", "k", F.col("at").alias("base"), F.col("words").alias("body"))
        found = found.unionByName(repeats(scratch.keep(again, f"again{level}"), scratch, length, grams[1:], share))
    found = scratch.keep(found.unionByName(parsed(cut.where("NOT large"), length, share)), f"found{level}")
    scratch.drop(*(f"{name}{level}" for name in ("shared", "texts", "sizes", "wanted", "cut", "again")))
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   grams: tuple[int, ...] = GRAMS, share: int = SHARE) -> DataFrame:
    """(id, n_words, removed array<array<long>>, kept) for each row of ``docs``:
    the maximal ranges of removed words, and the kept words joined by one space."""
    if grams[-1] != length or list(grams) != sorted(set(grams)):
        raise ValueError("grams must rise to length")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), F.lit(0).cast("long").alias("base"), text.alias("body"))
    with Scratch(docs.sparkSession) as scratch:
        found = repeats(d, scratch, length, grams, share)
        spans = settle(found.groupBy("id", "k").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select(
            F.col("id").alias("_id"), F.col("k").alias("_k"), "spans"))
    j = d.join(spans, d["id"].eqNullSafe(spans["_id"]) & (d["k"] == spans["_k"]), "left").select("id", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = t.encode().split()
                gone = merged([(x["start"], x["end"]) for x in spans or ()])
                edges = [0, *(e for ab in gone for e in ab), len(w)]
                n.append(len(w))
                removed.append(gone)
                kept.append(b" ".join(x for a, z in zip(edges[::2], edges[1::2]) for x in w[a:z]).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())],
                names=["id", "n_words", "removed", "kept"])

    return j.mapInArrow(run, f"id {id_type}, n_words long, removed array<array<long>>, kept string").withColumnRenamed("id", id_col)


def op11_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
