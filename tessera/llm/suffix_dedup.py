"""Suffix-array deduplication (operator 5): every byte in a ``length``-byte string
that also starts anywhere else is removed.

The suffix sorting is dealt out so that equal strings meet:

1. Each ``length``-byte window belongs to the smallest hash among its ``GRAMS[0]``-byte
   grams. Neighbouring windows of one smallest hash are a run; runs are short
   rows (hash, document, place). Equal windows have equal hashes, so only
   hashes that occur in two runs or twice in one can hold repeats; all else is
   dropped here, about three quarters of ordinary text.
2. The texts of the remaining runs (windows overlapping by length - 1 bytes)
   are cut out, equal ones of a batch sent once, and dealt by hash.
3. A task gathers whole hash classes to shares of at most ``SHARE`` bytes and sorts
   the suffixes of a share by the difference-cover algorithm (``suffix_sort``):
   sampled triples are sorted and named, names recursed on, the remaining suffixes
   merged; then adjacent prefixes are compared. A run text that occurs twice
   is repeated as a whole.
4. Classes of more than ``HOT`` bytes, which a single task should not sort, are
   dealt anew the same way: their distinct run texts are the documents of another
   round with longer grams, at last the windows themselves, where a class is one window.
5. Repeated windows return to their documents, their bytes are cut.

Stages 1, 2, and 3 end in checkpoints. Nothing grows with a group in one
task: classes are bounded by HOT, documents are one row each.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose
nothing; rows with equal id and text are copies of each other; an empty table
gives an empty result. Only the id and text are read, other columns cannot
clash. Long texts are hashed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import byte_batches
from tessera.llm.shingles import span_hashes
from tessera.llm.steps import Scratch, release, settle
from tessera.llm.suffix_sort import repeated_windows

LENGTH = 200
GRAMS = (32, 96)
BLOCK = 1 << 21
LONGEST_RUN = 4096
#: Where grams are whole windows a class is one window: shorter runs bound it.
LONGEST_LAST = 512
SHARE = 2_900_000
HOT = 1_400_000


def raw(t: str | bytes) -> bytes:
    return t if isinstance(t, bytes) else t.encode()


def sliding(best: np.ufunc, h: np.ndarray, width: int) -> np.ndarray:
    """The best (np.minimum or np.maximum) of each ``width`` consecutive
    values: of what a block of that width ends with and the next begins with."""
    n = len(h)
    g = np.concatenate([h, np.full(-n % width, h[-1], dtype=h.dtype)]).reshape(-1, width)
    up = best.accumulate(g, axis=1).ravel()
    down = best.accumulate(g[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(down[:n - width + 1], up[width - 1:n])


def often_smallest(h: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """The hashes that are the smallest of a window at two places or more."""
    edge = np.zeros(width - 1, dtype=np.uint64)
    values = np.sort(h[sliding(np.maximum, np.concatenate([edge, m, edge]), width) == h])
    return values[1:][values[1:] == values[:-1]]


def runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, hash, whether a repeat could lie within the run
    or near it: the hash stands at two places) of the runs of all texts."""
    out = []
    data = b"".join(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end = np.cumsum(size)
    buf = np.frombuffer(data, dtype=np.uint8)
    for a in range(0, len(data) - length + 1, BLOCK):
        part = buf[a:a + BLOCK + length - 1]
        width = length - gram + 1
        h = span_hashes(part.astype(np.uint64) + np.uint64(1), gram)
        m = sliding(np.minimum, h, width)
        often = often_smallest(h, m, width)
        at = a + np.arange(len(m))
        text = np.searchsorted(end, at, side="right")
        ok = at + length <= end[text]
        at, text, m = at[ok], text[ok], m[ok]
        if not len(at):
            continue
        head = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
        n = np.diff(np.r_[head, len(at)])
        # Very long runs (periodic text) in pieces.
        longest = LONGEST_RUN if gram < length else LONGEST_LAST
        pieces = -(-n // longest)
        which = np.repeat(np.arange(len(head)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = head[which] + k * longest
        n = np.minimum(n[which] - k * longest, longest)
        out.append((text[first], at[first] - (end - size)[text[first]], n, m[first], np.isin(m[first], often)))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, rid, at, n, often): the runs of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, at = b.column(0).to_numpy(zero_copy_only=False), 0
            for texts in byte_batches(b.column(1).to_pylist(), BLOCK):
                text, first, n, h, often = runs([raw(t) for t in texts], length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(rid[at:at + len(texts)][text]), pa.array(first),
                     pa.array(n.astype(np.int32)), pa.array(often.astype(bool))], names=["h", "rid", "at", "n", "often"])
                at += len(texts)

    return docs.select("rid", "t").mapInArrow(run, "h long, rid long, at long, n int, often boolean")


def shared_runs(rows: DataFrame, length: int, hot: int) -> DataFrame:
    """(rid, runs array<struct<at, n, h, hot>>): the runs whose hash may hold
    repeats. (A ``rid`` is a hash of the document; should two documents share
    it, each is offered the other's runs, which are only looked at.)"""
    classes = rows.groupBy("h").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.max("often").alias("often")).where(
        (F.col("c") > 1) | F.col("often")).select(
        "h", (F.col("w") + F.col("c") * (length - 1) > hot).alias("hot"))
    return rows.join(classes, "h").groupBy("rid").agg(F.collect_set(F.struct("at", "n", "h", "hot")).alias("runs"))


def cut_out(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds: places (id, k, at, ctx) of run texts, and run texts (h,
    ctx, body, c, hot), once for each batch with their number in it. ctx is a
    128-bit digest."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, k long, at long, ctx binary, h long, body binary, c int, hot boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_arrow = None
        for b in batches:
            id_arrow = id_arrow or b.column(0).type
            ids, ks, ats, ctxs, first = [], [], [], [], {}
            for i, k, t, rs in zip(*(c.to_pylist() for c in b.columns)):
                data = raw(t)
                for r in rs:
                    body = data[r["at"]:r["at"] + r["n"] + length - 1]
                    if len(body) < length:
                        continue
                    ctx = hashlib.blake2b(body, digest_size=16).digest()
                    ids.append(i)
                    ks.append(k)
                    ats.append(r["at"])
                    ctxs.append(ctx)
                    if ctx in first:
                        first[ctx][2] += 1
                    else:
                        first[ctx] = [r["h"], body, 1, r["hot"]]
            kinds = [id_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.bool_()]
            names = ["id", "k", "at", "ctx", "h", "body", "c", "hot"]

            def batch(n, **cols):
                return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

            yield batch(len(ids), id=ids, k=ks, at=ats, ctx=ctxs)
            yield batch(len(first), ctx=list(first), **{c: [x[j] for x in first.values()] for j, c in enumerate(("h", "body", "c", "hot"))})

    j = docs.join(found, "rid").select("id", "k", "t", "runs")
    return j.mapInArrow(run, schema)


def stretches(mask: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the true stretches of a mask."""
    d = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return (d - np.tile([0, 1], len(d) // 2)).tolist()


def sorted_masks(bodies: DataFrame, length: int) -> DataFrame:
    """(ctx, again array<int>): the stretches of repeated windows of each run text,
    from the suffix arrays of shares of whole classes."""
    rows = bodies.repartition("h").sortWithinPartitions("h", "ctx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(share) -> pa.RecordBatch:
            masks = repeated_windows([x[1] for x in share], length)
            out = [(x[0], stretches(np.ones(len(m), bool) if x[2] > 1 else m)) for x, m in zip(share, masks)]
            out = [x for x in out if x[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], names=["ctx", "again"])

        def whole(group) -> pa.RecordBatch:
            """Of a class of one run text that occurs twice nothing is to be sorted."""
            return pa.RecordBatch.from_arrays(
                [pa.array([group[0][0]], pa.binary()), pa.array([[0, len(group[0][1]) - length]], pa.list_(pa.int32()))], names=["ctx", "again"])

        share, size, group, held = [], 0, [], 0  # group: the class being read
        last = None
        for b in batches:
            for h, ctx, body, c in zip(*(x.to_pylist() for x in b.columns)):
                if h != last:
                    if len(group) == 1 and group[0][2] > 1:
                        yield whole(group)
                    else:
                        if size + held > SHARE and share:
                            yield sort(share)
                            share, size = [], 0
                        share += group
                        size += held
                    group, held, last = [], 0, h
                if group and group[-1][0] == ctx:
                    group[-1][2] += c
                else:
                    group.append([ctx, body, c])
                    held += len(body) + 1
        if len(group) == 1 and group[0][2] > 1:
            yield whole(group)
            group, held = [], 0
        if size + held > SHARE and share:
            yield sort(share)
            share = []
        share += group
        if share:
            yield sort(share)

    return rows.select("h", "ctx", "body", "c").mapInArrow(run, "ctx binary, again array<int>")


def hot_masks(bodies: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """(ctx, again array<int>) of the run texts (ctx, body, c) of hot classes, which
    are the documents of a round with longer grams."""
    texts = settle(bodies.groupBy("ctx").agg(F.first("body").alias("body"), F.sum("c").alias("c")))
    spans = duplicate_spans(texts, "ctx", "body", length, grams)
    last = lambda s: (s["end"] - length).cast("int")
    once = spans.select(F.col("id").alias("ctx"), F.flatten(F.transform("spans", lambda s: F.array(s["start"].cast("int"), last(s)))).alias("again"))
    whole = texts.where("c > 1").select("ctx", F.array(F.lit(0), F.octet_length("body") - length).alias("again"))
    return once.join(whole.select("ctx"), "ctx", "left_anti").unionByName(whole)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    grams: tuple[int, ...] | None = None) -> DataFrame:
    """(id, k, spans array<struct<start long, end long>>): for each document with
    repeated strings the byte ranges that they cover, unmerged. k: the text's hash."""
    if grams is None:
        if length < GRAMS[0]:
            raise ValueError(f"length must be at least {GRAMS[0]}")
        grams = (*(g for g in GRAMS if g < length), length)
    d = keyed(docs, id_col, text_col).where(F.octet_length("t") >= length)
    hot = HOT if len(grams) > 1 else 1 << 62
    with Scratch(docs.sparkSession) as scratch:  # the runs are read twice, the texts once
        found = settle(shared_runs(scratch.keep(run_rows(d, length, grams[0]), "runs"), length, hot))
    cut = settle(cut_out(d, found, length))
    bodies = cut.where("body IS NOT NULL")
    masks = sorted_masks(bodies.where("NOT hot").select("h", "ctx", "body", "c"), length)
    if bodies.where("hot").limit(1).count():
        masks = masks.unionByName(hot_masks(bodies.where("hot").select("ctx", "body", "c"), length, grams[1:]))
    masks = settle(masks)
    places = cut.where("at IS NOT NULL").select("id", "k", "at", "ctx").join(masks, "ctx")
    spans = F.transform(F.sequence(F.lit(0), F.size("again") - 2, F.lit(2)), lambda i: F.struct(
        (F.col("at") + F.get("again", i)).alias("start"), (F.col("at") + F.get("again", i + 1) + length).alias("end")))
    return places.select("id", "k", spans.alias("s")).groupBy("id", "k").agg(F.flatten(F.collect_set("s")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit("").cast(docs.schema[text_col].dataType))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("k"), F.xxhash64(id_col, t).alias("rid"), t.alias("t"))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, removed array<array<long>> maximal byte ranges, kept
    binary) for each row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = settle(duplicate_spans(docs, id_col, text_col, length))
    release(docs.sparkSession)
    d = keyed(docs, id_col, text_col)
    s = spans.select(F.col("id").alias("sid"), F.col("k").alias("sk"), "spans")
    j = d.join(s, d["id"].eqNullSafe(s["sid"]) & (d["k"] == s["sk"]), "left").select("id", "t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = t.encode()
                gone = merged([(x["start"], x["end"]) for x in spans or ()])
                edges = [0, *(e for ab in gone for e in ab), len(data)]
                n.append(len(data))
                removed.append(gone)
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "removed", "kept"])

    return j.mapInArrow(run, f"id {id_type}, n_bytes long, removed array<array<long>>, kept binary").withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
