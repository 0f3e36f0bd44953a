"""N-gram Jaccard self-join by chosen paths (operator 4).

Documents become sets of hashed five-word shingles; equal sets are one class.
In each of several runs, sets are split recursively: in every bucket of a run
each set chooses the tokens whose hash (of bucket and token) is below
``tokens_per_level`` / |set|, and goes to one child bucket per chosen token.
Two sets of similarity s share a chosen token with probability at least
1 - exp(-s * tokens_per_level) a bucket, while dissimilar sets lose each other.
The hash is salted with the bucket, so a pair's buckets choose independently
of each other. Buckets of at most ``small`` sets are compared by brute force;
larger ones are split again, up to ``levels`` times, unless they are dense: of the
buckets of a dense bucket's sets at least three quarters are large, so its sets would
stay together in every run and on every level. The runs are as many as the
target recall needs for pairs at the threshold that stay together on all levels.

What is dense, or still large after the last level, are sets alike in most
tokens. Such buckets that share sets are joined to one, and compared in blocks of about
``block`` sets, each pair of blocks in a task of its own, so groups of any size
are compared whole. A pair that meets in several buckets counts only in the
lowest-numbered common one: each set carries the numbers of its buckets.
Buckets with equal members are compared once. Pairs are never emitted: a
comparison gives each set its number of links and its group within the bucket,
and groups are joined across buckets by distributed label propagation.

Similarity is verified exactly on the sets (9 * shared >= 4 * (|a| + |b|) is
0.8), so there is no false link; a link is missed with probability at most
1 - ``target_recall``, and group membership needs only one path of links.

Defined results: a text of 1-4 words is one shingle; null, empty and wordless
texts have no shingles and are linked to nothing; repeated rows (same id and
text) are one document each and links to each other; an empty table gives an
empty result. Only the id and text are read, other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.names import fresh
from tessera.llm.pieces import byte_batches
from tessera.llm.shingles import mix, shingle_sets
from tessera.llm.steps import settle

BATCH_BYTES = 8 << 20
SMALL = 128
DENSE = 0.75
BLOCK = 512
BLOCK_TOKENS = 1 << 20


def runs_needed(target_recall: float, similarity: float, tokens_per_level: float, levels: int) -> int:
    """Runs after which a pair at the threshold has met with the given
    probability, if it has to stay together on every level. A pair's common
    buckets choose independently, so one run is a branching process."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-similarity * tokens_per_level * meet)
    return math.ceil(math.log(1 - target_recall) / math.log(1 - meet))


def seeds(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def limits(n: np.ndarray, per_level: float) -> np.ndarray:
    """Hashes up to this number are chosen by a set of n tokens."""
    limit = np.minimum(per_level / np.maximum(n, 1), 1.0) * 2.0**64
    return np.where(limit >= 2.0**64, 2.0**64 - 2048, limit).astype(np.uint64) | np.where(n <= per_level, ~np.uint64(0), np.uint64(0))


def numbers(hashes: np.ndarray) -> np.ndarray:
    """The non-negative numbers of the buckets of chosen hashes."""
    return (mix(hashes + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).view(np.int64)


def children(tokens: np.ndarray, of: np.ndarray, per_level: float) -> np.ndarray:
    """The child buckets that a set goes to from the buckets ``of``."""
    salt = mix(of.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))
    limit, width, out = limits(np.array([len(tokens)]), per_level), max(1, (1 << 18) // len(tokens)), []
    for a in range(0, len(salt), width):
        h = mix(tokens[None, :] ^ salt[a:a + width, None])
        out.append(numbers(h[h <= limit]))
    return np.concatenate(out)


def describe(docs: DataFrame, id_col: str, text_col: str, size: int, runs: int, per_level: float) -> DataFrame:
    """(id, k, sid binary, n, first array<long>): each row's set (sid is a
    128-bit digest of the sorted tokens, null for an empty set) and its buckets
    of the first level, those of all runs."""
    id_type = docs.schema[id_col].dataType.simpleString()
    of_run = seeds(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in byte_batches(b.column(2).to_pylist(), BATCH_BYTES):
                tokens, start = shingle_sets(texts, size)
                n = np.diff(start)
                owner = np.repeat(np.arange(len(texts)), n)
                limit = limits(n, per_level)[owner]
                who, first = [], []
                for s in of_run:
                    h = mix(tokens ^ s)
                    x = np.flatnonzero(h <= limit)
                    who.append(owner[x])
                    first.append(numbers(h[x]))
                who, first = np.concatenate(who), np.concatenate(first)
                order = np.argsort(who, kind="stable")
                cuts = np.searchsorted(who[order], np.arange(len(texts) + 1)).astype(np.int32)
                sid = [hashlib.blake2b(tokens[start[k]:start[k + 1]].tobytes(), digest_size=16).digest() if n[k] else None
                       for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(sid, pa.binary()),
                     pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(first[order], pa.int64()))],
                    names=["id", "k", "sid", "n", "first"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), text_col).mapInArrow(
        run, f"id {id_type}, k long, sid binary, n long, first array<bigint>")


def bucket_number(*path: Column) -> Column:
    """A non-negative number of a bucket."""
    return F.shiftrightunsigned(F.xxhash64(*path), 1)


def split(docs: DataFrame, sets: DataFrame, large: DataFrame, size: int, per_level: float) -> DataFrame:
    """(bucket, sid, t): the child buckets of ``large``, t of them for a set. The sets
    are made again, from one text each. ``docs``: (id, k, t)."""
    of = large.groupBy("sid").agg(F.collect_list("bucket").alias("of"))
    wanted = settle(of.join(sets.select("sid", "rep"), "sid").select(F.col("rep.id").alias("_id"), F.col("rep.k").alias("_k"), "sid", "of"))
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["_id"]) & (docs["k"] == wanted["_k"])).select("sid", "of", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in byte_batches(b.column(2).to_pylist(), BATCH_BYTES):
                t, start = shingle_sets(part, size)
                below = [children(t[start[k]:start[k + 1]], np.array(b.column(1)[at + k].as_py(), dtype=np.int64), per_level)
                         for k in range(len(part))]
                which = np.repeat(np.arange(at, at + len(part)), [len(x) for x in below])
                t = np.repeat([len(x) for x in below], [len(x) for x in below]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(below), pa.int64()), b.column(0).take(pa.array(which)), pa.array(t)], names=["bucket", "sid", "t"])
                at += len(part)

    # Rows of one id and text are copies with the same children.
    return texts.mapInArrow(run, "bucket long, sid binary, t int").distinct()


def density(large: DataFrame) -> DataFrame:
    """(bucket, dense): whether most buckets of a large bucket's sets are large:
    its sets are alike in most tokens, and go on together however they are split.
    ``large``: (bucket, sid, t)."""
    share = large.groupBy("sid").agg((F.count("*") / F.max("t")).alias("share"))
    return large.join(share, "sid").groupBy("bucket").agg((F.avg("share") >= DENSE).alias("dense"))


def buckets(docs: DataFrame, sets: DataFrame, levels: int, small: int, size: int, per_level: float) -> tuple[DataFrame, DataFrame | None]:
    """(bucket, sid) of the small leaf buckets, and of those that are dense or
    still large after the last level (None if there are none); buckets of one set
    are gone. A pair that shares a dense bucket has met: it is not split further."""
    members = sets.select("sid", F.size("first").alias("t"), F.explode("first").alias("bucket"))
    leaves = whole = None
    for level in range(levels):
        # Counted with partial sums; only members of buckets of two or more go on.
        sizes = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        shared = settle(members.join(sizes, "bucket"))
        few = shared.where(F.col("m") <= small).select("bucket", "sid")
        leaves = few if leaves is None else leaves.unionByName(few)
        large = shared.where(F.col("m") > small).select("bucket", "sid", "t")
        if not large.limit(1).count():
            break
        if level < levels - 1:
            large = settle(large.join(density(large), "bucket"))
            members = settle(split(docs, sets, large.where("NOT dense").select("bucket", "sid"), size, per_level))
            large = large.where("dense")
        large = large.select("bucket", "sid")
        whole = large if whole is None else whole.unionByName(large)
    if whole is None or not whole.limit(1).count():
        return leaves, None
    return leaves, whole


def distinct_buckets(members: DataFrame) -> DataFrame:
    """Of buckets with equal members only the lowest-numbered."""
    sig = members.groupBy("bucket").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"))
    return members.join(sig.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) of every vertex of ``edges``: root is the smallest vertex of
    its connected component. Each round takes the smallest label among a vertex
    and its neighbours, then the label of that label."""
    e = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both)
    label = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(label, both["b"] == label["v"]).groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label["v"] == near["a"], "left").select(
            "v", F.col("root").alias("was"), F.coalesce(F.least("root", "m"), F.col("root")).alias("root"))
        up = label.select(F.col("v").alias("p"), F.col("root").alias("pr"))
        new = settle(step.join(up, step["root"] == up["p"], "left").select(
            "v", "was", F.coalesce(F.least("root", "pr"), F.col("root")).alias("root")))
        label = new.select("v", "root")
        if new.where("was <> root").limit(1).count() == 0:
            return label


def compare(side: np.ndarray, across: bool, own: list, tokens: list, number: int, mult: np.ndarray, num: int, den: int):
    """Links of the sets of one unit. side: block of each set (0 or 1); across:
    only pairs of both sides count (a unit of two blocks, one of which may be
    empty); own: bucket numbers of each set, below ``number`` another bucket
    counts the pair. Returns (links, group)."""
    m = len(tokens)
    size = np.array([len(t) for t in tokens], dtype=np.int64)

    def common(lists) -> np.ndarray:
        """Shared elements of every two lists (each without repeats)."""
        flat = np.concatenate(lists)
        who = np.repeat(np.arange(m), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        first = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
        name = np.cumsum(first) - 1
        often = (np.bincount(name) > 1)[name] if len(name) else np.zeros(0, bool)
        name, who = np.unique(name[often], return_inverse=True)[1], who[often]
        out = np.zeros((m, m), dtype=np.float32)
        top = int(name.max()) + 1 if len(name) else 0
        width = max(1, (8 << 20) // m)  # columns at a time: 32 MB
        for a in range(0, top, width):
            lo, hi = np.searchsorted(name, (a, a + width))
            x = np.zeros((m, min(width, top - a)), dtype=np.float32)
            x[who[lo:hi], name[lo:hi] - a] = 1
            out += x @ x.T
        return out

    link = common(tokens) * (num + den) >= num * (size[:, None] + size[None, :])
    np.fill_diagonal(link, False)
    if across:
        link &= side[:, None] != side[None, :]
    group = np.arange(m)
    while True:
        low = np.minimum(group, np.where(link, group[None, :], m).min(axis=1))
        if (low == group).all():
            break
        group = low
    mine = link
    before = [x[x < number] for x in own]
    if any(map(len, before)) and link.any():
        mine = link & (common(before) == 0)
    return (mine * mult[None, :]).sum(axis=1), group


def links(docs: DataFrame, reps: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """(sid, links, root): for each set in a bucket, the weighted number of its
    links owned there, and the smallest set of its group there. ``docs``: (id,
    k, t); ``reps``: (sid, id, k, n, mult) with one document for each set."""
    num, den = Fraction(similarity).limit_denominator(1000).as_integer_ratio()
    # Large buckets go in blocks: a set meets every block of its bucket once.
    blocks = members.join(reps.select("sid", "n"), "sid").groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    own = members.join(blocks, "bucket").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks"))).alias("own"))
    # The sets are made again, from one text each and only where compared.
    wanted = settle(own.join(reps, "sid").select(F.col("id").alias("_id"), F.col("k").alias("_k"), "sid", "mult", "own"))
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["_id"]) & (docs["k"] == wanted["_k"])).select("sid", "mult", "own", "t")

    def rows_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "g1", "g2", "g", "sid", "mult", "own", "tokens"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        held, size_held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for b in batches:
            at = 0
            for run in byte_batches(b.column(3).to_pylist(), BATCH_BYTES):
                t, start = shingle_sets(run, size)
                for k in range(len(run)):
                    sid, mult, own = (b.column(c)[at + k].as_py() for c in range(3))
                    body, of = t[start[k]:start[k + 1]].tobytes(), [x["bucket"] for x in own]
                    for x in own:
                        g = int.from_bytes(sid[:8], "little") % x["blocks"]
                        for o in range(x["blocks"]):
                            held.append((x["bucket"], min(g, o), max(g, o), g, sid, mult, of, body))
                            size_held += len(body) + 8 * len(of)
                            if size_held > BATCH_BYTES:
                                yield flush()
                                held, size_held = [], 0
                at += len(run)
        if held:
            yield flush()

    # Rows of one id and text are copies: any one of them will do.
    rows = texts.mapInArrow(rows_of_units, "bucket long, g1 int, g2 int, g int, sid binary, mult long, own array<bigint>, tokens binary")
    rows = rows.repartition("bucket", "g1", "g2").sortWithinPartitions("bucket", "g1", "g2", "sid")

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(unit, held) -> pa.RecordBatch:
            side = np.array([r[0] != unit[1] for r in held])
            n, group = compare(side, unit[1] != unit[2], [np.array(r[3], dtype=np.int64) for r in held],
                               [np.frombuffer(r[4], dtype=np.uint64) for r in held], unit[0],
                               np.array([r[2] for r in held], dtype=np.int64), num, den)
            low = {}
            for g, r in zip(group.tolist(), held):
                low[g] = min(low.get(g, r[1]), r[1])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in held], pa.binary()), pa.array(n, pa.int64()),
                 pa.array([low[g] for g in group.tolist()], pa.binary())], names=["sid", "links", "root"])

        def pairs(unit, held) -> bool:
            """If the unit has any: two blocks need sets on both sides."""
            return len(held) > 1 and (unit[1] == unit[2] or len({r[0] for r in held}) > 1)

        unit, held = None, []
        for b in batches:
            for bucket, g1, g2, *r in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, g1, g2) != unit:
                    if pairs(unit, held):
                        yield one(unit, held)
                    unit, held = (bucket, g1, g2), []
                if not held or held[-1][1] != r[1]:
                    held.append(r)
        if pairs(unit, held):
            yield one(unit, held)

    return rows.mapInArrow(brute, "sid binary, links long, root binary")


def linked(docs: DataFrame, id_col: str, text_col: str, size: int = 5, similarity: float = 0.8,
           target_recall: float = 0.9999, tokens_per_level: float = 2.0, levels: int = 3, small: int = SMALL) -> DataFrame:
    """One row for each row of ``docs``: (id, k, root, class_id, n_links).
    ``root`` is the component that links connect, null without a set;
    ``class_id`` its lowest id, null if no document of it has one."""
    runs = runs_needed(target_recall, similarity, tokens_per_level, levels)
    rows = settle(describe(docs, id_col, text_col, size, runs, tokens_per_level))
    sets = settle(rows.where("sid IS NOT NULL").groupBy("sid").agg(
        F.first("first").alias("first"), F.first("n").alias("n"), F.count("*").alias("mult"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k")).alias("rep")))
    # From here on only the sets need their buckets.
    rows = settle(rows.select("id", "k", "sid"))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    few, large = buckets(d, sets, levels, small, size, tokens_per_level)
    if large is not None:
        # Large buckets that share sets become one, numbered below zero.
        low = large.groupBy("bucket").agg(F.min("sid").alias("b"))
        root = components(large.join(low, "bucket").select(F.col("sid").alias("a"), "b"))
        dense = root.select((-F.lit(1) - bucket_number(F.col("root"))).alias("bucket"), F.col("v").alias("sid"))
        few = few.unionByName(dense)
    members = settle(distinct_buckets(few.distinct()))
    reps = settle(sets.select("sid", "rep.id", "rep.k", "n", "mult"))
    del sets, few, large
    found = settle(links(d, reps, members, size, similarity))
    group = components(found.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("sid").agg(F.sum("links").alias("links"))
    full = reps.select("sid", "id", "mult").join(count, "sid", "left").join(
        group.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    full = settle(full)
    lowest = full.groupBy("root").agg(F.min("id").alias("class_id"))
    full = full.join(lowest, "root").select("sid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    return rows.join(full, "sid", "left").select("id", "k", "root", "class_id", "n_links")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: (id, k, class_id, n_links). ``k`` is
    the text's hash, ``class_id`` the lowest id among the documents that links
    connect with this one (its own if there are none), ``n_links`` the number
    of other documents of at least the similarity. Options as in ``linked``."""
    return linked(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col), "k", F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component exactly one
    row stays, that of the lowest id (null ids last; of several texts with that
    id, the lowest text hash; of several rows with that text, any). Rows without
    a word are linked to nothing and all stay. An id says nothing about the
    component: unrelated texts that share one stay side by side."""
    s = linked(docs, id_col, text_col, **options)
    i, k = fresh(docs, "_id", "_k")
    # Equal id and text are in one component; they are counted with partial sums.
    texts = s.where("root IS NOT NULL").groupBy("root", "id", "k").agg(F.count("*").alias("m"))
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k", "m")).alias("f")).select(
        "f.id", "f.k", (F.col("f.m") > 1).alias("copies"))
    wordless = s.where("root IS NULL").select("id", "k", F.lit(False).alias("copies")).distinct()
    keys = settle(first.unionByName(wordless).select(F.col("id").alias(i), F.col("k").alias(k), "copies"))
    on = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k))
    out = docs.join(keys.where("NOT copies").drop("copies"), on, "left_semi")
    copies = keys.where("copies").drop("copies")
    if copies.limit(1).count():
        out = out.unionByName(docs.join(copies, on, "left_semi").dropDuplicates([id_col, text_col]))
    return out


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).select("doc_id", "class_id", "n_links")
