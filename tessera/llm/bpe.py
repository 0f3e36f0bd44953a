"""Byte-level BPE encoding and decoding (operator 3) by merge replay.

The corpus is encoded block by block (about ``block_bytes`` of text, taken from
the input partitions). For the distinct words of a block, all words lie in one
symbol array with neighbour links, and an inverted index maps each mergeable
token pair to its positions. Merges are replayed in rank order: the positions
of the lowest pending rank are merged at once, and only the pairs of the
touched neighbours are entered anew. A word's tokens do not depend on any other
word, so the index may be dealt over blocks: every block replays the merges
that occur in it, nothing is shuffled, and a lost task repeats its blocks.

Words are the matches of the pre-tokenisation pattern. Texts are first cut at
safe boundaries (``pieces``) and the pattern runs once per distinct piece.

Rank order within a word is what counts: a new pair may rank below the merge
that made it. Pending ranks stand in a heap, so such a pair comes next; a word
in which it arises while the same round merges several places of that word is
encoded again on its own, one merge at a time (``encode_word``).

Defined results: a null text is encoded as empty (no ids, hash of no bytes);
repeated rows give repeated rows; an empty table gives an empty result; a word
of any length is one run in the array. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.pieces import byte_batches, number

BLOCK_BYTES = 32 << 20
RUN_BYTES = 8 << 20
NONE = np.int64(1) << 60


class Merges:
    """The rank file as arrays: ``rank_of_pair`` for token ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.of_byte < 0).any():
            raise ValueError("the rank file must hold all 256 single bytes")
        # Every way to write a token as two tokens is a mergeable pair.
        keys, made = [], []
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (= id) of the token that the pair makes; NONE if there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], NONE)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word on its own: merge the leftmost pair of lowest rank until none
    is left (a heap of pairs with links; stale entries are skipped)."""
    n = len(word)
    part = [word[i:i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = nxt[i] if part[i] is not None else n
        if j >= n or ranks.get(part[i] + part[j]) != r:
            continue
        part[i] += part[j]
        part[j] = None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (q := ranks.get(part[i] + part[nxt[i]])) is not None:
                heapq.heappush(heap, (q, i))
        if prv[i] >= 0 and (q := ranks.get(part[prv[i]] + part[i])) is not None:
            heapq.heappush(heap, (q, prv[i]))
    return [ranks[p] for p in part if p is not None]


def gather(flat: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` (run k is flat[start[k]:start[k + 1]]) one
    after the other, and where each begins (with the end as last entry)."""
    size = start[which + 1] - start[which]
    to = np.r_[0, np.cumsum(size)]
    return flat[np.arange(to[-1]) + np.repeat(start[which] - to[:-1], size)], to


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words (non-empty byte strings), one word after the
    other, and where each word begins (with the end as last entry)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size)
    sym = merges.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(sym)
    word = np.repeat(np.arange(len(words), dtype=np.int64), size)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    nxt[end - 1] = n                      # n and -1 stand for "no neighbour"
    prv = np.arange(-1, n - 1, dtype=np.int64)
    prv[end - size] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        """Add positions to the inverted index under their pair's rank."""
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, p in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut)):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(p)

    first = np.flatnonzero(nxt < n)
    rank = merges.rank(sym[first], sym[first + 1])
    enter(first[rank < NONE], rank[rank < NONE])
    alone: set[int] = set()
    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r)
        at = np.sort(np.concatenate(at) if len(at) > 1 else at[0])
        at = at[np.r_[True, at[1:] != at[:-1]]]
        at = at[(sym[at] >= 0) & (nxt[at] < n)]
        if len(at):
            at = at[merges.rank(sym[at], sym[nxt[at]]) == r]
        if not len(at):
            continue
        # In a chain of overlapping places (a a a a) every second one merges.
        follows = np.r_[False, nxt[at[:-1]] == at[1:]]
        if follows.any():
            k = np.arange(len(at))
            start = np.maximum.accumulate(np.where(follows, 0, k))
            at = at[(k - start) % 2 == 0]
        right = nxt[at]
        sym[at] = r
        sym[right] = -1
        nxt[at] = nxt[right]
        has = nxt[at] < n
        prv[nxt[at][has]] = at[has]
        left = prv[at]
        left = left[left >= 0]
        touched = np.concatenate([left, at[has]])
        if not len(touched):
            continue
        rank = merges.rank(sym[touched], sym[nxt[touched]])
        ok = rank < NONE
        touched, rank = touched[ok], rank[ok]
        if (rank < r).any():
            alone.update(word[touched[rank < r]].tolist())
        enter(touched, rank)
    live = sym >= 0
    ids = sym[live]
    start = np.searchsorted(word[live], np.arange(len(words) + 1))
    if alone:
        own = [encode_word(words[w], merges.ranks) if w in alone else ids[start[w]:start[w + 1]]
               for w in range(len(words))]
        ids = np.concatenate(own).astype(np.int64)
        start = np.r_[0, np.cumsum([len(x) for x in own])]
    return ids, start


class Block:
    """A run of texts, encoded. ``of_text``: for each text its pieces as
    numbers; piece k has the ids ``ids[start[k]:start[k + 1]]``."""

    def __init__(self, texts: list[str], merges: Merges, pattern):
        place: dict[bytes, int] = {}
        self.of_text = []
        for run in byte_batches(texts, RUN_BYTES):
            found, of_text = number(run)
            at = np.fromiter([place.setdefault(p, len(place)) for p in found], dtype=np.int32, count=len(found))
            self.of_text += [at[x] for x in of_text]
        word: dict[str, int] = defaultdict(itertools.count().__next__)
        of_piece, size = [], []
        for p in map(bytes.decode, place):
            # Letters alone, or a space and letters, are one word (ASCII, where
            # no two versions of the letter property differ).
            ws = (p,) if p.isascii() and (p.isalpha() or p[0] == " " and p[1:].isalpha()) else pattern.findall(p)
            size.append(len(ws))
            of_piece.extend(map(word.__getitem__, ws))
        ids, start = replay([w.encode() for w in word], merges)
        ids, at = gather(ids, start, np.array(of_piece, dtype=np.int64))
        self.ids, self.start = ids, at[np.r_[0, np.cumsum(size)].astype(np.int64)]

    def of(self, k: int) -> np.ndarray:
        """Ids of text k."""
        return gather(self.ids, self.start, self.of_text[k])[0]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, ids array<int>) for each row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a block makes millions of objects and no cycles
        merges, words = Merges(ranks_path), regex.compile(pattern)
        for b in batches:
            at = 0
            for texts in byte_batches(b.column(1).to_pylist(), block_bytes):
                block = Block(texts, merges, words)
                rows = [block.of(k).astype(np.int32) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(rows, pa.list_(pa.int32()))], names=[id_col, "ids"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for each row; null ids decode to no bytes."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Merges(ranks_path).token
        for b in batches:
            out = [b"".join([token[i] for i in ids or ()]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, decoded binary")


def written_and_decoded(block: Block, merges: Merges) -> tuple[list[str], list[bytes]]:
    """Each piece's ids in decimal, joined by spaces, and its ids decoded."""
    ids, start = block.ids.tolist(), block.start.tolist()
    runs = [ids[a:b] for a, b in zip(start, start[1:])]
    return [" ".join(map(str, x)) for x in runs], [b"".join(map(merges.token.__getitem__, x)) for x in runs]


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) for each row of
    ``docs``: encodes each text, writes its ids in decimal and decodes them,
    in the same pass. A piece's ids are written out and decoded once a run."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # a block makes millions of objects and no cycles
        merges, words = Merges(ranks_path), regex.compile(pattern)
        for b in batches:
            at = 0
            for texts in byte_batches(b.column(1).to_pylist(), block_bytes):
                block = Block(texts, merges, words)
                says, back = written_and_decoded(block, merges)
                n, written, decoded = [], [], []
                for ps in block.of_text:
                    n.append(int((block.start[ps + 1] - block.start[ps]).sum()))
                    ps = ps.tolist()
                    written.append(hashlib.sha256(" ".join(map(says.__getitem__, ps)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(back.__getitem__, ps))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(written), pa.array(decoded)],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
