"""Sets of hashed word runs (shingles), made for whole runs of texts at once."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of each ``span`` consecutive values, by doubling."""
    n = len(h) - span + 1
    out, done, power, size = np.zeros(n, dtype=np.uint64), 0, h, 1
    while True:
        if span & size:
            out = out * np.uint64(pow(BASE, size, 1 << 64)) + power[done:done + n]
            done += size
        if done == span:
            return mix(out)
        power = power[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
        size *= 2


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, start): text k has the sorted distinct tokens
    tokens[start[k]:start[k + 1]]. A token is the 64-bit hash of ``size``
    consecutive lower-cased words; a text of fewer words has one token of all
    its words, a text without words none."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    words = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in (WORD.findall(t.lower()) for t in texts)]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.concatenate(words) if words else np.zeros(0, np.int64)
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    h = of_word[ids]
    text = np.repeat(np.arange(len(texts)), n)
    tokens, owner = [], []
    if len(ids) >= size:
        t = h[:len(ids) - size + 1].copy()
        for k in range(1, size):
            t = mix(t * np.uint64(0x9E3779B97F4A7C15) + h[k:len(ids) - size + 1 + k])
        whole = text[:len(t)] == text[size - 1:]
        tokens.append(t[whole])
        owner.append(text[:len(t)][whole])
    start = np.r_[0, np.cumsum(n)]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        one = []
        for k in short.tolist():
            t = np.uint64(n[k])
            with np.errstate(over="ignore"):
                for x in h[start[k]:start[k + 1]]:
                    t = mix(t * np.uint64(0x9E3779B97F4A7C15) + x)
            one.append(t)
        tokens.append(np.array(one, dtype=np.uint64))
        owner.append(short)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    first = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
    return tokens[first], np.searchsorted(owner[first], np.arange(len(texts) + 1))
