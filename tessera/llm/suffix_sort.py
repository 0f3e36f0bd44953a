"""Difference-cover suffix sorting of one task's share, on arrays."""

from __future__ import annotations

import numpy as np

#: Longest text: names of two thirds of the positions must fit in 21 bits.
MOST = 3_000_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (integers from 1, at most MOST
    of them, below 2**21) in lexicographic order.

    The positions not divisible by three are the sample: their triples are
    sorted and named; if names repeat, the string of names is sorted by
    recursion. The other suffixes are sorted by first character and the rank of
    the sampled suffix after it, and merged: against positions 1 mod 3 by
    (character, rank), against positions 2 mod 3 by (two characters, rank)."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([np.asarray(s, dtype=np.int64), np.zeros(4, dtype=np.int64)])
    # A sampled position at the end where n is 1 mod 3 keeps the two parts of
    # the reduced string apart.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    at = np.concatenate([one, two])
    triple = t[at] << 42 | t[at + 1] << 21 | t[at + 2]
    order = np.argsort(triple)
    new = np.diff(triple[order], prepend=-1) != 0
    name = np.empty(len(at), dtype=np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)
    sample = at[order]
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] << 22 | rank[zero + 1])]
    by_one = sample[sample % 3 == 1]
    by_two = sample[sample % 3 == 2]
    before = np.searchsorted(t[by_one] << 22 | rank[by_one + 1], t[zero] << 22 | rank[zero + 1])
    # Two characters and a rank take more than 63 bits: pairs are named first.
    pair = np.concatenate([t[by_two] << 21 | t[by_two + 1], t[zero] << 21 | t[zero + 1]])
    pair = np.unique(pair, return_inverse=True)[1]
    before += np.searchsorted(pair[:len(by_two)] << 22 | rank[by_two + 2], pair[len(by_two):] << 22 | rank[zero + 2])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[rest] = sample
    return out


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text a mask over its ``length``-byte windows: whether the
    window also starts anywhere else in ``texts``."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = b"\x00".join(texts)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    buf = np.frombuffer(data + b"\x00" * (length + 16), dtype=np.uint8)
    s = buf[:len(data)].astype(np.int64) + 2
    s[(start + size)[:-1]] = 1  # between texts
    n_windows = np.maximum(size - length + 1, 0)
    begins = np.zeros(len(data) + 1, dtype=np.int64)
    some = n_windows > 0
    np.add.at(begins, start[some], 1)
    np.add.at(begins, (start + n_windows)[some], -1)
    is_window = np.cumsum(begins)[:len(data)] > 0
    sa = suffix_array(s)
    sa = sa[is_window[sa]]
    # Adjacent prefixes, eight bytes at a time; only equal pairs go on.
    words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    a, b = sa[:-1], sa[1:]
    for k in [*range(0, length - 8, 8), length - 8]:
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    again = np.zeros(len(data), dtype=bool)
    again[a] = True
    again[b] = True
    return [again[x:x + n] for x, n in zip(start.tolist(), n_windows.tolist())]
