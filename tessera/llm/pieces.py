"""Cutting text where a byte-level BPE pre-tokeniser always cuts as well.

A cut stands before a space or line feed whose preceding character is not white
space. No alternative of the pre-tokenisation pattern matches a non-space
followed by a space, and none looks behind, so the tokens of a text are the
tokens of its pieces in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pieces of up to this many bytes are compared as 64-bit words.
WIDE = 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def cuts(buf: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes ``buf`` of texts that begin at
    ``text_start``. The preceding character counts as a non-space if it is
    ASCII 0x21-0x7E, or starts with a lead byte under which no code point of
    the property White_Space lies; others are never cut after."""
    at = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    at = at[at > 0]
    before = buf[at - 1]
    ok = (before > 0x20) & (before < 0x7F)
    high = np.flatnonzero(before >= 0x80)
    if len(high):
        p = at[high]
        two, three, four = (buf[np.maximum(p - k, 0)] for k in (2, 3, 4))
        ok[high] = (((two >= 0xC3) & (two <= 0xDF)) | ((three == 0xE3) & (two != 0x80))
                    | ((three >= 0xE4) & (three <= 0xEF)) | ((three == 0xE0)) | ((four >= 0xF0) & (four <= 0xF4)))
    mark = np.zeros(len(buf) + 1, dtype=bool)
    mark[at[ok]] = True
    mark[text_start] = True
    return np.flatnonzero(mark[:len(buf)])


def distinct(data: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces among data[start:end], and for each piece its place
    in that list. Equal words are found by hash and compared in full."""
    size = end - start
    number = np.zeros(len(start), dtype=np.int64)
    found: list[bytes] = []
    short = np.flatnonzero(size <= WIDE)
    rest = np.flatnonzero(size > WIDE)
    if len(short):
        padded = np.concatenate([buf, np.zeros(WIDE + 8, dtype=np.uint8)])
        word_at = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        words, h = [], np.zeros(len(short), dtype=np.uint64)
        for k in range(0, WIDE, 8):
            left = np.clip(size[short] - k, 0, 8)
            w = word_at[np.minimum(start[short] + k, len(word_at) - 1)]
            w = np.where(left == 8, w, w & ((np.uint64(1) << (left.astype(np.uint64) * np.uint64(8))) - np.uint64(1)))
            words.append(w)
            h ^= (w + np.uint64(k)) * _FACTORS[k // 8]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        order = np.argsort(h)
        sorted_h = h[order]
        first = np.r_[True, sorted_h[1:] != sorted_h[:-1]]
        group = np.cumsum(first) - 1
        head = order[first]
        if all((w[order] == w[head][group]).all() for w in words):
            number[short[order]] = group
            found = [data[a:b] for a, b in zip(start[short[head]].tolist(), end[short[head]].tolist())]
        else:  # two different pieces with one hash
            rest = np.arange(len(start))
    if len(rest):
        place = {p: k for k, p in enumerate(found)}
        for k, a, b in zip(rest.tolist(), start[rest].tolist(), end[rest].tolist()):
            number[k] = place.setdefault(data[a:b], len(place))
        found = list(place)
    return found, number


def number(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct pieces of ``texts``, and for each text the places of its
    pieces in that list, in order."""
    coded = [t.encode() for t in texts]
    size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    data = b"".join(coded)
    if not data:
        return [], [np.zeros(0, dtype=np.int64) for _ in texts]
    buf = np.frombuffer(data, dtype=np.uint8)
    text_end = np.cumsum(size)
    text_start = text_end - size
    start = cuts(buf, text_start[size > 0])
    found, at = distinct(data, buf, start, np.r_[start[1:], len(buf)])
    return found, [at[a:b] for a, b in zip(np.searchsorted(start, text_start).tolist(),
                                           np.searchsorted(start, text_end).tolist())]


def byte_batches(texts, max_bytes: int) -> Iterator[list[str]]:
    """Consecutive runs of ``texts`` (str or None; None counts as empty) of
    about ``max_bytes`` bytes, or a single longer text."""
    run, total = [], 0
    for t in texts:
        t = t or ""
        n = len(t) if t.isascii() else len(t) + len(t) // 2
        if run and total + n > max_bytes:
            yield run
            run, total = [], 0
        run.append(t)
        total += n
    if run:
        yield run
