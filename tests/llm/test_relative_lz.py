"""Operator 11 against a scan of every window in document order."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import relative_lz


def removed(words, order, length=20):
    seen, out = set(), {}
    for d in order:
        gone, w = set(), words[d]
        for a in range(len(w) - length + 1):
            window = tuple(w[a:a + length])
            if window in seen:
                gone.update(range(a, a + length))
            seen.add(window)
        out[d] = gone
    return out


def check(spark, docs, rows, **options):
    """``rows``: [(id, text, hash)]"""
    length = options.get("length", 20)
    words = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    order = sorted({(i, t): h for i, t, h in rows}.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    gone = removed(words, [d for d, _ in order], length)
    want = sorted(repr((i, len(words[i, t]), len(gone[i, t]), " ".join(w for k, w in enumerate(words[i, t]) if k not in gone[i, t])))
                  for i, t, _ in rows)
    got = relative_lz.remove_repeats(docs, **options).collect()
    assert sorted(repr((r.doc_id, r.n_words, sum(b - a for a, b in r.removed), r.kept)) for r in got) == want
    for r in got:
        assert all(a < b for a, b in r.removed) and all(x[1] < y[0] for x, y in zip(r.removed, r.removed[1:]))
    return sum(map(len, gone.values()))


def hashed(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()]


@pytest.mark.parametrize("options", [{}, {"share": 100}, {"share": 60, "length": 8, "grams": (2, 5, 8)}])
def test_hard_cases(spark, documents, options):
    assert check(spark, documents, hashed(documents), **options) > 1000


@pytest.mark.parametrize("share", [relative_lz.SHARE, 300])
def test_frequent_grams(spark, share):
    """A gram amid ever other words, few words, periodic texts, passages that
    overlap, and repeats within one document."""
    rng = random.Random(3)
    gram = [f"g{i}" for i in range(7)]
    rows = []
    for i in range(60):
        own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append(own(9) + gram + own(20))
    rows += [[rng.choice("ab") for _ in range(400)] for _ in range(4)] + [["x"] * n for n in (19, 20, 21, 40, 2000)] + [["x", "y"] * 300]
    base = [f"b{i}" for i in range(300)]
    for i in range(40):
        a = rng.randrange(250)
        rows.append([f"u{i}"] * 3 + base[a:a + rng.randrange(15, 50)] + [f"v{i}"] + base[:rng.randrange(10, 40)] + base[100:130] * 2)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").repartition(7)
    assert check(spark, docs, hashed(docs), share=share) > 1000


def test_exact_index_agrees():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 3000).astype(np.uint64)
    size = np.array([0, 1, 300, 7, 2692])
    a, b = (relative_lz.factors(words, size, 7, e) for e in (False, True))
    assert all((x == y).all() for x, y in zip(a, b))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, h int, words int, spans int")
    assert relative_lz.remove_repeats(docs).collect() == []


def test_query(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = relative_lz.op11_relative_lz(spark, str(tmp_path)).collect()
    want = relative_lz.remove_repeats(documents).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (str(r.doc_id), r.n_words, sum(b - a for a, b in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in want)
