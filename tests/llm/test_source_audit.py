"""Operator 12 against a count of every term, group and pair."""

import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import source_audit

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_docs, top=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    count, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        w = re.findall(source_audit.TERM, text.translate(upper))
        count.update((lang, source, t) for t in w)
        docs.update((lang, t) for t in set(w))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        v = len(kept)
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}

        def p(c, total, v=v):
            return 1 + 10**9 * (c + 2) // (total + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pair = [(sum(f(p(count[lang, s, t], n[s]), p(count[lang, o, t], n[o])) for t in kept), o) for o in sources - {s}]
            term = []
            for t in kept:
                q = p(sum(count[lang, o, t] for o in sources), sum(n.values()))
                if count[lang, s, t] and p(count[lang, s, t], n[s]) > q:
                    term.append((f(p(count[lang, s, t], n[s]), q), t))
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items)}
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["The", "the", "ÉTÉ", "été", "zürich", "a", "x9y", "don't", "日本語", "𝒳", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou")]
    rows = [(" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(0, 60))),
             rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "S3", None, "", "é"])) for _ in range(400)]
    rows += [rows[0]] * 30 + [(None, "en", "s9"), ("", "fr", "s1"), (None, "fr", None), ("rare words only", "fr", "s2"), (None, None, None),
                              ("long " * 30000, "en", "s1"), ("1 2 3 \n\t", "en", "none")]
    return rows


def frame(spark, rows):
    wide = [(i, t, g, s, None, 0, "x", 1, 2) for i, (t, g, s) in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n int, df int, term string, cells int, tile int")


@pytest.mark.parametrize("options", [{}, {"stripe_cells": 40, "tile": 2}])
def test_against_counting(spark, texts, options):
    docs = frame(spark, texts).repartition(6)
    got = source_audit.audit(docs, min_docs=10, **options)
    assert got.columns == COLUMNS
    got = [tuple(r) for r in got.collect()]
    want = plain(texts, 10)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[0] == "fr" for r in got) == 6  # three groups without a kept term


def test_spilled_stripes_keep_their_counts(spark, texts):
    docs = frame(spark, texts).coalesce(2)
    few, many = (source_audit.folded(docs, "text", "lang", "source", n) for n in (10**6, 30))
    assert many.count() > few.count()
    same = [{(r.lang, r.term): (r.df, sorted((c.source, c.n) for c in r.cells)) for r in source_audit.merged(x).collect()} for x in (few, many)]
    assert same[0] == same[1]


def test_long_division():
    rng = random.Random(1)
    cases = [(c, n, v) for n in (0, 5, 10**6, 10**13) for v in (1, 7, 10**6) for c in (0, rng.randrange(n + 1), n)]
    for c, n, v in cases:
        assert source_audit.shares(np.array([c]), np.array([n]), v)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_empty_table(spark):
    assert source_audit.audit(frame(spark, [])).collect() == []


def test_query(spark, texts, tmp_path):
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in source_audit.op12_source_divergence(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(plain(texts, 10))
