"""Line, suffix-array and near-duplicate operators against brute force."""

import collections
import random

import numpy as np
import pytest

from tessera.llm import jaccard_join, line_dedup, suffix_dedup, suffix_sort
from tessera.llm.shingles import WORD


def plain_line_dedup(rows, min_lines, min_chars):
    docs = sorted({(r.doc_id, r.text) for r in rows if r.text is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = {d: d[1].split("\n") for d in docs}
    gone = {d: set() for d in docs}
    short = [(n, lambda r: sum(map(len, r)) >= min_chars) for n in range(1, min(min_lines, 4))]
    for size, ok in (*short, (min_lines, lambda r: True)):
        seen = set()
        for d in docs:
            for i in range(len(lines[d]) - size + 1):
                run = tuple(lines[d][i:i + size])
                if ok(run) and run in seen:
                    gone[d].update(range(i, i + size))
                seen.add(run)
    return {d: "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in docs}


def test_short_runs_and_null_ids(spark):
    """Runs of two and three lines that are long in all, among documents
    without an id as well."""
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    texts = [(1, f"x\n{a}\n{b}\n{c}\ny"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\nz"), (4, f"p\n{a}\nq\n{c}"), (5, f"{'d' * 60}\n{'e' * 60}"),
             (6, f"u\n{'d' * 60}\n{'e' * 60}\nv"), (None, "n1\n" + "f" * 120), (None, "n2\n" + "f" * 120), (7, "f" * 120),
             (8, f"{a}\n{b}\n{c}\n{a}\n{b}\n{c}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_removed): r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got[1, 5, 0] and got[2, 3, 3] == "" and got[3, 3, 0] and got[4, 4, 0] and got[5, 2, 0] and got[6, 4, 2] == "u\nv"
    assert got[7, 1, 1] == "" and got[8, 6, 6] == ""
    without = sorted(n for i, _, n in got if i is None)
    assert without == [0, 1]  # one of the two keeps the line


@pytest.mark.parametrize("min_lines", [1, 2, 4, 8])
def test_line_dedup(spark, documents, min_lines):
    # Ids used for two texts with common lines would make the first copy a matter of text hashes.
    docs = documents.where("doc_id IS NULL OR doc_id <> 7 OR text LIKE 'other%'")
    want = plain_line_dedup(docs.collect(), min_lines, 100)
    got = line_dedup.line_dedup(docs, min_lines, 100)
    assert got.columns[:10] == docs.columns
    before = sorted((r.doc_id or -1, r.text or "", want.get((r.doc_id, r.text)) or "") for r in docs.collect())
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((i, t) for i, _, t in before)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    if min_lines == 4:
        kept = line_dedup.line_dedup(docs, drop_empty=True)
        assert kept.where("n_removed > 0 AND NOT text RLIKE '[a-z]'").count() == 0 and kept.where("text IS NULL").count() == 2


def test_suffix_ranks_sort_suffixes(spark):
    texts = ["a\nb\na\nb\nc", "b\na\nb\nc", "a\nb\na", "c\nc\nc\nc\nc\nc", "u"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, last = None, {}
    for depth, r in line_dedup.suffix_ranks(docs):
        rows = r.collect()
        first = first or {(x.id, x.line): x.r for x in rows}
        last |= {(x.id, x.line): x.r for x in rows}
    lines = {i: t.split("\n") for i, t in enumerate(texts)}
    rank = {lines[i][n]: r for (i, n), r in first.items()}
    suffix = {p: [rank[x] for x in lines[p[0]][p[1]:]] for p in last}
    order = sorted(last, key=lambda p: last[p])
    assert [suffix[p] for p in order] == sorted(suffix.values())
    assert all((last[p] == last[q]) == (suffix[p] == suffix[q]) for p in last for q in last)


def test_suffix_array():
    rng = random.Random(2)
    for n in [*range(0, 25)] * 8 + [500]:
        for letters in (1, 2, 5):
            x = np.array([rng.randint(1, letters) for _ in range(n)], dtype=np.int64)
            assert suffix_sort.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("hot,block", [(suffix_dedup.HOT, suffix_dedup.BLOCK), (300, 700)])
def test_suffix_dedup(spark, documents, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    period = "".join(random.Random(3).choice("abcdef") for _ in range(90))
    docs = documents.unionByName(spark.createDataFrame([(900, period * 3, None, None, None, None, None, None, None, None)], documents.schema))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = collections.Counter(t[k:k + 200] for _, t in rows for k in range(len(t) - 199))
    want = []
    for i, t in rows:
        cover = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 199):
            if count[t[k:k + 200]] > 1:
                cover[k:k + 200] = True
        want.append((i or -1, len(t), bytes(np.frombuffer(t, np.uint8)[~cover]), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())))
    got = suffix_dedup.remove_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, bytes(r.kept), len(r.removed)) for r in got) == sorted(want)
    assert suffix_dedup.remove_duplicates(docs.limit(0)).count() == 0


def plain_classes(rows):
    def tokens(t):
        w = WORD.findall((t or "").lower())
        return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    sets = [tokens(r.text) for r in rows]
    links = [[j for j, b in enumerate(sets) if j != i and a and 9 * len(a & b) >= 4 * (len(a) + len(b))] for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j].doc_id for j in seen if rows[j].doc_id is not None]
        out.append((rows[i].doc_id or -1, min(ids) if ids else -1, len(links[i])))
    return sorted(out)


@pytest.mark.parametrize("small,block", [(128, 256), (2, 3)])
def test_jaccard_join(spark, documents, monkeypatch, small, block):
    """With small=2 the group of near copies stays large and goes in blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = documents.collect()
    got = jaccard_join.similar_documents(documents, small=small).collect()
    assert sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == plain_classes(rows)
    assert jaccard_join.similar_documents(documents.limit(0)).count() == 0


def test_keep_one(spark, documents):
    kept = jaccard_join.keep_one(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 6 in ids and not ids & set(range(8, 18)) and {0, 1, 2, 3, 4, 5} <= ids


def test_runs_needed():
    assert jaccard_join.runs_needed(0.9999, 0.8, 2.0, 3) == 8 and jaccard_join.runs_needed(0.9, 0.8, 2.0, 1) == 2


def test_recall_where_every_level_splits():
    """Pairs at the threshold that meet in no small bucket before the last
    level: one run keeps them together as often as runs_needed takes for granted."""
    rng, meet, pairs, n = np.random.default_rng(1), 1.0, 4000, 90
    for _ in range(3):
        meet = 1 - np.exp(-1.6 * meet)
    together = 0
    for _ in range(pairs):
        t = rng.integers(0, 2**64 - 1, n + 10, dtype=np.uint64)
        a, b = t[:n], t[10:]  # 80 of 100 tokens
        of = jaccard_join.seeds(1).view(np.int64) >> 1
        for _ in range(3):
            of = np.intersect1d(jaccard_join.children(a, of, 2.0), jaccard_join.children(b, of, 2.0)) if len(of) else of
        together += len(of) > 0
    assert together / pairs > meet - 0.01
    assert (1 - together / pairs) ** jaccard_join.runs_needed(0.9999, 0.8, 2.0, 3) < 1.2e-4


def test_group_that_splits_on_all_levels(spark):
    """A passage of 60 words in 140 texts, each with a partner of similarity 0.8 or
    a little more: a bucket of the passage holds over 128 sets, and splits."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage, rows = [word() for _ in range(60)], []
    for i in range(140):
        own = [word() for _ in range(40)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:30] + [word() for _ in range(10)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_documents(docs, small=8).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, i - i % 2, 1) for i, _ in rows)


def test_links_of_few_long_sets(spark, monkeypatch):
    """More blocks than sets: a pair of one block counts once, not again beside
    each empty block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 100)
    rng, rows = random.Random(4), []
    for g in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for i in range(3):
            rows.append((3 * g + i, " ".join(base[:290] + [f"v{rng.randrange(10**6)}" for _ in range(i)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_documents(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, i - i % 3, 2) for i, _ in rows)


def test_keep_one_keeps_one_of_each_component(spark):
    """Ids used for unrelated texts, null ids and repeated rows."""
    rng = random.Random(6)
    a, b, c, d, e, f = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(6))
    text = lambda w, *more: " ".join([*w, *more])
    rows = [(1, text(a)), (1, text(b)), (2, text(b, "x")), (None, text(c)), (None, text(d)), (None, text(d, "x")),
            (None, text(e)), (9, text(e)), (8, text(e)), (7, text(f)), (7, text(f)), (7, text(f)), (None, None), (None, ""), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = jaccard_join.keep_one(docs).collect()
    words = collections.Counter((r.doc_id, r.text.split(" ")[0]) for r in kept if r.text)
    assert words == collections.Counter({(1, a[0]): 1, (1, b[0]): 1, (None, c[0]): 1, (None, d[0]): 1, (8, e[0]): 1, (7, f[0]): 1})
    assert sorted(r.n for r in kept if not r.text) == [12, 13, 14, 15]
    got = {r.doc_id: r.class_id for r in jaccard_join.similar_documents(docs.where("n IN (6, 7, 8)")).collect()}
    assert got == {None: 8, 9: 8, 8: 8}
