"""The queries themselves on a small folder, against libraries and plain loops."""

import collections
import hashlib
import random

import public_tokenizers as P
import pytest

from tessera.llm import jaccard_join, registry
from .test_dedup import plain_classes
from .test_tokens import LIBRARY, TIKTOKEN


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    documents.write.parquet(f"{path}/documents.parquet")
    return path


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_op1(spark, documents, folder):
    want = sorted((str(r.doc_id), len(t.encode()), n, n > 512) for r in documents.collect() for t in [r.text or ""]
                  for n in [len(LIBRARY.encode(t, add_special_tokens=False))])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, folder, "op1_token_counts")) == want


def test_op3(spark, documents, folder):
    assert P.path("byte_bpe_50k.tiktoken")
    want = sorted((str(r.doc_id), len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for r in documents.collect()
                  for t in [r.text or ""] for i in [TIKTOKEN.encode_ordinary(t)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folder, "op3_bpe")) == want


def test_op4(spark, documents, folder):
    got = run(spark, folder, "op4_jaccard_join")
    assert sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == plain_classes(documents.collect())


def test_op5(spark, documents, folder):
    # Rows of one id and text are documents of their own here: each repeats the other.
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    seen = collections.Counter(t[a:a + 200] for _, t in rows for a in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 199):
            if seen[t[a:a + 200]] > 1:
                gone[a:a + 200] = b"\1" * 200
        starts = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), len(t), sum(gone), starts, sha(bytes(c for c, g in zip(t, gone) if not g))))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, folder, "op5_suffix_dedup")]
    assert sorted(got) == sorted(want)


def test_dense_groups_are_not_split(spark, monkeypatch):
    """A group of near copies leaves the splitting at once; texts that share a
    passage are split on; all links are found."""
    rng, sent = random.Random(12), []
    word = lambda: f"w{rng.randrange(10**7)}"
    base, passage, rows = [word() for _ in range(200)], [word() for _ in range(60)], []
    for i in range(60):
        w = list(base)
        w[rng.randrange(200)] = word()
        rows.append(w)
        rows.append([*passage, *(word() for _ in range(120))])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    split = jaccard_join.split

    def spied(d, sets, large, *rest):
        sent.append({r.rep["id"] % 2 for r in large.join(sets, "sid").select("rep").collect()})
        return split(d, sets, large, *rest)

    monkeypatch.setattr(jaccard_join, "split", spied)
    got = jaccard_join.similar_documents(docs, small=16).collect()
    assert sorted((r.doc_id or -1, r.class_id or 0, r.n_links) for r in got) == sorted(
        (i, c if c > 0 else 0, n) for i, c, n in plain_classes(docs.collect()))
    assert sent and all(0 not in s for s in sent) and 1 in sent[0]
