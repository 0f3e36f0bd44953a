"""The corpus pipeline stage by stage on its own input."""

import collections
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessera.llm import quality_rules
from tessera.llm.shingles import WORD
from .test_dedup import plain_line_dedup
from .test_rules import plain_hits
from .test_tokens import RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL AND doc_id <> 7").dropDuplicates(["doc_id", "text"])
    passage = docs.where("doc_id = 18").first().text.split("\n")[1]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, passage), (2, "no such words here at all, none of them")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        seen.append((docs.collect(), spark.read.parquet(str(tmp_path / str(k))).collect()))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in quality_rules.judge(spark.read.parquet(str(tmp_path / "documents.parquet"))).where("kept").collect()}
    assert {r.doc_id for r in seen[0][1]} == kept and kept
    want = {i: t for (i, _), t in plain_line_dedup(seen[1][0], 4, 100).items()}
    before = {r.doc_id: r.text for r in seen[1][0]}
    want = {i: t for i, t in want.items() if t == before[i] or t.split()}
    assert {r.doc_id: r.text for r in seen[1][1]} == want
    assert all(r.n_chars == len(r.text) for r in seen[1][1] if r.text != before[r.doc_id])
    ids = [r.doc_id for r in seen[2][1]]
    assert set(ids) <= set(want) and 6 in ids and not set(ids) & set(range(7, 18))  # the group of near copies
    clean = {r.doc_id for r in seen[3][0] if not plain_hits(r.text, items)[1]}
    assert {r.doc_id for r in seen[3][1]} == clean and len(clean) < len(seen[3][0])
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen[4][1]) == sorted(
        (r.doc_id, len(i), sha(" ".join(map(str, i)).encode()), sha(r.text.encode())) for r in seen[4][0] for i in [enc.encode_ordinary(r.text)])
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, seen[4][1]))


def test_near_duplicates_of_all_rows(spark, documents):
    """The stage on the whole fixture (null ids, an id of two texts, repeated
    rows): one row of each component, all rows without a word."""
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.collect()
    tokens = []
    for r in rows:
        w = WORD.findall((r.text or "").lower())
        tokens.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for i, a in enumerate(tokens):
        for j, b in enumerate(tokens[:i]):
            if a and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                group = [group[j] if g == group[i] else g for g in group]
    want = collections.Counter()
    for g in set(group):
        same = [rows[i].doc_id for i in range(len(rows)) if group[i] == g]
        want[min((i is None, i or 0) for i in same)] += 1
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in got) == want
    assert {r.text for r in got if r.doc_id == 7} == {"other text of id seven"} and sum(r.doc_id is None for r in got) == 2


def test_all_rows_go_through(spark, documents, tmp_path):
    """The pipeline on the unfiltered fixture."""
    documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words here at all, none of them")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    ids = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert ids[6] == 1 and max(n for i, n in ids.items() if i is not None) == 1 and not set(ids) & set(range(8, 18))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
