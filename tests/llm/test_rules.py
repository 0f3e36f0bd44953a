"""Quality rules and decontamination against brute force and SQL."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, quality_rules, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(t):
    words = WORD.findall(t)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, documents):
    docs = documents.unionByName(spark.createDataFrame(
        [(800, "a\x0bb # * <> é|\r\nx", None, None, None, None, None, None, None, None)], documents.schema))
    got = quality_rules.judge(docs).collect()
    want = [plain_measures(r.text or "") for r in docs.collect()]
    assert sorted(tuple(r[m] for m in quality_rules.MEASURES) for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality_rules.judge(documents.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_hosts", [100, 0])
def test_host_verdicts(spark, broadcast_hosts):
    """Host 'bad' fails nearly always; 'new' failed its only document, which the prior outweighs."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "x", f"h{i % 7}") for i in range(700)] + [(1000 + i, "x" if i % 20 else good, "bad") for i in range(60)]
    rows += [(2000, "x", "new"), (2001, good, None), (2002, good, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, broadcast_hosts=broadcast_hosts).collect()}
    assert {r.doc_id for r in got.values() if r.host_rejected} == {i for i, _, h in rows if h == "bad"}
    assert not got[1000].kept and not got[1000].base_failed and not got[2002].kept and got[2001].kept and not got[2000].host_rejected
    rates = {r.host: r for r in quality_rules.host_rates(quality_rules.measure(docs), quality_rules.rules()).collect()}
    assert rates["new"].few_words_rate < 0.6 < rates["bad"].few_words_rate
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def plain_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, t in items:
        b = plain_words(t)
        n = min(len(b), 10)
        grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def contaminated(spark, documents):
    passage = "The quick BROWN fox-jumps over 3 lazy dogs, again and again and over the hill, été naïve"
    items = [(1, passage), (2, "tiny item"), (10, passage + " more"), (3, None), (4, "?!"), (5, "tiny item")]
    extra = [(700, f"Before. {passage.upper()}! After all."), (701, "a Tiny ITEM here, tiny item"), (702, passage[:40]), (703, "tiny\nitem")]
    docs = documents.unionByName(spark.createDataFrame([(*x, "en", "s", 1, None, None, None, None, None) for x in extra], documents.schema))
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_decontamination_scan(contaminated, broadcast):
    docs, bench, items = contaminated
    want = sorted((r.doc_id or -1, *plain_hits(r.text, items)) for r in docs.collect())
    got = decontaminate.scan(docs, bench, broadcast_windows=broadcast).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.hit_at, r.items) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_decontamination_removes(contaminated):
    docs, bench, items = contaminated
    hit = {700, 701, 703}
    whole = decontaminate.remove(docs, bench)
    assert whole.columns == docs.columns and whole.count() == docs.count() - len(hit)
    spans = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, how="spans").collect()}
    # upper() makes É, which stays upper-case: the windows with été miss.
    assert spans[701] == "a  here, " and spans[703] == "" and spans[702] == items[0][1][:40]
    assert "BROWN" not in spans[700] and spans[700] == "Before. , ÉTÉ NAÏVE! After all."
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_sql(spark, contaminated, tmp_path, name):
    docs, bench, _ = contaminated
    # Equal rows tie in SQL's row numbers, and ids with two texts in its order of copies.
    docs.where("doc_id IS NOT NULL AND doc_id <> 7").dropDuplicates(["doc_id", "text"]).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_items_of_all_lengths_and_without_id(spark, documents, broadcast):
    """Items of one to ten words, some without an id: a hit needs no id."""
    w = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    items = [(n, " ".join(w[:n])) for n in range(2, 12)] + [(None, "omega"), (None, None), (None, "alpha beta gamma"), (3, "Omega omega")]
    texts = [" ".join(w[:n]) + " end" for n in range(13)] + ["omega", "x omega OMEGA", "no", None, "alpha " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, broadcast_windows=broadcast)
    want = []
    for i, t in list(enumerate(texts)) * 2:
        n, hit, found = plain_hits(t, items)
        want.append((i, n, hit, [x for x in found if x != "None"]))
    assert sorted((r.doc_id, r.n_words, r.hit_at, r.items) for r in got.collect()) == sorted(want)
    assert any(hit and not found for _, _, hit, found in want)
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())


def test_texts_are_cut_into_words_once(spark, documents, monkeypatch):
    """One tokenising pass, whatever the number of item lengths."""
    bench = spark.createDataFrame([(n, " ".join("abcdefghij"[:n])) for n in range(1, 11)], "item_id long, text string")
    windows = decontaminate.materialize(decontaminate.benchmark_windows(bench))
    d = documents.selectExpr("doc_id AS id", "xxhash64(text) AS k", "text")
    plan = decontaminate.hits(d, windows, ["id", "k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("InMemoryRelation") == 1


def test_duplicate_lines_count_against_lines(spark):
    """A hundred equal lines of three words: a host of such texts fails by them."""
    docs = spark.createDataFrame([(1, "one two three\n" * 100 + "\n \n", "h")], "doc_id long, text string, source string")
    m = quality_rules.measure(docs)
    assert (m.first().n_lines, m.first().n_dup_lines) == (100, 99)
    assert m.where(quality_rules.rules()["dup_lines"]).count() == 1
