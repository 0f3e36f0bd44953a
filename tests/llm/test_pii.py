"""Personal-data spans against a plain Python search."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group())]


TEXTS = [
    None, "", "nothing here", "a@b.c x@y.z_q@w.v a@b@c.d .@.@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 0255.01.1.1 1..2.3.4",
    "😀 é 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111x", "+1 (269) 555-3296 4524132264652876 +49 30 901820-0.",
    "+12345678 +1234567890123456 ++1 (2) 3", "é" * 50 + "mail me at über.x@mail.example.co.uk\nDE89 3704 0044 0532 0130 00 and GB82WEST12345698765432",
    "a" * 30000, "1" * 30000, "1." * 20000, "1 " * 20000, "a.b@" * 5000, "a@b." * 5000, "ssn 123-45-6789, part 123-45-6788",
    "call the phone +1 (253) 555-3368 in", "70.117.73.88 é",
]


@pytest.fixture(scope="module")
def got(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS + ["dup a@b.c"] * 2)], "doc_id long, text string, row string, kind int")
    return {}, docs, pii.spans(docs).orderBy("doc_id").collect()


def test_base_spans_equal_plain_search(got):
    rows = {}
    for r in got[2]:
        rows.setdefault(r.doc_id, r.spans)
    for i, t in enumerate(TEXTS):
        assert [(s.kind, s.start, s.end) for s in rows[i] if s.base] == plain(t), t and t[:60]


def test_added_spans(got):
    rows = {r.doc_id: r.spans for r in got[2]}

    def added(i):
        return [(s.kind, TEXTS[i][s.start:s.end]) for s in rows[i] if not s.base]
    assert ("phone", "+1 (269) 555-3296") in added(6) and ("card", "4524132264652876") in added(6) or not passes("card", "4524132264652876")
    assert {k for k, _ in added(8)} == {"iban"} and len(added(8)) == 2
    assert added(15) == [("ssn", "123-45-6789")]
    for i in range(len(TEXTS)):
        base = [(s.kind, s.start, s.end) for s in rows[i] if s.base]
        assert not [1 for s in rows[i] if not s.base for k, a, b in base if k == s.kind and a < s.end and s.start < b]


def test_one_row_per_row_and_empty(spark, got):
    assert len(got[2]) == len(TEXTS) + 2
    assert pii.spans(got[1].limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.c +1 (253) 555-3368", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    r = pii.op8_pii(spark, str(tmp_path)).collect()[0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
    assert r.spans == "email:2:7,phone:8:25" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_checksums(spark):
    one = spark.range(1)
    assert one.select(pii.mod97(F.lit("DE89370400440532013000")), pii.mod97(F.lit("DE89370400440532013001")),
                      pii.luhn(F.lit("79927398713")), pii.luhn(F.lit("79927398710")), pii.luhn(F.lit(""))).first()[:] == (
        True, False, True, False, False)
