"""Main text and WARC derivatives."""

import base64
import gzip
import hashlib
import io
import time

import pytest

from tessera.llm import html_text, warc

LONG = "This paragraph, like others of the article, has enough words and marks to be content; it goes on."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain words only, no tags.", "plain words only, no tags."),
    (page(f"<nav><ul><li>Home</li></ul></nav><article><h1>Head</h1><p><b>One &amp; two.<br><p>{LONG}</p><p>Short</p></article><footer>f</footer>"),
     f"Head\n\nOne & two.\n\n{LONG}\n\nShort"),
    (page(f"<header>Site</header><div class='sidebar'>{LONG}</div><div id=content><p>{LONG}<p>x</div><div class='reader-comments'><p>{LONG}</div>"),
     f"{LONG}\n\nx"),
    (page(f"<main><section><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></section><p>end</p></main><div class='cookie-notice'>{LONG}</div>"),
     f"{LONG}\n\nend"),
    (page(f"<article><p>a<script>var t='</p>';</script>b &lt;i&gt; &#233;\n\n c</p><p>{LONG}<!-- x --></p></article><!-- open <p>{LONG}"),
     f"ab <i> é c\n\n{LONG}"),
    (page(f"<article><header><h1>Own head</h1></header><ul><li>one<li>two</ul><p hidden>no</p><p style='display: none'>no</p><p>{LONG}</p></article>"),
     f"Own head\n\none\n\ntwo\n\n{LONG}"),
    (page(f"<article><p>{LONG}</article></b></div><p"), LONG),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("name", [
    "container has-sidebar", "site right-sidebar", "no-sidebar", "overflow-hidden", "elementor-widget elementor-widget-text-editor",
    "legal-article", "with-comments", "hidden lg:block", "sidebar"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_wrappers_stay(name, tag):
    parts = f"<div class='sidebar'>{LONG}</div><p>{LONG}</p><p>{LONG}</p><div id='comments'><p>{LONG}</p></div>"
    for body in (f"<div><{tag} class='{name}'><h1>Head</h1>{parts}</{tag}></div>",
                 f"<article><{tag} class='{name}'><h1>Head</h1>{parts}</{tag}></article><div class='ad'>{LONG}</div>"):
        assert html_text.main_text(page(body)) == f"Head\n\n{LONG}\n\n{LONG}"
    parts = f"<div class='{name}'><p>{LONG}</p></div>" * 3
    if name not in ("site right-sidebar", "hidden lg:block", "sidebar"):  # parts, not wrappers
        assert html_text.main_text(page(f"<main>{parts}</main>")) == "\n\n".join([LONG] * 3)


def test_page_wide_form():
    body = f"<form id=aspnetForm><nav>{LONG}</nav><h1>Head</h1><p>{LONG}</p><form class=search>Find it, here.</form><p>{LONG}</p></form>"
    assert html_text.main_text(page(body)).startswith(f"Head\n\n{LONG}")
    few, many = f"<p>{LONG}</p>", f"<div id=comments>{f'<p>{LONG}</p>' * 5}</div>"  # more comments than article
    assert html_text.main_text(page(f"<div><h1>Head</h1>{few}</div>{many}")) == f"Head\n\n{LONG}"


def test_hostile_pages_are_linear():
    for h in ("<a" * 50000, "<!--" * 50000, "<p><b>" * 30000, "<div>" * 30000 + "x" + "</p>" * 30000, "<" * 50000, '<a b="' * 20000,
              "<article>" * 3000 + "<p>a, b.</p>" * 3000, "<script>" * 20000, "&" * 50000):
        html_text.main_text(h)


@pytest.mark.parametrize("comments", [
    "<section id='comments'>{}</section>", "<ol class='comment-list'>{}</ol>", "<div class='reader-reviews'>{}</div>",
    "<div class='post-replies'>{}</div>", "<div id='header'>{}</div>", "<div class='site-header'>{}</div>"])
@pytest.mark.parametrize("page_of", [
    "<article><h1>Head</h1><p>{0}</p>{1}</article>", "<div class='post'><p>{0}</p></div>{1}", "<h1>Head</h1><div class='post'><p>{0}</p></div>{1}"])
def test_comments_and_headers_go_however_long(page_of, comments):
    if "header" in comments and "<article>" in page_of:
        return  # an article's own header stays
    many = "".join(f"<li><p>Comment {i}, which goes on for a while, as they do.</p></li>" for i in range(40))
    got = html_text.main_text(page(page_of.format(LONG, comments.format(many))))
    assert got.removeprefix("Head\n\n") == LONG


@pytest.mark.parametrize("name", ["post comments-open", "content comments-closed sharing-enabled", "post-comment-count"])
def test_names_of_a_state_are_no_part(name):
    assert html_text.main_text(page(f"<div class='{name}'><h1>Head</h1><p>{LONG}</p></div>")).endswith(LONG)


HOSTILE = [lambda n: "<b>" * n + "</i>" * n, lambda n: "< " * (20 * n), lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
           lambda n: "<b>" * n + "<div></div>" * n, lambda n: "<div>" * n + "<article><p>a, b.</p></article>" * n,
           lambda n: "<p>" + "<td>" * n + "<p>" * n, lambda n: "<a x" * n, lambda n: "<a '" + "<b \">" * n]


@pytest.mark.parametrize("make", HOSTILE)
def test_time_is_linear(make):
    """Eight times the page takes no more than about eight times as long."""
    def took(n):
        t = time.process_time()
        html_text.main_text(make(n))
        return time.process_time() - t

    took(500)
    small, large = min(took(5_000) for _ in range(3)), min(took(40_000) for _ in range(2))
    assert large < 24 * max(small, 0.01), (small, large)


def naive_pop(html):
    """Open elements by walking the whole stack, as the rules are stated."""
    stack, out = [], []
    for m in html_text.TAG.finditer(html):
        tag = m[2]
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    del stack[k:]
                    break
                if stack[k] in html_text.SCOPE and tag not in html_text.SCOPE:
                    break
            continue
        if tag not in html_text.WITHIN:
            ends = html_text.CLOSED_BY_SAME.get(tag, ("p",))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in ends:
                    del stack[k:]
                    break
                if stack[k] not in html_text.WITHIN and stack[k] not in ("p", "td", "th"):
                    break
        out.append((tag, stack[-1] if stack else ""))
        stack.append(tag)
    return out


def test_elements_nest_as_the_rules_say():
    import random
    rng = random.Random(7)
    tags = ["p", "b", "i", "div", "li", "ul", "td", "tr", "table", "h1", "section", "dt", "dd", "article"]
    for _ in range(400):
        html = "".join(f"<{rng.choice(['', '/'])}{rng.choice(tags)}>" for _ in range(rng.randrange(60)))
        p = html_text.read_page(html)
        assert [(t, p.tag[u]) for t, u in zip(p.tag[1:], p.parent[1:])] == naive_pop(html)


def test_extract_rows(spark):
    rows = [(i, None if i == 0 else f"http://x/{i}", h, "z") for i, (h, _) in enumerate(CASES)] * 2 + [(None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    assert got == sorted([(i, t, len(t)) for i, (_, t) in enumerate(CASES)] * 2 + [(-1, "", 0)])
    assert html_text.extract_text(pages.limit(0)).count() == 0


def record(kind, rid, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Target-URI": "http://x/", "WARC-Date": "2026-01-01T00:00:00Z", **more,
            "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(body, kind="text/html; charset=utf-8", **more):
    return b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n" + "".join(
        f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items()).encode() + b"\r\n" + body


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


RECORDS = [
    record("response", "<urn:a>", http("<p>Grüße &amp; mehr</p><p>zwei".encode(), X_Own="yes"), WARC_Payload_Digest="sha1:KEPT"),
    record("response", "<urn:b>", http(gzip.compress("<p>zipped</p>".encode()), Content_Encoding="gzip")),
    record("response", "<urn:c>", http(b"4\r\nabcd\r\n2\r\nef\r\n0\r\n\r\n", "text/plain", Transfer_Encoding="chunked")),
    record("response", "<urn:d>", http(b"\x89PNG", "image/png")),
    record("response", "<urn:e>", b"not http"),
    record("response", "<urn:f>", http("é".encode("latin-1"), "text/plain; charset=iso-8859-1")),
    record("response", "<urn:g>", http(b"broken", Content_Encoding="gzip")),
    record("response", "<urn:h>", http(b"")),
    record("request", "<urn:r>", b"GET /"), b"no warc", b"", None, b"WARC/1.1\r\nContent-Length: x\r\n\r\n",
]


def test_derivatives(spark):
    df = warc.derivatives(spark.createDataFrame([(bytearray(r) if r is not None else None, 1) for r in RECORDS], "record binary, block int"))
    rows = df.collect()
    by = {(r.refers_to, r.warc_type): r for r in rows}
    assert {k[0] for k in by if k[1] == "conversion"} == {"<urn:a>", "<urn:b>", "<urn:c>", "<urn:f>", "<urn:h>"}
    assert {k[0] for k in by if k[1] == "metadata"} == {f"<urn:{c}>" for c in "abcdefgh"} and len(rows) == 13
    text = {k[0][5]: r.block for k, r in by.items() if k[1] == "conversion"}
    assert text == {"a": "Grüße & mehr\nzwei", "b": "zipped", "c": "abcdef", "f": "é", "h": ""}
    a, c = by["<urn:a>", "metadata"], by["<urn:a>", "conversion"]
    assert a.concurrent_to == c.record_id != a.record_id and a.target_uri == "http://x/" and a.warc_date == "2026-01-01T00:00:00Z"
    assert "http-x-own: yes\r\n" in a.block and "source-payload-digest: sha1:KEPT\r\n" in a.block and "fetch-status: 200\r\n" in a.block
    assert f"source-block-digest: {sha1(http('<p>Grüße &amp; mehr</p><p>zwei'.encode(), X_Own='yes'))}\r\n" in a.block
    assert c.payload_digest == "sha1:KEPT" and c.source_headers["warc-record-id"] == "<urn:a>"
    assert all(r.content_length == len(r.block.encode()) and r.block_digest == sha1(r.block.encode()) for r in rows)
    assert "derived: none\r\n" in by["<urn:d>", "metadata"].block and "no HTTP message" in by["<urn:e>", "metadata"].block
    again = {r.record_id for r in df.collect()}
    assert again == {r.record_id for r in rows}
    assert warc.derivatives(df.limit(0).selectExpr("CAST(NULL AS BINARY) AS record")).count() == 0


def test_files_round_trip(spark, tmp_path):
    plain = [r for r in RECORDS[:9]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in plain[:4]))
    (tmp_path / "b.warc").write_bytes(b"".join(plain[4:]))
    read = warc.read_warc(spark, str(tmp_path))
    assert sorted(warc.parse_record(bytes(r.record))[0]["warc-record-id"] for r in read.collect()) == [f"<urn:{c}>" for c in "abcdefghr"]
    out = warc.derivatives(read)
    parsed = [warc.parse_record(bytes(r.record)) for r in warc.record_bytes(out).collect()]
    assert all(p and p[0]["warc-block-digest"] == sha1(p[1]) for p in parsed) and len(parsed) == 13


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet"))
    rows = warc.op7_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(CASES) and len({r.record_id for r in rows}) == len(rows)
    assert {r.target_uri for r in rows} == {f"http://x/{i}" for i in range(len(CASES))}


@pytest.mark.parametrize("charset", ["idna", "undefined", "unicode_escape", "raw_unicode_escape", "punycode", "base64", "rot13", "nonsense", "utf-16", "koi8-r"])
def test_any_charset_reads(charset):
    text, why = warc.payload_text({"content-type": f"text/plain; charset={charset}"}, b"plain \\ud800 \xd8\x00 \xff")
    assert why == "" and text.encode() is not None and (charset in ("utf-16", "koi8-r") or text.startswith("plain"))


@pytest.mark.parametrize("size", [b"-3", b"+5", b"0x5", b"1_0", b"zz", b"f" * 40])
def test_bad_chunk_sizes(size):
    text, why = warc.payload_text({"content-type": "text/plain", "transfer-encoding": "chunked"}, size + b"\r\nabc\r\n0\r\n")
    assert text is None and why == "payload can't be decoded"


def test_inflating_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "MOST_INFLATED", 1000)
    plain = {"content-type": "text/plain", "content-encoding": "gzip"}
    assert warc.payload_text(plain, gzip.compress(b"x" * 10**6)) == (None, "payload can't be decoded")
    two = gzip.compress(b"x" * 600) + gzip.compress(b"y" * 400)
    assert warc.payload_text(plain, two) == ("x" * 600 + "y" * 400, "")
    assert warc.payload_text(plain, two + gzip.compress(b"z"))[0] is None
    assert warc.payload_text(plain, gzip.compress(b"cut")[:-9])[0] is None


def test_streams_with_bad_records(spark, tmp_path):
    good = [record("response", f"<urn:{i}>", http(b"x" * i, "text/plain")) for i in range(3)]
    bad = [b"WARC/1.1\r\nContent-Length: many\r\n\r\njunk\r\n", b"WARC/1.1\r\nContent-Length: -5\r\n\r\nmore\r\n", b"noise\r\n\r\n"]
    stream = good[0] + bad[0] + good[1] + bad[1] + bad[2] + good[2]
    assert [r.rstrip() for r in warc.iterate_records(io.BytesIO(stream))] == [g.rstrip() for g in good]
    (tmp_path / "a.warc").write_bytes(stream)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(stream)[:-20])
    got = [r.path[-1] for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert got.count("c") == 3 and got.count("z") >= 1
    out = warc.record_bytes(warc.derivatives(spark.createDataFrame([(bytearray(good[1]),)], "record binary"))).collect()
    assert all(b"WARC-Refers-To-Target-URI: http://x/" in r.record and b"WARC-Refers-To-Date: 2026" in r.record for r in out)


def test_queries_on_a_folder(spark, tmp_path):
    """Operators 7 and 10 through their queries, against the functions on plain rows."""
    rows = [(i, None if i == 0 else f"http://x/{i}", h, "z") for i, (h, _) in enumerate(CASES)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.url, r.text) for r in html_text.op10_html_text(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), u, html_text.main_text(h)) for i, u, h, _ in rows)
    made = warc.op7_warc(spark, str(tmp_path)).collect()
    records = [r.record for r in warc.response_records(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()]
    want = [d for r in records for d in warc.derive(*warc.parse_record(bytes(r)))]
    assert sorted((r.record_id, r.block) for r in made) == sorted((d["record_id"], d["block"]) for d in want) and len(made) == 2 * len(rows)
