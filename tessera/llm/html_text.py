"""Main text of web pages by tag-path ratios (operator 10).

Each page is read once into text nodes with their root-to-leaf tag paths.
Per path, the text length and the punctuation marks of its nodes are summed and
divided by the number of nodes (text ratio, punctuation ratio); the ratios are
smoothed along the nodes' order with a Gaussian kernel, fused into one
score (text ratio times one plus punctuation ratio), and paths at or above a
share of the scores' spread are content. The content region is the lowest
element around the content nodes, widened to an enclosing article or main
element or to the next block container, so short paragraphs and headings of the
article stay. Elements that are no article text by their tag (menus, page
headers, footers, scripts, styles) or hidden never count and are never kept.
Parts named in class, id or role as comments, shares, cookie notices, adverts or
the like go always. Forms, and parts named as side bars, page headers, banners,
notices or menus, go too, unless they wrap the page's text: all of the content
nodes' text, or more than half of it and a main or h1 element. Names that only
speak of such a part (has-sidebar, comments-open, overflow-hidden) don't count.

Defined results: null, empty or markup-only html gives an empty text; unclosed
comments and scripts end with the page; unclosed or stray tags are repaired
(a new block closes an open paragraph); every row gives one row, repeated rows
repeated ones; time and memory are linear in the page. Only the id, url and html
columns are read, other columns cannot clash.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
PUNCTUATION = re.compile("[.,;:!?。、，；：！？…]")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s "
                    "samp small span strike strong sub sup time tt u var wbr").split())
#: Within a paragraph, like inline elements: neither a block's start nor its end.
WITHIN = INLINE | frozenset(("script style noscript template iframe object embed svg math canvas audio video button select "
                             "option optgroup input textarea img picture source track map area").split())
NO_TEXT = frozenset(("head script style noscript template iframe object embed svg math canvas audio video select option "
                     "textarea button nav footer aside dialog menu title noembed noframes input fieldset").split())
#: Blocks whose start ends an open element of the same set.
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NAMED = ("class", "id", "role")
ROOTS = frozenset(("html", "body", "article", "main"))
SCOPE = frozenset("article aside blockquote body dl div main ol section table td th tr ul form html".split())
#: Words in class, id or role that mark a part as no article text, whatever it holds.
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|"
    r"related|recommended|share|sharing|social|cookie|cookies|consent|gdpr|newsletter|subscribe|signup|"
    r"comment|comments|comment-?list|respond|replies|disqus|reviews|user-?comments|pagination|pager|"
    r"breadcrumb|breadcrumbs|skip-?link|footer|site-?footer|copyright)(?:$|[\s_-])", re.IGNORECASE)
#: Words that do so unless the part wraps the page's text.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:banner|nav|navbar|navigation|menu|menubar|topbar|toolbar|masthead|site-?header|page-?header|"
    r"sidebar|aside|complementary|contentinfo|notice|notices|alert|popup|modal|overlay|login|search|discussion|"
    r"disclaimer|form)(?:$|[\s_-])|(?:^|\s)(?:widget|legal|hidden)(?:$|\s)", re.IGNORECASE)
#: A page header by its whole name; within an article it is the article's.
HEADER = re.compile(r"(?:^|\s)(?:header|(?:main|top|global)-?header)(?:$|\s)", re.IGNORECASE)
#: Names that speak of a part elsewhere, or of its state.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|not|with|without|hide|overflow)[_-]\S+|"
                      r"\S+[_-](?:open|opened|closed|enabled|disabled|allowed|on|off|count|free|ready)(?=$|\s))", re.IGNORECASE)
#: Of the content nodes' text, this wraps the page's text: with a main or h1 element more than, without at least.
WRAPS_HEAD, WRAPS = 0.5, 1.0


@dataclass
class Page:
    """Elements and text nodes. Element 0 is the page; ``suspect`` elements are
    dropped by ``drop_suspects`` unless they wrap the page's text; ``path`` numbers the
    root-to-leaf tag paths. A node is (element, block, text before decoding)."""
    tag: list = field(default_factory=lambda: [""])
    parent: list = field(default_factory=lambda: [0])
    dropped: list = field(default_factory=lambda: [False])
    suspect: list = field(default_factory=lambda: [False])
    path: list = field(default_factory=lambda: [0])
    nodes: list = field(default_factory=list)


def attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(s)}


def no_article_text(tag: str, a: dict[str, str], in_article: bool) -> bool:
    if tag in NO_TEXT or tag == "header" and not in_article:
        return True
    if tag not in ROOTS and any(k in a and NEVER.search(MODIFIER.sub("", a[k])) for k in NAMED):
        return True
    return tag not in ROOTS and (
        "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE) is not None)


def named_boilerplate(tag: str, a: dict[str, str], in_article: bool) -> bool:
    if tag == "form":
        return True
    names = [MODIFIER.sub("", a[k]) for k in NAMED if k in a] if tag not in ROOTS else []
    return any(BOILERPLATE.search(n) or not in_article and HEADER.search(n) for n in names)


def read_page(html: str, drop_parts: bool = True) -> Page:
    """``drop_parts``: mark boilerplate; else only what is never shown."""
    page, paths = Page(), {}
    stack, block, pos, end = [0], 0, 0, len(html)
    last_gt = html.rfind(">")
    in_article = 0
    # Places in the stack by tag, of containers, and of what an open paragraph doesn't
    # reach across: no end tag walks down the stack.
    where, scopes, walls = defaultdict(list), [], []

    def push(e: int) -> None:
        nonlocal in_article
        k, tag = len(stack), page.tag[e]
        stack.append(e)
        where[tag].append(k)
        if tag in SCOPE:
            scopes.append(k)
        if tag not in WITHIN and tag not in ("p", "td", "th"):
            walls.append(k)
        in_article += tag in ("article", "main")

    def pop_to(k: int) -> None:
        nonlocal in_article
        for e in stack[k:]:
            where[page.tag[e]].pop()
            in_article -= page.tag[e] in ("article", "main")
        for places in (scopes, walls):
            while places and places[-1] >= k:
                places.pop()
        del stack[k:]

    def text(a: int, b: int) -> None:
        if b > a:
            page.nodes.append((stack[-1], block, html[a:b]))

    while pos < end:
        lt = html.find("<", pos)
        if lt < 0:
            text(pos, end)
            break
        text(pos, lt)
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            pos = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            pos = end if close < 0 else close + 1
            continue
        m = (TAG.match(html, lt) or LOOSE_TAG.match(html, lt)) if lt < last_gt else None
        if not m:
            if lt > last_gt and re.match(r"</?[a-zA-Z]", html[lt:lt + 3]):
                break  # a tag cut off by the end of the page
            text(lt, lt + 1)
            pos = lt + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if tag == "br":
            page.nodes.append((stack[-1], block, " "))
            continue
        if tag not in WITHIN:
            block += 1
        if m[1]:
            # An end tag closes its element unless a container lies between.
            if where[tag] and (tag in SCOPE or not scopes or scopes[-1] <= where[tag][-1]):
                pop_to(where[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag not in WITHIN:
            ends = CLOSED_BY_SAME.get(tag, ()) or ("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag in CLOSED_BY_SAME else ("p",)
            k = max((where[t][-1] for t in ends if where[t]), default=0)
            if k and (not walls or walls[-1] <= k):
                pop_to(k)
        up = stack[-1]
        page.tag.append(tag)
        page.parent.append(up)
        page.path.append(paths.setdefault((page.path[up], tag), len(paths) + 1))
        a = attributes(m[3]) if drop_parts and m[3] else {}
        drop = no_article_text(tag, a, in_article > 0) if drop_parts else tag in ("head", "script", "style", "noscript", "template")
        page.dropped.append(page.dropped[up] or drop)
        page.suspect.append(drop_parts and not drop and named_boilerplate(tag, a, in_article > 0))
        if m[3].endswith("/") and tag not in WITHIN and tag not in SCOPE and tag != "p":
            continue  # <x/>: no content
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, pos)
            pos = close.start() if close else end
        push(len(page.tag) - 1)
    return page


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(np.ceil(sigma * 2))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def content_nodes(page: Page, share: float = 0.5) -> list[int]:
    """Places in ``page.nodes`` of the content nodes: those on paths whose
    fused ratio is at least ``share`` of one standard deviation."""
    at, size, marks = [], [], []
    for k, (e, _, t) in enumerate(page.nodes):
        if not page.dropped[e] and not t.isspace():
            at.append(k)
            size.append(len(t.strip()))
            marks.append(len(PUNCTUATION.findall(t)))
    if not at:
        return []
    path = np.array([page.path[page.nodes[k][0]] for k in at])
    of = np.unique(path, return_inverse=True)[1]
    n = np.bincount(of)
    text_ratio = (np.bincount(of, weights=size) / n)[of]
    punctuation_ratio = (np.bincount(of, weights=marks) / n)[of]
    fused = smooth(text_ratio) * (1 + smooth(punctuation_ratio))
    score = (np.bincount(of, weights=fused) / n)[of]
    chosen = score >= share * score.std()
    return [k for k, c in zip(at, chosen) if c]


def drop_suspects(page: Page) -> None:
    """Drop the suspect elements that don't wrap the page's text."""
    if not any(page.suspect):
        return
    text, heads = [0] * len(page.tag), [t in ("main", "h1") and not d for t, d in zip(page.tag, page.dropped)]
    for k in content_nodes(page):
        e, _, t = page.nodes[k]
        text[e] += len(t.strip())
    for e in range(len(text) - 1, 0, -1):  # parents come first
        text[page.parent[e]] += text[e]
        heads[page.parent[e]] = heads[page.parent[e]] or heads[e]
    for e in range(1, len(text)):
        wraps = text[e] > 0 and (text[e] > text[0] * WRAPS_HEAD if heads[e] else text[e] >= text[0] * WRAPS)
        page.dropped[e] = page.dropped[e] or page.dropped[page.parent[e]] or page.suspect[e] and not wraps


def content_region(page: Page, nodes: list[int]) -> int:
    """The element whose text is the article."""
    below = [0] * len(page.tag)  # content nodes under each element
    for k in nodes:
        below[page.nodes[k][0]] += 1
    for e in range(len(below) - 1, 0, -1):  # parents come first
        below[page.parent[e]] += below[e]
    around = [e for e, n in enumerate(below) if n == below[0]]  # from the page down to the lowest
    articles = [e for e in range(len(below)) if below[e] and page.tag[e] in ("article", "main")]
    wide = [e for e in articles if below[e] == below[0]]
    if wide:
        return wide[0]
    tops, inside = [], [False] * len(below)  # no article is wide: the outermost ones
    for e in range(1, len(below)):  # parents come first
        article = page.tag[e] in ("article", "main")
        if article and below[e] and not inside[page.parent[e]]:
            tops.append(e)
        inside[e] = article or inside[page.parent[e]]
    if len(tops) == 1:
        return tops[0]
    return next((e for e in reversed(around) if page.tag[e] in ("div", "section", "body", "html", "")), 0)


def blocks(page: Page, region: int = 0) -> list[str]:
    """The blocks of text under ``region`` that aren't dropped."""
    inside = [False] * len(page.tag)
    for e in range(len(page.tag)):  # parents come first
        inside[e] = e == region or (e > 0 and inside[page.parent[e]])
    out, last, run = [], None, []
    for e, block, t in [*page.nodes, (0, -1, "")]:
        if block != last:
            s = " ".join(htmllib.unescape("".join(run)).split())
            if s:
                out.append(s)
            last, run = block, []
        if inside[e] and not page.dropped[e]:
            run.append(t)
    return out


def main_text(html: str | None) -> str:
    page = read_page(html or "")
    drop_suspects(page)
    nodes = content_nodes(page)
    return "\n\n".join(blocks(page, content_region(page, nodes))) if nodes else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars long) for each row."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html_col).mapInArrow(
        run, f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
