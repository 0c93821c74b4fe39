"""One pass over a page's tags: title, text with paragraph breaks, the text of a content block, links.

Elements nest on a stack, so a block ends where its own end tag is, whatever it holds. Scripts, styles and comments say
nothing; unclosed ones reach to the end. Runs in Arrow batches; time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags that break lines, elements whose content is no markup, elements without content.
BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article ul ol dl dt dd table td th nav footer header main aside blockquote pre form figure figcaption".split())
RAW = frozenset("script style noscript title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that hold the text on the pages of official sources, the more particular first: tag, attribute, word.
BLOCKS = (
    ("div", "id", "gb_content"), ("div", "id", "fontzoom"), ("div", "id", "UCAP-CONTENT"), ("div", "class", "txt_txt"), ("div", "class", "law-chapter"),
    ("div", "class", "content-body"), ("div", "class", "Custom_UnionStyle"), ("div", "class", "detail-news"), ("article", "", ""), ("main", "", ""),
)

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_INSIDE = re.compile(r"""(?>[^"'>]+|"[^"]*"|'[^']*')*(>)?""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_BLANKS = re.compile(r"\s+")


@dataclass
class Page:
    title: str | None = None
    text: str = ""
    #: The text of the first block of BLOCKS that the page has, or None.
    block: str | None = None
    links: list[tuple[str, str]] = field(default_factory=list)


def folded(parts: Iterable[str]) -> str:
    """Lines of decoded text with single spaces and without blank lines."""
    lines = (_BLANKS.sub(" ", x).strip() for x in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x)


def _attributes(inside: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        found.setdefault(m[1].lower(), entities.unescape(m[2].strip("\"'") if m[2][0] in "\"'" else m[2]))
    return found


def _which(tag: str, attributes: dict[str, str], blocks: tuple) -> list[int]:
    return [i for i, (t, a, word) in enumerate(blocks) if t == tag and (not a or word in attributes.get(a, "").split())]


def scan(page: str, blocks: tuple = BLOCKS) -> Page:
    """A page's facts. Line feeds of the source are spaces; only tags break lines."""
    out, parts = Page(), []
    stack: list[str] = []
    spans: dict[int, tuple[int, int]] = {}  # block: first and last part
    open_: dict[int, tuple[int, int]] = {}  # block: depth of its element, first part
    link: tuple[str, int] | None = None
    depth_of: dict[str, int] = {}

    def end_link() -> None:
        nonlocal link
        if link:
            out.links.append((link[0], " ".join(folded(parts[link[1] :]).split("\n"))))
        link = None

    def pop(depth: int) -> None:
        for t in stack[depth:]:
            depth_of[t] -= 1
        del stack[depth:]
        for i in [i for i, (d, _) in open_.items() if d >= depth]:
            spans[i] = (open_.pop(i)[1], len(parts))

    at, head = 0, False
    while True:
        m = _TAG.search(page, at)
        if not head:
            parts.append(page[at : m.start() if m else len(page)].replace("\n", " ").replace("\r", " "))
        if not m:
            break
        if m[1]:
            close = page.find("-->", m.end())
            at = close + 3 if close >= 0 else len(page)
            continue
        inside = _INSIDE.match(page, m.end())
        end = inside.end() if inside[1] else page.find(">", m.end()) + 1
        if not end:  # a tag that the page cuts off
            break
        at = end
        if m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag == "a":
                end_link()
            if tag == "head":
                head = False
            if depth_of.get(tag):
                pop(max(i for i, t in enumerate(stack) if t == tag) if depth_of[tag] > 1 or stack[-1] != tag else len(stack) - 1)
            if tag in BREAKS:
                parts.append("\n")
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(page, at)
            if tag == "title" and out.title is None:
                out.title = _BLANKS.sub(" ", entities.unescape(re.sub(r"<[^>]*>", "", page[at : close.start() if close else len(page)]))).strip()
            after = page.find(">", close.end()) if close else -1
            at = after + 1 if after >= 0 else len(page)
            continue
        if tag == "head":
            head = True
            continue
        if tag == "body":
            head = False
        if tag in BREAKS:
            parts.append("\n")
        attributes = _attributes(page[m.end() : end]) if tag == "a" or any(t == tag for t, _, _ in blocks) else {}
        if tag == "a" and "href" in attributes:
            end_link()
            link = (attributes["href"], len(parts))
        if tag in VOID or page[end - 2] == "/":
            continue
        for i in _which(tag, attributes, blocks):
            if i not in spans and i not in open_:
                open_[i] = (len(stack), len(parts))
        stack.append(tag)
        depth_of[tag] = depth_of.get(tag, 0) + 1
    end_link()
    pop(0)
    out.text = folded(parts)
    if spans:
        a, b = spans[min(spans)]
        out.block = folded(parts[a:b])
    return out


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor", T.StringType())])
_SHAPE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("title", "text", "block")), T.StructField("links", T.ArrayType(_LINK))])


@F.pandas_udf(_SHAPE)
def scanned(pages: pd.Series) -> pd.DataFrame:
    rows = [scan(p) if p else Page() for p in pages]
    links = [[{"href": h, "anchor": a} for h, a in r.links] for r in rows]
    return pd.DataFrame({"title": [r.title for r in rows], "text": [r.text for r in rows], "block": [r.block for r in rows], "links": links})


def page(html: Column) -> Column:
    """title, text, block, links of a page; null and empty pages have an empty text and no links."""
    return scanned(html)


#: Pages of a batch that are read at once; what is kept of them is their links only.
AT_ONCE = 64


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, p (from 0), href, anchor of the links of pages (page_id, url, html), a few pages at a time."""
    names = ["page_id", "url", "p", "href", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                rows = [(i, p, *x) for i, html in enumerate(batch.column(2).to_pylist()) if html for p, x in enumerate(scan(html).links)]
                own, *columns = list(zip(*rows, strict=True)) or [()] * 4
                kept = [batch.column(k).take(pa.array(own, pa.int64())) for k in range(2)]
                yield pa.record_batch([*kept, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)]], names)

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in names[:2])
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, p int, href string, anchor string")
