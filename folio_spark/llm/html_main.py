"""Main text of web pages by a tree-structured graphical model over the page's blocks.

A page becomes a tree of block elements and of the text runs inside them (inline tags only mark up text). Every node is
content or not: its own potential is linear in features of its tag, its class and id words, its text and links; a
potential per kind of child couples it with its parent. Messages upward and then downward (sum-product) give each
node's exact marginal; text runs with a marginal of one half or more are the main text, in page order. The potentials
are trained by gradient ascent on labelled pages, with the same messages giving the expected statistics.

Labelled pages are HTML in which an element's `data-main` attribute, 1 or 0, labels it and what is below it; LABELLED
holds pages of common layouts, and `fit` takes any others. Tests hold each layout against a model of the others.

Defined cases: null or empty html gives an empty text; broken and unclosed tags are closed where the next block says
so, an unclosed script or comment reaches to the end; very long and very deep pages cost time in proportion; a page of
text without markup is its text; equal pages give equal texts; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML elements that start a block, whose content is no markup, whose text is not shown (and that a block
#: ends, but for the first), that stand alone, that hold a line's text.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article aside nav "
    "header footer main form fieldset figure figcaption blockquote pre address details summary center dialog menu search".split()
)
RAW = frozenset("script style noscript title textarea iframe".split())
UNSHOWN = ("template", "select", "button", "option", "optgroup", "datalist")
VOID = frozenset("br hr img input meta link source track wbr area base col embed param".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 dt dd li td th".split())
#: A tag that opens closes these, when they are open and nothing of `HOLDS` is between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
#: Words of class, id and role attributes that say what an element is.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs skip toc topbar",
    "frame": "header masthead footer foot colophon copyright banner contentinfo bottom legal logo site",
    "side": "sidebar aside side rail complementary widget widgets related recommended recommend more popular trending teaser teasers",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert announcement newsletter subscribe subscription signup paywall",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner-ad adsbygoogle dfp",
    "share": "share sharing social follow tags tag meta byline toolbar print buttons rating",
    "comment": "comment comments reply replies respond discussion disqus review reviews feedback guestbook thread",
    "form": "form search login signin register contact input newsletter poll survey",
    "main": "article content main post entry story body text page-content maincontent articlebody post-content entry-content prose",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-main|hidden|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A heading that says how many follow it.
_COUNTED = re.compile(r"^\W*\d+ \w+\W*$|^\w+ \(\d+\)$")


@lru_cache(64)
def _closing(tag: str) -> re.Pattern[str]:
    """The end tag of an element whose content is no markup; upper and lower case of ASCII letters only."""
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I | re.A)


class Node:
    __slots__ = ("attributes", "children", "label", "links", "parent", "parts", "tag", "words")

    def __init__(self, tag: str, parent: int, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.parts: list[str] = []
        self.words = self.links = 0
        self.label: int | None = None


def _end(page: str, at: int) -> int:
    """Where the tag that starts before `at` ends: the next > outside of quotes, or the next > at all."""
    end = page.find(">", at)
    for quote in ('"', "'"):
        if end > 0 and page.count(quote, at, end) % 2:
            close = page.find(quote, end)
            further = page.find(">", close) if close > 0 else -1
            if further > 0 and "<" not in page[end:close]:
                return further
    return end if end >= 0 else len(page)


def parse(page: str) -> list[Node]:
    """The page's nodes, parents first; a text run is a node with tag "#"."""
    nodes, stack = [Node("#page", -1)], [0]
    run, link, at = None, 0, 0
    opened: dict[str, int] = {}  # how many elements of each tag are on the stack

    def close(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    def text(part: str) -> None:
        nonlocal run
        if any(opened.get(t) for t in UNSHOWN):
            return
        if run is None:
            if not part.strip():
                return
            run = Node("#", stack[-1])
            nodes.append(run)
        run.parts.append(part)
        if link:
            run.links += len(part)

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        end = _end(page, m.end())
        at = end + 1
        if m[2]:
            continue
        tag = m[4].lower()
        if m[3]:
            if tag == "a":
                link = 0
            elif tag in BLOCKS or tag in UNSHOWN:
                run = run if tag in UNSHOWN else None
                if opened.get(tag):
                    close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if tag in UNSHOWN:
            for t in ("option", "optgroup", "select", "button")[: {"option": 1, "optgroup": 2, "select": 3, "button": 4}.get(tag, 0)]:
                if opened.get(t):  # a new one ends those of its kind and what they hold
                    close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == t))
            if page[end - 1 : end] != "/":
                nodes.append(Node(tag, stack[-1]))
                stack.append(len(nodes) - 1)
                opened[tag] = opened.get(tag, 0) + 1
            continue
        if tag in RAW:
            if page[end - 1 : end] != "/":
                found = _closing(tag).search(page, at)
                at = _end(page, found.end()) + 1 if found else len(page)
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            text(" ")
        elif tag in BLOCKS:
            run, link = None, 0
            if not opened.get("template"):
                for t in UNSHOWN[1:]:
                    while opened.get(t):
                        close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == t))
            if nodes[stack[-1]].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (tag in LEAVES or nodes[stack[-1]].tag == "p"):
                close(len(stack) - 1)
            if any(opened.get(t) for t in CLOSES.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in HOLDS.get(tag, ()):
                        break
                    if nodes[stack[k]].tag in CLOSES[tag]:
                        close(k)
            nodes.append(Node(tag, stack[-1], page[m.end() : end]))
            stack.append(len(nodes) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    return nodes


@lru_cache(4096)
def _hints(tag: str, attributes: str) -> tuple[tuple[str, ...], int | None]:
    """Features of a tag and its attributes, and its label if it has one."""
    found, label = ["tag:" + tag], None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[3]).lower(), (m[2] or "").strip("\"'").lower()
        if name == "data-main":
            label = int(value == "1")
        elif name in ("class", "id", "role"):
            found += ["hint:" + _HINT[w] for w in dict.fromkeys([*value.split(), *_WORDS.findall(value)]) if w in _HINT]
        elif name == "hidden" or "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
            found.append("hidden")
    return tuple(dict.fromkeys(found)), label


def texts(nodes: list[Node]) -> list[str]:
    """Each run's text with references decoded and white space folded; "" for elements."""
    return [" ".join(entities.unescape("".join(n.parts)).split()) if n.parts else "" for n in nodes]


def _size(words: int) -> str:
    return "0" if not words else "few" if words < 5 else "line" if words < 15 else "some" if words < 40 else "many"


def features(nodes: list[Node], shown: list[str]) -> list[list[str]]:
    """Feature names of each node: its hints, how much text it has, how much of that is links, and where it stands:
    inside an article, behind a heading that announces a count, among siblings that are built like itself."""
    n = len(nodes)
    inside, alike, counted = [False] * n, [0] * n, [False] * n
    children: dict[int, list[int]] = {}
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.tag == "article"
        children.setdefault(node.parent, []).append(i)
    for i in range(1, n):
        counted[i] = counted[nodes[i].parent]
        own = children.get(i, ())
        if own and nodes[i].tag not in ("#", "body", "html") and not counted[i]:
            first = own[0]
            head = children.get(first, ()) if nodes[first].tag[:1] == "h" and nodes[first].tag[1:].isdigit() else ()
            counted[i] = any(_COUNTED.search(shown[k]) for k in head)
    for own in children.values():
        blocks = [i for i in own if any(nodes[k].tag in ("p", "div", "blockquote") for k in children.get(i, ()))]
        for i in blocks:
            alike[i] = len([k for k in blocks if nodes[k].tag == nodes[i].tag and nodes[k].attributes == nodes[i].attributes])
    words, signs, links = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if shown[i]:
            words[i], signs[i], links[i] = shown[i].count(" ") + 1, len(shown[i]), nodes[i].links
        if i:
            p = nodes[i].parent
            words[p] += words[i]
            signs[p] += signs[i]
            links[p] += links[i]
    out = []
    for i, node in enumerate(nodes):
        own = list(_hints(node.tag, node.attributes)[0])
        linked = links[i] * 2 > signs[i]
        own.append(("run:" if node.tag == "#" else "all:") + _size(words[i]))
        if linked:
            own.append("linked in article" if inside[i] else "linked")
        if counted[i]:
            own.append("counted")
        if alike[i] > 1 and nodes[i].tag in ("li", "div", "article", "section", "dd"):
            own.append("alike:" + nodes[i].tag)
        if node.tag == "#":
            own.append("in:" + nodes[node.parent].tag)
            if shown[i][-1:] in ".!?…:;»”\"":
                own.append("sentence")
            if "©" in shown[i] or "all rights reserved" in shown[i].lower() and words[i] < 30:
                own.append("rights")
        out.append(own)
    return out


def _kind(nodes: list[Node], i: int) -> int:
    """The kind of coupling between a node and its parent: text run, heading, list or table part, other block."""
    tag = nodes[i].tag
    return 0 if tag == "#" else 1 if tag[0] == "h" and tag[1:].isdigit() else 2 if tag in ("ul", "ol", "li", "dl", "dt", "dd", "tr", "td", "th", "table", "tbody") else 3


KINDS = 4


class Model:
    """weights: by feature; pair[kind, parent label, child label]."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pair = np.zeros((KINDS, 2, 2))

    def unary(self, names: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        return np.array([sum([get(f, 0.0) for f in own]) for own in names])

    def messages(self, nodes: list[Node], score: np.ndarray) -> tuple[list[float], list[tuple[float, ...]]]:
        """Marginals of label 1, and for each node but the first the joint marginals with its parent."""
        n = len(nodes)
        pair = np.exp(self.pair).tolist()
        kinds = [_kind(nodes, i) for i in range(n)]
        one = [min(1e12, max(1e-12, x)) for x in np.exp(np.clip(score, -25, 25)).tolist()]
        up0, up1 = [1.0] * n, one[:]  # beliefs from below, labels 0 and 1
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = pair[kinds[i]]
            s = up0[i] + up1[i]
            x, y = up0[i] / s, up1[i] / s
            to0, to1 = a * x + b * y, c * x + d * y
            sent[i] = to0, to1
            p = nodes[i].parent
            up0[p] *= to0
            up1[p] *= to1
            s = up0[p] + up1[p]
            up0[p] /= s
            up1[p] /= s
        belief = [0.0] * n
        belief[0] = up1[0] / (up0[0] + up1[0])
        joint: list[tuple[float, ...]] = [()] * n
        for i in range(1, n):
            p = belief[nodes[i].parent]
            (a, b), (c, d) = pair[kinds[i]]
            out0, out1 = (1 - p) / sent[i][0], p / sent[i][1]
            s = up0[i] + up1[i]
            x, y = up0[i] / s, up1[i] / s
            j = (out0 * a * x, out0 * b * y, out1 * c * x, out1 * d * y)
            total = sum(j)
            j = tuple(v / total for v in j)
            belief[i] = j[1] + j[3]
            joint[i] = j
        return belief, joint


def labels(nodes: list[Node]) -> list[int]:
    """Labels by data-main, inherited downward; 0 where nothing is said."""
    out: list[int] = []
    for node in nodes:
        own = _hints(node.tag, node.attributes)[1]
        out.append(own if own is not None else out[node.parent] if node.parent >= 0 else 0)
    return out


def fit(pages: list[str], steps: int = 120, rate: float = 0.4, ridge: float = 0.05) -> Model:
    """Gradient ascent on the likelihood of all labels of the labelled pages, with AdaGrad's step per weight."""
    model, data = Model(), []
    seen: dict[str, float] = {}
    seen_pair = np.full_like(model.pair, 1e-6)
    for page in pages:
        nodes = parse(page)
        data.append((nodes, features(nodes, texts(nodes)), labels(nodes)))
    for _ in range(steps):
        slope, pair = dict.fromkeys(model.weights, 0.0), np.zeros_like(model.pair)
        for nodes, names, truth in data:
            belief, joint = model.messages(nodes, model.unary(names))
            for i, own in enumerate(names):
                for f in own:
                    slope[f] = slope.get(f, 0.0) + truth[i] - belief[i]
                if i:
                    k = _kind(nodes, i)
                    pair[k].flat[2 * truth[nodes[i].parent] + truth[i]] += 1
                    pair[k] -= np.reshape(joint[i], (2, 2))
        for f, g in slope.items():
            w = model.weights.get(f, 0.0)
            g -= ridge * w
            seen[f] = seen.get(f, 1e-6) + g * g
            model.weights[f] = w + rate * g / seen[f] ** 0.5
        pair -= ridge * model.pair
        seen_pair += pair * pair
        model.pair += rate * pair / np.sqrt(seen_pair)
    return model


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page or "")
    shown = texts(nodes)
    if not any(shown):
        return ""
    belief, _ = model.messages(nodes, model.unary(features(nodes, shown)))
    return "\n\n".join(t for t, b in zip(shown, belief, strict=True) if t and b >= 0.5)


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` of pages (…, html), with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                found = [main_text(x, model) for x in batch.column(0).to_pylist()]
                cols = [*batch.columns[1:], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "text", "n_chars"])

    kept = pages.select("html", *keep)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{shape}, text string, n_chars long")


_P = "<p>The committee met on Tuesday to go over the plan, and most members spoke in favour of it after a long debate.</p>"
_Q = "<p>Later that day, a second reading brought three changes, none of which touched the budget or the dates agreed before.</p>"
_S = "<p>It was late.</p>"
_LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News of the day</a></li><li><a href=/c>About us</a></li></ul>"
_FORM = "<form data-main=0><label>Your name</label><input><p>Fill in this form to get our letter every week, free of charge.</p></form>"
_AD = "<div class={0} data-main=0><p>Buy two lamps now and get one free, this week only, in every shop near you.</p></div>"
_TALK = "<{0} class={1} data-main=0><h3>Comments</h3><div><p>I was there and it was nothing like that, the whole debate took ten minutes.</p></div><div><p>Thanks for this report, very clear and useful to me.</p></div></{0}>"
_TABLE = "<table><tr><th>Year</th><th>Votes</th></tr><tr><td>2001</td><td>17 of 23</td></tr></table>"
_SAYS = "<{0} id={1} data-main=0><h2>{2}</h2><ol><li><p>I was there and it was nothing like that, the whole debate took ten minutes.</p></li><li><p>Thanks for this report, very clear and useful to me.</p><p>Keep going.</p></li></ol></{0}>"
_MORE = "<figure><img src=/x.jpg><figcaption>The town hall on the day of the vote</figcaption></figure><ul><li><a href=/p>The plan as it was first read</a></li><li><a href=/q>What the mayor said</a></li></ul><dl><dt>Hall</dt><dd>where the members meet</dd></dl>"
_LIST = "<ul><li>the first change, on the hall</li><li>the second change, on the road and its lamps</li></ul>"


def layouts() -> list[list[str]]:
    """Pages of common layouts, by layout: article elements, hinted containers, plain containers, with all that may
    surround them, and with nothing around them."""
    body = f"<h1>A plan for the town</h1>{_P}{_S}{_Q}"
    rich = f"<h1>A plan for the town</h1>{_P}<h2>What changed</h2>{_LIST}{_Q}{_TABLE}<blockquote>{_S}</blockquote>{_P}"
    foot = "<footer>&copy; The Gazette &middot; All that is fit to read since long ago.</footer>"
    side = "<{0} class={1} data-main=0><h3>Related</h3><p>Read also what the council said about the bridge last year in May.</p>" + _LINKS + "</{0}>"
    note = "<div class={0} data-main=0><p>We use cookies to make this site work well for you and for our partners.</p></div>"
    out = []
    tiny = f"<h1>A plan</h1>{_S}"
    long = f"<h1>A plan for the town and all that came of it in the end</h1><p>{_P[3:-4] * 3}</p>{_Q * 2}<p>{_Q[3:-4] * 4}</p>{_S}<p>To be</p>{_P * 2}"
    bare, pair = f"<p>{_P[3:-4] * 2}</p>", f"{_P}{_Q}"  # articles without a heading
    for inner in (body, rich, tiny, long, bare, pair):
        out.append([
            f"<body><nav>{_LINKS}</nav>{_AD.format('ad')}<article data-main=1>{inner}</article>{foot}</body>",
            f"<body><header><h2>The Gazette</h2><p>News for everyone in the valley and beyond.</p></header><main><article data-main=1>{inner}{_AD.format('sponsored')}{_Q}</article></main>{side.format('aside', 'x')}{foot}</body>",
            f"<body><div id=header>The Gazette, a paper for the valley</div><div class=menu>{_LINKS}</div>{note.format('cookie-notice')}<div id=content data-main=1>{inner}{_TALK.format('div', 'comments')}</div>{side.format('div', 'sidebar')}<div id=footer>Printed by the Gazette. All rights reserved.</div></body>",
            f"<body><div class=topbar>{_LINKS}</div><div><div data-main=1>{inner}</div><div>{_LINKS}</div></div>{_TALK.format('section', 'replies')}{_FORM}{foot}</body>",
            f"<body>{note.format('notice')}<section class=post-content data-main=1>{inner}<div class=share data-main=0><a href=/s>Share this</a> <a href=/t>Print</a></div></section>{_TALK.format('div', 'discussion')}{side.format('div', 'related')}{foot}</body>",
            f"<body><table><tr><td>{_LINKS}</td><td data-main=1>{inner}</td></tr></table>{foot}</body>",
            f"<body><nav>{_LINKS}</nav><main data-main=1>{inner}<aside data-main=0><p>Sign up for our letter and never miss a word of this story.</p></aside>{_S}<form data-main=0><p>Search</p></form></main>{foot}</body>",
            f"<body><header>{_LINKS}</header><div class=promo data-main=0>{_Q}</div><div class=story data-main=1>{inner}</div><div class=newsletter data-main=0>{_FORM}</div>{_AD.format('advert')}{foot}</body>",
            f"<body><div class=wrapper><div class=entry-content data-main=1><header data-main=1><h1>A plan</h1></header>{inner}<footer data-main=0>Filed under <a href=/x>plans</a></footer></div></div><div class=popup data-main=0><p>Join now and read as much as you like for a month.</p></div></body>",
            f"<body><nav>{_LINKS}</nav><article data-main=1>{inner}{_MORE}{_Q}{_S}</article>{_SAYS.format('section', 'x', '2 thoughts')}{foot}</body>",
            f"<body><header>{_LINKS}</header><main><div data-main=1>{inner}</div>{_SAYS.format('div', 'y', 'Voices (2)')}</main>{side.format('aside', 'z')}{foot}</body>",
            f"<body><article data-main=1>{inner}</article></body>",
            f"<body data-main=1>{inner}</body>",
            f"<body><div data-main=1>{inner}</div>{foot}</body>",
            f"<body data-main=1>{re.sub('<[^>]*>', ' ', inner)}</body>",
            f"<body><nav>{_LINKS}</nav>{note.format('cookies')}{_FORM}{foot}</body>",
        ])
    return [list(pages) for pages in zip(*out, strict=True)]


LABELLED = [page for layout in layouts() for page in layout]
