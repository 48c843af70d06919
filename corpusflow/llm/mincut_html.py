"""Main text of web pages by minimum-cut labelling (operator 10).

A page becomes a list of text blocks (what stands between block-level tags). A
classifier gives each block a cost for being called content and one for being
called boilerplate: its terminal capacities. Smoothness edges join a block to the
next one and to the last one of the same parent and grandparent; cutting one costs
more the closer the two are in the document tree. The minimum cut, found by
maximum flow, is the labelling of least total cost.

The classifier is logistic regression over the block's own look (length, links,
punctuation, tag, place) and the class and id names around it. Names are evidence
to weigh, never a verdict: long prose in an element named like boilerplate, or one
between content blocks, can stay. It learns from blocks whose label a tag states, on a
bounded sample (``sample`` pages in hash order); a stated label adds a fixed capacity
of its own. A form is boilerplate unless its prose outweighs its controls: some pages
are one form.

One pass per page, no shuffle; the weights are broadcast. A page's graph has at
most four edges per block.

Defined cases: a null or empty html has an empty text; a page of one plain text is
its own block; unclosed tags and comments end with the page or the next tag that
excludes them; custom elements like svg-icon are no raw text, and a self-closed svg is empty; null ids and urls stay null; rows that repeat are judged one by one;
other columns are not read; an empty table gives no rows; without pages to learn
from, fixed weights are used.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.boosting import sigmoid
from corpusflow.llm.bpe_dp import slices
from corpusflow.llm.common import hash_sample

# Tags by what they do, and hints in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr !doctype".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter "
                   "nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br link "
                   "meta source track param".split())
BOILER_TAGS = frozenset("nav footer aside button dialog menu header".split())
FORM_TAGS = frozenset("form fieldset".split())
CONTROLS = frozenset("input button label".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar widget footer header masthead topbar toolbar "
    "notice notices cookie cookies consent gdpr alert popup newsletter subscribe subscription signup login searchbox "
    "share sharing social more-links pagination pager copyright".split())
WEAK_NAMES = frozenset("side rail foot head modal overlay search form legal skip".split())
READER_NAMES = frozenset("comment comments reply replies discussion disqus respond related recommended ad ads adv advert "
                         "adverts advertisement advertising sponsor sponsored promo promotion".split())
HEADINGS = frozenset("header head masthead".split())
CONTENT_NAMES = frozenset("article content main post entry story body text article-body post-content entry-content".split())
#: Names that begin so tell what a page has or lacks; endings that say nothing.
ABOUT = frozenset("no has with without hide show is".split())
GENERIC = frozenset("wrap wrapper container inner outer box area section block list item group".split())
#: An opening tag ends an open element of these first.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
BLOCK_STARTS_END_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())

RAW = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "select")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attrs>[^<>\"']*+>)?"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_STOP = re.compile(r"[<>]|=\s*+[\"']")
_ANGLE = re.compile("[<>]")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_ENDS = ".!?…。”\""
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[_-]+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    stated: int  # 1 content, -1 boilerplate, 0 nothing stated, by the nearest tag that says
    hints: tuple[int, int, int, int]  # names around: readers' and adverts', boilerplate, weak ones, content
    forms: tuple[Element, ...] = ()  # the outermost and the innermost form around, itself included
    controls: int = 0  # of a form
    prose: int = 0  # of a form: characters in whole sentences


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    linked: int
    inner: str  # tag of the first inline element, or ""

    @property
    def stated(self) -> int:
        if any(form.prose <= max(150, 100 * form.controls) for form in self.element.forms):
            return -1
        return self.element.stated


def attributes(attrs: str) -> dict[str, str]:
    """Values in lower case by name; of equal names the first one counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), (html.unescape(value) if "&" in value else value).lower())
    return found


def is_hidden(found: dict[str, str]) -> bool:
    """By a hidden attribute, aria-hidden, or the last display or visibility of the style."""
    if found.get("hidden", "false").strip() != "false" or found.get("aria-hidden", "").strip() == "true":
        return True
    style = dict(_SHOWN.findall(found.get("style", "")))
    return style.get("display") == "none" or style.get("visibility") == "hidden"


def named(found: dict[str, str], inside: bool) -> tuple[bool, bool, bool, bool]:
    """What the names of an element say: (readers' or advert, boilerplate, weak, content).
    A compound is what its last telling part says; one that also speaks of content is
    weak evidence, as is any next to a plain name of content."""
    readers = boiler = weak = content = plain = False
    for token in " ".join(found.get(a, "") for a in ("class", "id", "role")).split():
        parts = [p for p in _PARTS.split(token) if p]
        if not parts or len(parts) > 1 and parts[0] in ABOUT:
            continue
        if token in CONTENT_NAMES:
            plain = True
            continue
        while len(parts) > 1 and parts[-1] in GENERIC:
            parts.pop()
        head, mixed = parts[-1], not CONTENT_NAMES.isdisjoint(parts)
        if inside and (head in HEADINGS or token in HEADINGS):  # an article has headings of its own
            continue
        if not READER_NAMES.isdisjoint(parts):
            readers = True
        elif token in BOILER_NAMES or head in BOILER_NAMES and not mixed:
            boiler = True
        elif head in BOILER_NAMES or head in WEAK_NAMES or not BOILER_NAMES.isdisjoint(parts):
            weak = True
        elif head in CONTENT_NAMES:
            content = True
    return readers, boiler, weak and not plain, content or plain


def _open(tag: str, attrs: str, parent: Element) -> Element:
    stated, hints = parent.stated, parent.hints
    if tag in ("html", "body"):
        return Element(tag, parent, stated, hints, parent.forms)
    found = attributes(attrs) if attrs and len(attrs) > 4 else {}
    said = named(found, stated > 0) if found else (False,) * 4
    if tag in CONTENT_TAGS:
        if stated == 0 and not said[0]:
            stated = 1
        said = (said[0], False, False, said[3])  # a page's parts are listed in its article's names
    elif tag in BOILER_TAGS and not (tag == "header" and stated > 0):
        stated = -1
    if found and stated >= 0 and is_hidden(found):
        stated = -1
    if any(said):
        hints = tuple(min(2, a + b) for a, b in zip(hints, said))
    made = Element(tag, parent, stated, hints, parent.forms)
    if tag in FORM_TAGS:
        made.forms = (*parent.forms[:1], made)
    return made


def _tag_end(page: str, at: int, none: set[str]) -> int:
    """Where a tag whose attributes begin at ``at`` ends, or -1 if it is none. A quote
    behind "=" opens a value of any length; ``none`` holds the quotes that no longer
    occur. Without its closing quote a value ends at the next angle bracket."""
    quoted = False
    while m := _STOP.search(page, at):
        quote, at = m[0][-1], m.end()
        if quote in "\"'":
            close = -1 if quote in none else page.find(quote, at)
            if close >= 0:
                quoted, at = True, close + 1
                continue
            none.add(quote)
            if not (m := _ANGLE.search(page, at)):
                break
        if m[0] == ">":
            return m.end()
        return m.start() if quoted else -1
    return len(page) if quoted else -1


def _tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, "/" of an end tag, tag, attributes) in order; raw elements are left out."""
    at, none = 0, set()
    while at < len(page):
        m = _TOKEN.match(page, at)
        start, at, tag = at, m.end(), m["tag"]
        if tag is None:
            if m["text"] is not None:
                yield m["text"], "", "", ""
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if attrs is None:
            at = _tag_end(page, m.end(), none)
            if at < 0:
                yield "<", "", "", ""
                at = start + 1
                continue
            attrs = page[m.end():at]
        if tag in _RAW_END and not m["end"]:
            if tag != "svg" or not attrs.endswith("/>"):
                at = close.end() if (close := _RAW_END[tag].search(page, at)) else len(page)
            continue
        yield "", m["end"], tag, attrs


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order: white space inside is one space, none is empty."""
    root = Element("", None, 0, (0, 0, 0, 0))
    at, out, buffer, linked, inner, links, stack = root, [], [], 0, "", 0, []

    def flush():
        nonlocal linked, inner
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                out.append(Block(text, at, linked, inner))
                if at.forms and len(text) >= 60 and text[-1] in _ENDS and 2 * linked < len(text):
                    for form in at.forms:
                        form.prose += len(text)
            buffer.clear()
        linked, inner = 0, ""

    for text, end, tag, attrs in _tokens(page):
        if text:
            buffer.append(text)
            if links:
                linked += len(text)
            continue
        if at.forms and not end and tag in CONTROLS and "hidden" not in attrs.lower():
            at.forms[-1].controls += 1
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            if tag in ("br", "img"):
                buffer.append(" ")
            elif not end and not inner and not buffer:
                inner = tag
            continue
        flush()
        links = 0
        if end:
            if tag in stack:
                while stack:
                    at = at.parent
                    if stack.pop() == tag:
                        break
        elif tag not in VOID:
            ends = CLOSES.get(tag, ())
            while stack and (stack[-1] in ends or stack[-1] == "p" and tag in BLOCK_STARTS_END_P):
                stack.pop()
                at = at.parent
            if not attrs.endswith("/>") or tag in BLOCK_STARTS_END_P:
                at = _open(tag, attrs, at)
                stack.append(tag)
    flush()
    return out


N_FEATURES = 17


def look(found: list[Block]) -> np.ndarray:
    """Features of each block's look and of the names around it, without what tags state."""
    n, rows = len(found), []
    for i, b in enumerate(found):
        size, tag = len(b.text), b.element.tag
        rows.append((1.0, min(np.log1p(size), 8.0), min(1.0, b.linked / size), b.text[-1] in _ENDS,
                     min(3.0, b.text.count(",") * 50 / (size + 50)), b.text.count(" ") < 3,
                     tag == "p", tag in ("h1", "h2", "h3", "h4"), tag in ("li", "dt", "dd"),
                     tag in ("td", "th", "tr", "table"), tag in ("div", "section", "body"),
                     b.element.hints[3], i / n, "©" in b.text or "|" in b.text and size < 80,
                     *map(bool, b.element.hints[:3])))
    return np.array(rows, float).reshape(n, N_FEATURES)


#: Weights if a corpus has nothing to learn from (and the pull towards them).
PRIOR = np.array([-1.0, 0.5, -4.0, 0.8, 0.6, -0.4, 0.8, 0.6, -0.6, -0.2, -0.3, 0.8, -0.4, -1.5,
                  -12.0, -6.5, -2.5])


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.05, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighed alike, pulled towards
    ``PRIOR`` in proportion to the blocks: markup that always states the same must not
    outweigh what a block looks like on pages that state nothing."""
    w = PRIOR.copy()
    if not 0 < y.sum() < len(y):
        return w
    pull = pull * len(y)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + pull * (w - PRIOR)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


@dataclass
class Flow:
    """Maximum flow by shortest augmenting layers; arcs lie in pairs (i, i ^ 1)."""

    n: int
    to: list = field(default_factory=list)
    room: list = field(default_factory=list)
    arcs: list = field(default_factory=list)

    def __post_init__(self):
        self.arcs = [[] for _ in range(self.n)]

    def join(self, a: int, b: int, there: float, back: float) -> None:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _layers(self, source: int) -> list[int]:
        level, queue = [-1] * self.n, deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for i in self.arcs[a]:
                if self.room[i] > 1e-9 and level[self.to[i]] < 0:
                    level[self.to[i]] = level[a] + 1
                    queue.append(self.to[i])
        return level

    def run(self, source: int, sink: int) -> list[bool]:
        """Saturate the graph; returns which nodes can't reach the sink any more."""
        to, room = self.to, self.room
        while (level := self._layers(source))[sink] >= 0:
            at, path, node = [0] * self.n, [], source
            while True:
                if node == sink:
                    push = min(room[i] for i in path)
                    for i in path:
                        room[i] -= push
                        room[i ^ 1] += push
                    cut = next(k for k, i in enumerate(path) if room[i] <= 1e-9)
                    node = to[path[cut] ^ 1]
                    del path[cut:]
                elif at[node] < len(self.arcs[node]):
                    i = self.arcs[node][at[node]]
                    if room[i] > 1e-9 and level[to[i]] == level[node] + 1:
                        path.append(i)
                        node = to[i]
                    else:
                        at[node] += 1
                elif path:
                    node = to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
        reach, queue = [False] * self.n, deque([sink])
        reach[sink] = True
        while queue:
            b = queue.popleft()
            for i in self.arcs[b]:
                if room[i ^ 1] > 1e-9 and not reach[to[i]]:
                    reach[to[i]] = True
                    queue.append(to[i])
        return [not r for r in reach]


#: Capacity that a stated label adds (boilerplate, none, content), and capacities of smoothness edges.
STATED = {-1: -10.0, 0: 0.0, 1: 5.0}
NEXT, NEXT_FAR, SIBLING, COUSIN = 1.2, 0.2, 0.6, 0.2


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content: the source side of the minimum cut."""
    n = len(found)
    if not n:
        return []
    stated = [b.stated for b in found]
    odds = look(found) @ weights + np.array([STATED[x] for x in stated])
    if (odds >= 0).all() or (odds < 0).all():
        return [bool(odds[0] >= 0)] * n  # nothing to cut
    graph, last = Flow(n + 2), {}
    for i, (b, w) in enumerate(zip(found, odds.tolist())):
        if w >= 0:
            graph.join(n, i, w, 0.0)
        else:
            graph.join(i, n + 1, -w, 0.0)
        parent = b.element.parent
        if i:
            a = found[i - 1].element
            near = a is b.element or a.parent is parent and stated[i - 1] == stated[i]
            c = NEXT if near else NEXT_FAR
            graph.join(i - 1, i, c, c)
        for key, c in ((id(parent), SIBLING), (id(parent.parent) if parent else 0, COUSIN)):
            j = last.get((c, key))
            if j is not None and j < i - 1:
                graph.join(j, i, c, c)
            last[c, key] = i
    return graph.run(n, n + 1)[:n]


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found, weights)) if keep)


def train(pages: DataFrame, html_col: str = "html", sample: int = 1500) -> np.ndarray:
    """Weights from blocks whose label a tag states, on ``sample`` pages."""
    some = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("_html")).where("_html <> ''")
    some = hash_sample(some, sample, "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [np.empty((0, N_FEATURES))], [np.empty(0)]
            for page in batch.column(0).to_pylist():
                found = blocks(page)
                # an advert or comment inside an article is no example of content
                stated = np.array([0 if b.stated > 0 and any(b.element.hints[:2]) else b.stated for b in found])
                if len(found) and (stated != 0).any():
                    # a page counts as one, so that long pages don't outweigh others
                    x, y = look(found)[stated != 0], stated[stated != 0]
                    pick = np.unique(np.linspace(0, len(y) - 1, 24).astype(int))
                    xs.append(x[pick])
                    ys.append((y[pick] > 0).astype(float))
            x, y = np.concatenate(xs), np.concatenate(ys)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], names=["x", "y"])

    rows = some.mapInArrow(run, "x array<double>, y double").collect()
    if not rows:
        return PRIOR
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html", id_col: str = "page_id",
            url_col: str = "url") -> DataFrame:
    """``page_id, url, text`` of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = [main_text(p or "", weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("_html")).mapInArrow(run, "page_id long, url string, text string")
