"""Main text of web pages by minimum-cut labelling of their text blocks.

**Blocks.**  A page is read tag by tag into text blocks, each with its chain of open elements.  Block-level
tags bound a block, inline tags do not; scripts, styles and the head have none.

**Classifier.**  What a block costs as boilerplate and as content is the log odds of two parts.  *Cues* come from
the elements around it (fixed values): article and main for content; nav, header, footer, aside, form and
names such as ``sidebar`` or ``comments`` against it.  *Shape* is a naive Bayes model over the block's
length, links, ending and signs.  It is counted in Spark over a hash sample of about ``SAMPLE_PAGES`` pages, where
cues are the labels, on top of prior counts, so that pages without any cue are judged too.

**Cut.**  Each block is a node.  Its costs are the capacities from the source and to the sink; an edge
joins a block to the next one in the page and to the next one of the same parent, the stronger the nearer
they lie in the element tree.  The minimum cut, by augmenting along shortest paths, is the labelling of
least total cost; blocks that could be on either side are content.

Defined cases: null or empty html and pages without content give an empty text; tags left open end with
their parents; a comment, tag or script left open takes the rest of the page; repeated rows each give a row; a
null url or id is passed on; very long pages are handled whole, in memory that grows with the page; an empty
table gives an empty result; other columns of the table are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import batch_of, in_worker, long_texts

#: Pages that the shape model is counted on, about (pages are chosen by a hash of id and url).
SAMPLE_PAGES = 20_000

# --- fixed values: HTML elements ----------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without text of the page.
NO_TEXT = frozenset("script style head title template noscript iframe noembed noframes object svg math canvas audio video map "
                    "select datalist option textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br img input".split())
HEAD_TAGS = frozenset("title meta link base script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre search section table ul".split())
CELL = frozenset("td th table caption".split())
#: Start tag -> (the open elements it ends, the elements that keep it from looking further up).
ENDS = {"li": (frozenset(["li"]), BLOCKS - frozenset("p div address".split()) | CELL), "dt": (frozenset("dt dd".split()), frozenset(["dl"]) | CELL),
        "dd": (frozenset("dt dd".split()), frozenset(["dl"]) | CELL), "tr": (frozenset("tr td th".split()), frozenset(["table"])),
        "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
        "option": (frozenset(["option"]), frozenset(["select"])), **{t: (frozenset(["p"]), CELL | frozenset("button object".split())) for t in BLOCKS}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# --- fixed values: cues, in log odds for content ----------------------------------------------

TAG_CUES = {"article": 6.0, "main": 4.0, "nav": -15.0, "footer": -15.0, "header": -13.0, "aside": -15.0, "menu": -15.0, "dialog": -15.0, "search": -15.0}
ROLE_CUES = {"main": 4.0, "article": 6.0, "navigation": -15.0, "banner": -13.0, "contentinfo": -15.0, "complementary": -15.0, "search": -15.0, "form": -15.0,
             "dialog": -15.0, "alert": -15.0, "alertdialog": -15.0, "menu": -15.0, "menubar": -15.0, "tablist": -15.0, "status": -15.0}
#: Words in class and id names, singular; a plural s is dropped before the look-up.
CONTENT_NAMES = frozenset("article articlebody post postbody entry story content maincontent main prose".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation topnav sidenav subnav menu dropdown sidebar aside footer foot topbar toolbar breadcrumb pagination pager "
    "cookie consent gdpr notice notification alert popup modal overlay toast "
    "ad advert advertisement adsense adsbygoogle advertising sponsor sponsored promo promotion promoted "
    "share sharing social follow related recommended recommendation popular trending newsletter subscribe subscription signup login register search "
    "copyright legal disclaimer".split())
HEADER_NAMES = frozenset("header head masthead banner".split())
COMMENT_NAMES = frozenset("comment commentlist commentform disqus reply replie respond response discussion".split())
NAME_CUE = {"content": 2.0, "boilerplate": -14.0, "comment": -20.0, "form": -15.0}
HIDDEN_CUE = -15.0
#: A form or an element with a boilerplate name that holds more of the page's text is its frame, if no article, main or content name tells.
FRAME_SHARE = 0.6
#: Bound of the shape's part, so that no shape outweighs a clear cue.
SHAPE_BOUND = 2.5
#: Weight of an edge between neighbours of one parent; it falls with the way between them in the element tree.
SMOOTHNESS = 3.0
#: Prior counts of the shape model: feature, value -> (content, boilerplate); others (1, 1).
PRIOR = {("words", 0): (1, 3), ("words", 1): (2, 3), ("words", 2): (3, 2), ("words", 3): (5, 1), ("words", 4): (6, 1), ("links", 0): (3, 2),
         ("links", 1): (3, 1), ("links", 2): (1, 4), ("links", 3): (1, 8), ("end", 1): (4, 1), ("end", 0): (2, 3), ("signs", 0): (20, 14), ("signs", 1): (1, 6)}
CAPACITY = 1000  # whole capacities, thousandths


TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))""",
                 re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSED = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*\Z")
SIGNS = re.compile(r"©|\(c\) ?(?:19|20)\d\d|all rights reserved|cookie|subscribe|sign up|log ?in\b|read more|privacy policy|advertis", re.I)


class Page:
    """Elements (parent, tag, cue) and blocks (text, characters in links, element) of one page."""

    def __init__(self, html: str):
        self.parents, self.tags, self.cues, self.depths = [-1], ["#page"], [0.0], [0]
        self.doubtful: list[tuple[int, float]] = []  # elements whose cue holds unless they are the page's frame
        self.frames: set[int] = set()  # the first article or main and all around it; else the largest element with a content name
        self.contents: list[int] = []  # elements with a content name
        self.headers: set[int] = set()  # elements that are headers by tag or name
        self.headed: set[int] = set()  # elements around a first-level heading
        self.blocks: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = self.silent = 0
        self.link: int | None = None
        self.open = [0]
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.read(html)
        sizes = [0] * len(self.parents)
        for text, _, element in self.blocks:
            sizes[element] += len(text)
        for element in range(len(sizes) - 1, 0, -1):
            sizes[self.parents[element]] += sizes[element]
        if not self.frames and self.contents:
            around = max(self.contents, key=sizes.__getitem__)
            while around > 0:
                self.frames.add(around)
                around = self.parents[around]
        for element, cue in self.doubtful:
            if not (element in self.frames if self.frames else sizes[element] > FRAME_SHARE * sizes[0]):
                self.cues[element] = min(self.cues[element], cue)

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.end(name)
                continue
            attributes = m[3] or m[6] or ""
            self.start(name, attributes)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = close.start() if close else n
        if at < n:
            self.text(html[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if not self.silent:
            part = unescape(raw) if "&" in raw else raw
            self.parts.append(part)
            if self.link is not None:
                self.linked += len(part)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, next(e for e in reversed(self.open) if self.tags[e] not in INLINE)))
        self.parts.clear()
        self.linked = 0

    def close_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.counts[self.tags[element]] -= 1
            self.silent -= self.tags[element] in NO_TEXT
            if element == self.link:
                self.link = None
        del self.open[depth:]

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.flush()
        elif name == "br":
            self.parts.append(" ")
        if self.tags[self.open[-1]] == "head" and name not in HEAD_TAGS:
            self.close_to(len(self.open) - 1)
        ended, within = ENDS.get(name, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1) if any(self.counts[t] for t in ended) else ():
            tag = self.tags[self.open[depth]]
            if tag in ended:
                self.close_to(depth)
                if name != "tr":
                    break
            elif tag in within:
                break
        if name in VOID:
            return
        element = len(self.parents)
        self.parents.append(self.open[-1])
        self.tags.append(name)
        self.depths.append(self.depths[self.open[-1]] + 1)
        self.cues.append(self.cue(element, name, attributes))
        self.open.append(element)
        self.counts[name] += 1
        self.silent += name in NO_TEXT
        if name == "a":
            self.link = element
        elif name == "h1":
            self.headed.update(self.open)
        elif name in ("article", "main") and not self.frames and all(self.cues[e] >= 0 for e in self.open):
            self.frames.update(self.open)

    def end(self, name: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1) if self.counts[name] else ():
            tag = self.tags[self.open[depth]]
            if tag == name:
                if name not in INLINE or any(self.tags[e] not in INLINE for e in self.open[depth:]):
                    self.flush()
                self.close_to(depth)
                return
            if name in INLINE and tag not in INLINE:
                return  # an inline end tag does not close blocks
        if name not in INLINE:
            self.flush()

    def cue(self, element: int, name: str, attributes: str) -> float:
        cue = TAG_CUES.get(name, 0.0)
        if name == "form":
            self.doubtful.append((element, NAME_CUE["form"]))
        elif name == "header":
            self.headers.add(element)
        if not attributes or name in ("html", "body", *INLINE):
            return cue
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = ROLE_CUES.get(found.get("role", "").strip().lower())
        if role is not None:
            cue = min(cue, role) if role < 0 else max(cue, role) if cue >= 0 else cue
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            cue = min(cue, HIDDEN_CUE)
        words = set()
        for part in NAME_PART.findall(f"{found.get('class', '')} {found.get('id', '')}"):
            words |= {part.lower(), part.lower().removesuffix("s")}
        if words & COMMENT_NAMES:
            return min(cue, NAME_CUE["comment"])
        if words & BOILERPLATE_NAMES:
            self.doubtful.append((element, NAME_CUE["boilerplate"]))
        elif words & HEADER_NAMES:
            self.headers.add(element)
            self.doubtful.append((element, NAME_CUE["boilerplate"]))
        elif words & CONTENT_NAMES and cue >= 0:
            cue = max(cue, NAME_CUE["content"])
            self.contents.append(element)
        return cue

    def chain_cues(self) -> list[float]:
        """For each element the cue that holds inside it: the strongest against content on the way up, else the strongest for it."""
        worst, best = [0.0], [0.0]
        for e in range(1, len(self.parents)):
            p = self.parents[e]
            own = self.cues[e]
            if e in self.headers and e in self.headed and best[p] > 0:
                own = 0.0  # the head of an article, with its heading
            worst.append(min(worst[p], own))
            best.append(max(best[p], own))
        return [w if w < 0 else b for w, b in zip(worst, best)]

    def distance(self, a: int, b: int) -> int:
        """Steps from one element to another in the tree."""
        steps = 0
        while a != b:
            if self.depths[a] < self.depths[b]:
                a, b = b, a
            a = self.parents[a]
            steps += 1
        return steps


# --- classifier ---------------------------------------------------------------------------


def shape(text: str, linked: int) -> tuple[tuple[str, int], ...]:
    """The shape features of a block: (feature, value)."""
    words = text.count(" ") + 1
    density = linked / len(text)
    return (("words", 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 50 else 4),
            ("links", 0 if not linked else 1 if density < 0.3 else 2 if density < 0.7 else 3),
            ("end", int(CLOSED.search(text[-8:]) is not None)), ("signs", int(len(text) < 400 and SIGNS.search(text) is not None)))


def shape_odds(counts: dict[tuple[str, int, int], float]) -> dict[tuple[str, int], float]:
    """Log odds for content of each (feature, value), from counts of (feature, value, label) and the prior counts."""
    values = {(f, v) for f, v, _ in counts} | set(PRIOR)
    got = {(f, v): [PRIOR.get((f, v), (1, 1))[1 - c] + counts.get((f, v, c), 0) for c in (0, 1)] for f, v in values}
    totals: dict[str, list[float]] = {}
    for (f, _), (no, yes) in got.items():
        t = totals.setdefault(f, [0.0, 0.0])
        t[0] += no
        t[1] += yes
    return {(f, v): math.log(yes / totals[f][1]) - math.log(no / totals[f][0]) for (f, v), (no, yes) in got.items()}


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[tuple[str, int], float]:
    """Shape odds counted in Spark; only the counts of some twenty (feature, value, label) reach the driver.

    Labels are the cues: blocks under a cue for content, or against it.  Every page counts at most once for each
    (feature, value, label), in shares, so that one page of many blocks weighs as much as another.
    """
    schema = pa.schema([("feature", pa.string()), ("value", pa.int32()), ("label", pa.int32()), ("n", pa.float64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, float] = {}
        for b in batches:
            for at in range(b.num_rows):
                in_worker()
                page = Page(b.column(0)[at].as_py() or "")
                cues = page.chain_cues()
                labelled = [(shape(text, linked), int(cues[e] > 0)) for text, linked, e in page.blocks if cues[e]]
                for features, label in labelled:
                    for f, v in features:
                        sums[f, v, label] = sums.get((f, v, label), 0.0) + 1 / len(labelled)
        if sums:
            yield batch_of(schema, **dict(zip(schema.names, zip(*((*k, n) for k, n in sums.items())))))

    n = pages.count()
    share = min(1.0, sample_pages / n) if n else 1.0
    chosen = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = (chosen.select(F.col("html").cast("string")).mapInArrow(count, "feature string, value int, label int, n double")
                    .groupBy("feature", "value", "label").agg(F.sum("n").alias("n")))
    return shape_odds({(r["feature"], r["value"], r["label"]): r["n"] for r in counts.collect()})


# --- minimum cut ----------------------------------------------------------------------------


def minimum_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is content in the labelling of least cost (the largest such set of nodes).

    ``unary[i]`` > 0 is what node i costs as boilerplate, < 0 what it costs as content; an edge (i, j, w) costs w
    if its ends differ.  Augments along shortest paths, phase by phase (level graph and blocking flow).
    """
    n = len(unary)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[int] = []

    def arc(a: int, b: int, forth: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        left.append(forth)
        heads[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            arc(source, i, u, 0)
        elif u < 0:
            arc(i, sink, -u, 0)
    for i, j, w in edges:
        arc(i, j, w, w)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in heads[a]:
                if left[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        tried = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not left[e])
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[node] < len(heads[node]):
                e = heads[node][tried[node]]
                if left[e] > 0 and level[to[e]] == level[node] + 1:
                    break
                tried[node] += 1
            else:
                if not path:
                    break
                node = to[path.pop() ^ 1]
                tried[node] += 1
                continue
            path.append(e)
            node = to[e]

    reaches = [False] * (n + 2)  # the sink, in what capacity is left
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        a = queue.popleft()
        for e in heads[a]:
            if left[e ^ 1] > 0 and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return [not r for r in reaches[:n]]


def costs(page: Page, odds: dict[tuple[str, int], float]) -> list[int]:
    """Each block's capacity: log odds for content, in thousandths."""
    cues = page.chain_cues()
    out = []
    for text, linked, element in page.blocks:
        by_shape = sum(odds.get(f, 0.0) for f in shape(text, linked))
        if page.tags[element] in HEADINGS:
            by_shape = max(by_shape, 0.0)  # short by nature
        out.append(round(CAPACITY * (cues[element] + max(-SHAPE_BOUND, min(SHAPE_BOUND, by_shape)))))
    return out


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges between neighbours in the page, and between a block and the next one of the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, (_, _, element) in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, round(CAPACITY * SMOOTHNESS / max(1, page.distance(page.blocks[i - 1][2], element) - 1))))
        parent = page.parents[element]
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, round(CAPACITY * SMOOTHNESS)))
        last[parent] = i
    return edges


def main_text(html: str, odds: dict[tuple[str, int], float]) -> str:
    """The content blocks of a page, one a line."""
    page = Page(html)
    content = minimum_cut(costs(page, odds), smoothness(page))
    return "\n".join(b[0] for b, keep in zip(page.blocks, content) if keep)


def extract(pages: DataFrame, odds: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row a page; ``odds`` of the shape model, by default trained on ``pages``."""
    long_texts(pages.sparkSession)
    odds = train(pages) if odds is None else odds
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                in_worker()
                part = b.slice(at, 64)
                texts = [main_text(h.as_py() or "", odds) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
