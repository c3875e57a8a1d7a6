"""The main text of web pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import table

# --- fixed values: names in HTML -----------------------------------------------------------------------------------
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is no text at all, whatever stands in it.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video title textarea select button".split())
#: A new element of these names closes an open one beside it.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILER_TAGS = frozenset("nav aside footer form menu dialog header fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names. Those of layout give way to an article inside.
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social sidebar rail widget widgets related recommended recommendations nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead comment comments commentlist discussion disqus reply replies "
    "respond responses login search toolbar copyright legal disclaimer skip form teaser".split()
)
LAYOUT_NAMES = frozenset("sidebar rail header banner widget widgets masthead promo".split())
CONTENT_NAMES = frozenset("article content main post entry story".split())
NEGATED = frozenset("has with no without is not".split())
_CUES = re.compile(r"©|\(c\) \d{4}|all rights reserved|\bcookies?\b|subscribe|newsletter|advertis|sponsored|\blog ?in\b|\bsign ?(?:in|up)\b|share (?:this|on)|leave a (?:comment|reply)", re.I)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|([^>]*)(?:>|\Z))""",
    re.S,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[\s_-]+")

# --- parameters ----------------------------------------------------------------------------------------------------
#: Weights of a block's features (see ``features``) before anything is learnt, and how many blocks' worth they count against those seen.
PRIOR = (-1.0, 0.6, -4.0, 0.6, 0.5, -1.5)
PRIOR_BLOCKS = 50.0
#: Pages and blocks that the weights are learnt from at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 40_000
#: What text alone can say at most, and what structure adds for boilerplate and for content.
TEXT_RANGE, BOILER, CONTENT = (-2.5, 3.5), -8.0, 4.0
#: Capacities, in thousandths: between neighbours below one element and between others, a block and its element, an element and its parent,
#: and what of these is left across the border of an element that structure marks.
BESIDE, APART, INSIDE, ABOVE, BORDER = 800, 300, 500, 250, 0.1


@dataclass
class Block:
    """A run of text between the borders of block elements."""

    element: int
    tag: str
    mark: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks in page order; for every element its parent, and the mark that it sets (1 content, -1 boilerplate, 0 none)."""

    blocks: list[Block]
    parents: list[int]
    marks: list[int]


def _mark(tag: str, attributes: str, inside: int, soft: bool) -> tuple[int, bool]:
    """The mark below an element, from its own names and the mark around it, and whether only layout names say so."""
    names, role, hidden = [], "", False
    for m in _NAMES.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value.strip()
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            hidden = True
    if tag in ("html", "body"):
        return 0, False
    said = [p for p in (_SPLIT.split(n.strip("-_")) for n in names) if p[0] not in NEGATED]
    words = {w for p in said for w in (p[0], p[-1])}
    bad = words & BOILER_NAMES
    if hidden or role in BOILER_ROLES or bad - LAYOUT_NAMES or (tag in BOILER_TAGS and not (tag == "header" and inside > 0)):
        return -1, False
    if inside < 0 and not soft:
        return -1, False
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return 1, False
    if bad and inside <= 0:
        return -1, True
    if bad:
        return -1, False
    if inside == 0 and words & CONTENT_NAMES:
        return 1, False
    return inside, soft


def parse(page: str) -> Page:
    """Blocks of a page, well-formed or not: elements may be left open, closed twice, or cut by the end of the page."""
    out = Page([], [-1], [0])
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # name, element, mark, soft
    opened: Counter[str] = Counter()
    block: Block | None = None
    link, at = False, 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    def say(raw: str) -> None:
        nonlocal block
        if block is None:
            if raw.isspace():
                return
            name, element, mark, _ = stack[-1]
            block = Block(element, name, mark)
            out.blocks.append(block)
        block.parts.append(raw)
        if link:
            block.linked += len(raw)

    search = _MARKUP.search
    while (m := search(page, at)) is not None:
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCKS:
                block = None
                if opened[tag]:
                    link = False
                    while stack[-1][0] != tag:
                        pop()
                    pop()
        elif tag in SILENT:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?![\\w-])[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            link = True
        elif tag == "br":
            say(" ")
        elif tag in BLOCKS:
            block = None
            if stack[-1][0] == "p":
                pop()
            while stack[-1][0] in CLOSED_BY.get(tag, ()):
                pop()
            if tag in VOID:
                continue
            _, above, inside, soft = stack[-1]
            mark, soft = _mark(tag, attributes, inside, soft)
            out.parents.append(above)
            out.marks.append(mark if mark != inside else 0)
            stack.append((tag, len(out.parents) - 1, mark, soft))
            opened[tag] += 1
    if at < len(page):
        say(page[at:])
    for b in out.blocks:
        text = "".join(b.parts)
        b.text = " ".join((entities.unescape(text) if "&" in text else text).split())
    out.blocks = [b for b in out.blocks if b.text]
    return out


def features(b: Block) -> tuple[float, ...]:
    """One, doublings of the words, share of linked text, ends as a sentence does, is a heading, is short with words of notices."""
    words = b.text.count(" ") + 1
    linked = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
    return 1.0, math.log2(1 + words), linked, float(b.text[-1] in ".!?…。！？\"'”»"), float(b.tag in HEADINGS), float(words < 40 and _CUES.search(b.text) is not None)


def minimum_cut(lean: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a least cut. ``lean``: a node's capacity from the source if positive, to the sink if
    negative; links (u, v, capacity) go both ways. Flow is sent along shortest paths, level by level, until none is left; of all
    least cuts it is the one with the fewest nodes at the source."""
    n = len(lean)
    source, sink = [max(0, c) for c in lean], [max(0, -c) for c in lean]
    arcs: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for u, v, c in links:
        if c > 0:
            arcs[u].append(len(to))
            arcs[v].append(len(to) + 1)
            to += (v, u)
            room += (c, c)
    while True:
        level = [-1] * n
        reached = [u for u in range(n) if source[u]]
        for u in reached:
            level[u] = 0
        met = False
        for u in reached:
            met = met or sink[u] > 0
            for e in arcs[u]:
                v = to[e]
                if room[e] and level[v] < 0:
                    level[v] = level[u] + 1
                    reached.append(v)
        if not met:
            return [x >= 0 for x in level]
        turn = [0] * n
        for begin in range(n):
            while source[begin] and level[begin] == 0:
                u, path = begin, []
                while True:
                    if sink[u]:
                        flow = min(source[begin], sink[u], *[room[e] for e in path])
                        source[begin] -= flow
                        sink[u] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while turn[u] < len(arcs[u]):
                        e = arcs[u][turn[u]]
                        if room[e] and level[to[e]] == level[u] + 1:
                            break
                        turn[u] += 1
                    else:
                        if not path:
                            level[begin] = -2  # nothing more goes from here at this level
                            break
                        u = to[path.pop() ^ 1]
                        turn[u] += 1
                        continue
                    path.append(e)
                    u = to[e]


def label(page: Page, weights: tuple[float, ...]) -> list[bool]:
    """Which blocks are content: classifier costs against the capacities between neighbours and along the tree of elements."""
    low, high = TEXT_RANGE
    lean = [round(1000 * (min(high, max(low, sum(w * x for w, x in zip(weights, features(b))))) + (CONTENT if b.mark > 0 else BOILER if b.mark < 0 else 0.0))) for b in page.blocks]
    node: dict[int, int] = {}
    links = []
    cross = lambda c, border: round(c * (BORDER if border else 1))
    for i, b in enumerate(page.blocks):
        below, e = i, b.element
        capacity, border = INSIDE, False
        while True:
            new = e not in node
            if new:
                node[e] = len(lean)
                lean.append(0)
            links.append((below, node[e], cross(capacity, border)))
            if not new or page.parents[e] < 0:
                break
            below, capacity, border = node[e], ABOVE, page.marks[e] != 0
            e = page.parents[e]
        if i:
            a = page.blocks[i - 1]
            same = a.element == b.element or page.parents[a.element] == page.parents[b.element]
            links.append((i - 1, i, cross(BESIDE if same else APART, a.mark != b.mark)))
    return minimum_cut(lean, links)[: len(page.blocks)]


def extract(html: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The main text of one page: content blocks, one to a line."""
    page = parse(html or "")
    return "\n".join(b.text for b, content in zip(page.blocks, label(page, weights)) if content)


def learn(x: np.ndarray, is_content: np.ndarray, rounds: int = 25) -> tuple[float, ...]:
    """Weights of a logistic model whose best guess without any block is ``PRIOR``; both labels count alike, however often they occur."""
    prior = np.array(PRIOR)
    w = prior.copy()
    share = np.where(is_content, 0.5 / max(1, is_content.sum()), 0.5 / max(1, (~is_content).sum())) * len(x)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (is_content - p)) - PRIOR_BLOCKS * (w - prior)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_BLOCKS * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return tuple(map(float, np.round(w, 6)))


def block_features(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(x, content) of every block that stands in an element that structure marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(features(b), b.mark > 0) for b in parse(batch.column(0)[i].as_py() or "").blocks if b.mark]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows])], names=["x", "content"])

    return pages.select(html_col).mapInArrow(work, "x array<double>, content boolean")


def learnt_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS, html_col: str = "html") -> tuple[float, ...]:
    """Weights of the text features, learnt from the blocks whose structure tells what they are, in ``sample_pages`` pages with the least
    hashes; with none of these the prior holds. The sample depends on the pages alone, not on their order."""
    h = F.xxhash64(F.col(html_col))
    last = pages.filter(F.col(html_col).isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR
    chosen = pages.filter(h <= last).dropDuplicates([html_col])
    rows = block_features(chosen, html_col).orderBy(F.xxhash64("x"), "x", "content").limit(sample_blocks).toArrow()
    if not rows.num_rows:
        return PRIOR
    return learn(np.array(rows["x"].to_pylist()), rows["content"].to_numpy().astype(bool))


def main_text(pages: DataFrame, weights: tuple[float, ...] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has the empty text; rows that repeat give a row each; pages of any length are read whole; other columns
    don't matter. ``weights``: those of the text features, learnt from ``pages`` if not given. White space, also that of character
    references, becomes one space inside a block; a line break element is white space.
    """
    weights = weights or learnt_weights(pages, html_col=html_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, held = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(extract(batch.column(2)[i].as_py(), weights))
                held += len(texts[-1])
                if held > 1 << 22 or i == batch.num_rows - 1:
                    ids, urls = (batch.column(c).slice(begin, len(texts)) for c in range(2))
                    yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    begin, texts, held = i + 1, [], 0

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op11_main_text": op11_main_text}
ORACLE_SQL: dict[str, str] = {}
