"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags. A linear classifier on a block's own
words (how many, how many of them in links, a sentence's end, a heading) gives it a
cost for either label; they become the capacities of its edges to the terminals.
What the page's tree says comes in by smoothness edges. Neighbouring blocks, and
consecutive blocks under the same element or its parent, are joined by edges that
weaken with their distance in the tree. Regions of the page (an article, a menu, an
element named as an advert) are nodes of the graph too: each is tied to the terminal
that its markup speaks for and joined to the blocks inside it, so it draws them to its
side, and is itself overruled where many of them speak against a mere name. The
minimum cut (Dinic's maximum flow) labels all blocks and regions of the page at once.

The classifier is fitted to the pages at hand: a logistic regression on the blocks that
lie in an article, or in a menu, form, footer or comment area, of a bounded sample of
pages (``SAMPLE_PAGES``, by the hash of the id), drawn to the stated weights where
there are few. Its odds are kept below those of the regions that markup makes certain.

Defined results: null and empty pages have an empty text; unclosed and stray
tags are tolerated, a tag cut off by the end of the page is no text; character
references are decoded once; the text of buttons and selections is side text, that
of math, svg and object elements belongs to its surroundings; line breaks (``br``) are white space; repeated rows
get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import text_slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*)(>|\Z|(?=["']))|<[!?/][^>]*>?""",
                   re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names and naming habits of web pages.
BLOCK_TAGS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre section summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title".split())
#: Elements that count only if they are closed; a start tag without its end tag is passed over.
PAIRED_TAGS = frozenset("""noscript template iframe button select svg math object desc metadata annotation
    annotation-xml""".split())
#: Those of them whose text is not shown (some within another element only).
HIDDEN_TAGS = {"noscript": "", "template": "", "iframe": "", "desc": "svg", "metadata": "svg", "annotation": "math",
               "annotation-xml": "math"}
PAIR = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)
    |<(/?)({"|".join(sorted(PAIRED_TAGS, reverse=True))})(?=[\s/>])(?:[^"'>]|"[^"]*"|'[^']*')*>?""", re.DOTALL | re.IGNORECASE | re.VERBOSE)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
CLOSE_LIMIT = frozenset("ul ol menu dl table tr select".split())
#: Parts of a line whose text is a block of its own.
CONTROL_TAGS = frozenset("button select".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset button select option optgroup".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_NAMES = frozenset("""ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner
    sidebar side aside menu nav navbar navigation navi footer foot header masthead topbar breadcrumb breadcrumbs
    cookie cookies consent notice notices alert popup modal overlay comment comments respond reply replies disqus share
    sharing social related recommended newsletter subscribe signup login search pager pagination widget skip
    contentinfo complementary dialog toolbar disclaimer""".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
MAIN_NAMES = frozenset("article content main post entry story text body".split())

#: Words that say where or how an element stands or is made up, not what it is about.
NEUTRAL_NAMES = frozenset("""left right top bottom upper lower inner outer box container wrapper wrap area section block
    site page global primary secondary bar link links list item items menu group row col column small large fixed sticky
    mobile desktop content contents text body title label button form icon posts articles entries thread""".split())

#: Log-odds for content of a block by its own words, drawn to when the classifier is fitted:
#: bias, log of the number of words, share of words in links, a sentence's end, a heading.
WEIGHTS = (-0.5, 0.5, -3.0, 0.8, 0.3)
#: A block's own odds lie within; the regions that tags make certain pull harder.
OWN_MOST = 3.0
#: Pull of a region on a block inside it: an article, an element named as content, a side element.
IN_MAIN, IN_MAIN_NAME, IN_SIDE = 4.0, 1.5, 7.0
#: What it costs to overrule a region known by its tag, and one known by its name only.
BY_TAG, BY_NAME = 1e6, 20.0
SMOOTHNESS = 0.6
#: Pages whose blocks the classifier is fitted to, and the weight of the stated weights against them.
SAMPLE_PAGES, PRIOR_BLOCKS = 2_000, 200.0


class Block:
    """A block: its text, element and the element around that, whether it is a heading, how
    many of its characters are in links, and its regions: ``main``, ``named`` (numbers of
    elements, 0: none) and ``side`` (the innermost two, outermost first)."""

    __slots__ = ("text", "node", "parent", "main", "named", "side", "heading", "linked")

    def __init__(self, text, node, parent, main, named, side, heading, linked):
        self.text, self.node, self.parent = text, node, parent
        self.main, self.named, self.side, self.heading, self.linked = main, named, side, heading, linked


def _whole_names(attributes: str) -> list[set[str]]:
    """The words of each class, id and role of an element."""
    return [{x.lower() for x in NAME_PART.findall(name)}
            for m in ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split()]


def _evidence(tag: str, attributes: str, main: int) -> tuple[bool, bool, float]:
    """Whether an element is an article, is named as content, and how surely it is a side
    element (0: not). A name counts if all its words speak of the side, so neither
    ``share-price`` nor ``promo-story`` does."""
    names = _whole_names(attributes) if attributes else []
    if tag in SIDE_TAGS or (tag == "header" and not main):
        side = BY_TAG
    else:
        found = [n for n in names if n & SIDE_NAMES and n <= SIDE_NAMES | NEUTRAL_NAMES]
        if main:    # an article's own header holds its title
            found = [n for n in found if not n <= {"header", "head"} | NEUTRAL_NAMES]
        comments = any(n & COMMENT_NAMES for n in found)
        whole_page = tag in ("html", "body", "main", "article", "header")
        side = BY_TAG if comments else BY_NAME if found and not whole_page else 0.0
    return tag in MAIN_TAGS, any(n & MAIN_NAMES for n in names), side


def pairs_of(page: str) -> dict[int, int]:
    """Where the elements of ``PAIRED_TAGS`` begin and end; a start tag without an end tag is not in it."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for m in PAIR.finditer(page):
        if not m[3]:
            continue
        tag = m[3].lower()
        if not m[2]:
            if not m[0].endswith("/>"):
                begun.setdefault(tag, []).append(m.start())
        elif begun.get(tag):
            out[begun[tag].pop()] = m.end()
    return out


def blocks_of(page: str) -> tuple[list[Block], dict[int, float]]:
    """Text blocks in page order, and how surely each side region is one."""
    # An entry of the stack: tag, node, regions (main, named, side), whether in a link.
    stack = [("", 0, 0, 0, (), False)]
    sure: dict[int, float] = {}
    open_tags: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = nodes = at = 0
    pairs: dict[int, int] | None = None

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            top = len(stack) - 1
            while top and stack[top][0] not in BLOCK_TAGS and stack[top][0] not in CONTROL_TAGS:
                top -= 1
            tag, node, main, named, side, _ = stack[top]
            out.append(Block(text, node, stack[max(top - 1, 0)][1], main, named, side,
                             tag in ("h1", "h2", "h3", "h4", "h5", "h6"), linked))
        parts.clear()
        linked = 0

    def pop_to(size):
        for entry in stack[size:]:
            open_tags[entry[0]] -= 1
        del stack[size:]

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if stack[-1][5]:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS or tag in CONTROL_TAGS:
                flush()
            if open_tags.get(tag):
                size = len(stack) - 1
                while stack[size][0] != tag:
                    size -= 1
                pop_to(size)
            continue
        if m[4] != ">" and at >= end:
            break
        if tag in RAW_TAGS and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            if tag == "textarea" or tag in BLOCK_TAGS and not open_tags.get("svg"):
                flush()
            at = close.end() if close else end
            continue
        if tag in PAIRED_TAGS:
            if tag in CONTROL_TAGS:
                flush()
            if pairs is None:
                pairs = pairs_of(page)
            if stop not in pairs:
                continue
            if tag in HIDDEN_TAGS and (not HIDDEN_TAGS[tag] or open_tags.get(HIDDEN_TAGS[tag])):
                at = max(at, pairs[stop])
                continue
        elif open_tags.get("svg") or open_tags.get("math"):
            if tag == "text":
                parts.append(" ")
            if m[3].endswith("/"):
                continue
        if tag in BLOCK_TAGS:
            flush()
            if open_tags.get("p") and tag != "p" or tag == "p" and open_tags.get("p"):
                _close(stack, {"p"}, pop_to)
            if open_tags.get("option") and tag not in ("option", "optgroup"):
                _close(stack, {"option", "optgroup"}, pop_to)
            if tag in CLOSED_BY and any(open_tags.get(t) for t in CLOSED_BY[tag]):
                _close(stack, CLOSED_BY[tag], pop_to)
        if tag in VOID_TAGS:
            if tag == "br":
                parts.append(" ")
            continue
        nodes += 1
        _, _, main, named, side, link = stack[-1]
        is_main, is_named, is_side = _evidence(tag, m[3], main)
        if is_side:
            sure[nodes] = is_side
            side = (*side[-1:], nodes)
        stack.append((tag, nodes, nodes if is_main and not main else main, nodes if is_named else named, side, link or tag == "a"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out, sure


def _close(stack, tags, pop_to):
    """Close the innermost of ``tags`` unless another container stands in between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in tags:
            pop_to(k)
            return
        if stack[k][0] in CLOSE_LIMIT or ("p" in tags and stack[k][0] in BLOCK_TAGS):
            return


def features(b: Block) -> tuple[float, ...]:
    words = b.text.count(" ") + 1
    return (1.0, math.log1p(min(words, 60)), min(b.linked / len(b.text), 1.0) * (not b.main),
            float(b.text[-1] in ".!?…。"), float(b.heading))


def log_odds(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """The classifier's odds for content from the block's own words."""
    z = sum(w * x for w, x in zip(weights, features(b), strict=True))
    return max(-OWN_MOST, min(OWN_MOST, z))


def fitted(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression drawn to ``WEIGHTS``, both labels of equal weight; ``rows`` are
    the ``features`` of blocks. Newton's method from the stated weights."""
    w = prior = np.array(WEIGHTS)
    if not labels.any() or labels.all():
        return WEIGHTS
    share = np.where(labels, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (share * (labels - p)) - PRIOR_BLOCKS * (w - prior)
        curve = (rows * (share * p * (1 - p))[:, None]).T @ rows + PRIOR_BLOCKS * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[float, ...]:
    """The classifier's weights, from the blocks of about ``SAMPLE_PAGES`` pages whose
    region a tag makes certain. At most a few numbers for each kind of block are collected:
    the features are counted, not listed."""
    n = pages.select(id_col).count()
    picked = pages.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < SAMPLE_PAGES / max(n, 1) * (1 << 30))

    def run(batches):
        counts: Counter = Counter()
        for _, texts in text_slices(batches, 0):
            for page in texts:
                blocks, sure = blocks_of(page.decode())
                for b in blocks:
                    by_tag = bool(b.side) and max(sure[r] for r in b.side) == BY_TAG
                    if by_tag or (b.main and not b.side):
                        _, words, linked, end, heading = features(b)
                        counts[round(words, 1), round(linked, 1), end, heading, not by_tag] += 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k, _ in rows], pa.float64()) for j in range(4)),
             pa.array([k[4] for k, _ in rows], pa.bool_()), pa.array([v for _, v in rows], pa.int64())],
            names=["words", "linked", "sentence", "heading", "content", "n"])

    found = (picked.select(html_col).mapInArrow(run, "words double, linked double, sentence double, heading double, content boolean, n long")
             .groupBy("words", "linked", "sentence", "heading", "content").agg(F.sum("n").alias("n"))
             .orderBy("words", "linked", "sentence", "heading", "content").toPandas())
    if not len(found):
        return WEIGHTS
    rows = np.column_stack([np.ones(len(found)), found[["words", "linked", "sentence", "heading"]].to_numpy(float)])
    times = found["n"].to_numpy()
    return fitted(np.repeat(rows, times, axis=0), np.repeat(found["content"].to_numpy(bool), times))


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges: dict[tuple[int, int], float] = {}
    seen: dict[tuple[str, int], int] = {}
    for i, b in enumerate(blocks):
        near = [(i - 1, 0.5)] if i else []
        for kind, node, weight in (("node", b.node, 1.0), ("parent", b.parent, 0.7), ("node", b.parent, 0.5)):
            if (kind, node) in seen:
                near.append((seen[kind, node], weight))
        for j, weight in near:
            if j != i:
                edges[j, i] = max(edges.get((j, i), 0.0), SMOOTHNESS * weight)
        seen["node", b.node] = seen["parent", b.parent] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def content_side(to_content: list[float], to_side: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut between the terminals content and side: a block with the label
    content pays ``to_side``, one with the other label ``to_content``."""
    n = len(to_content)
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a, b, forth, back):
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    source, sink = n, n + 1
    for i in range(n):   # what flows straight through a block needs no search
        straight = min(to_content[i], to_side[i])
        if to_content[i] > straight:
            add(source, i, to_content[i] - straight, 0.0)
        elif to_side[i] > straight:
            add(i, sink, to_side[i] - straight, 0.0)
    for i, j, w in edges:
        add(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while turn[v] < len(head[v]):
                e = head[v][turn[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(head[v]):
                path.append(head[v][turn[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                level[v] = -1
                v = to[path.pop() ^ 1]


def labels_of(page: str, weights: tuple[float, ...] = WEIGHTS) -> list[tuple[str, float, bool]]:
    """The blocks of a page: text, the classifier's odds, and the label of the minimum cut."""
    blocks, sure = blocks_of(page)
    if not blocks:
        return []
    odds = [log_odds(b, weights) for b in blocks]
    to_content = [math.log1p(math.exp(z)) for z in odds]
    to_side = [math.log1p(math.exp(-z)) for z in odds]
    edges = smoothness(blocks)
    # The regions' nodes come after the blocks: an article or a named element is drawn to
    # content, a side element away from it.
    number: dict[tuple[str, int], int] = {}

    def region(kind, node, for_content, for_side):
        if (kind, node) not in number:
            number[kind, node] = len(to_content)
            to_content.append(for_content)
            to_side.append(for_side)
        return number[kind, node]

    for i, b in enumerate(blocks):
        if b.main:
            edges.append((i, region("main", b.main, BY_TAG, 0.0), IN_MAIN))
        if b.named:
            edges.append((i, region("named", b.named, BY_NAME, 0.0), IN_MAIN_NAME))
        for node in b.side:
            edges.append((i, region("side", node, 0.0, sure[node]), IN_SIDE))
    keep = content_side(to_content, to_side, edges)
    return [(b.text, z, k) for b, z, k in zip(blocks, odds, keep, strict=False)]


def main_text(page: str, weights: tuple[float, ...] = WEIGHTS) -> str:
    return "\n".join(text for text, _, kept in labels_of(page, weights) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page."""
    weights = fit(pages, id_col, html_col)
    lead = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    kinds = [f.dataType.simpleString() for f in lead.schema.fields]

    def run(batches):
        for batch, texts in text_slices(batches, 2):
            found = [main_text(t.decode(), weights) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return lead.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
