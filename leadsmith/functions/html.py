"""What the extraction operators need of an HTML page, read in one forward scan.

``page_parts`` and ``posting_texts`` are the one place where markup is read by a
program instead of a pattern: small Arrow functions that walk a page once from left
to right, keep where its elements and texts lie, and return only what was asked
for. No step goes back: the end of a tag is found from the quotes and ``>`` ahead,
each of which is looked at once, so a page that is cut off in a tag, or holds an odd
quote or thousands of stray ``<``, costs no more than any other of its length.
"""

from __future__ import annotations

import html as _html
import re
import sys
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

_START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_MARK = re.compile(r"""["'>]""")
# A whole tag: its name, and up to the first ``>`` outside quotes.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
_TAG_LENGTH = 256       # a longer tag is left to _TagEnds, so a look at a tag without an end stays short
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_JSON_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]"]', re.DOTALL)
_JSON_SCALAR = re.compile(r'[^\s{}\[\]",:]+')
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in ("script", "style")}


class _TagEnds:
    """Where a tag ends: at the first ``>`` outside quotes. What lies ahead of a mark
    (a quote or ``>``) outside quotes is found once and remembered."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.asked, self.mark = 0, 0

    def next_mark(self, pos: int) -> int:
        """The first mark from ``pos`` on, -1 if none. The positions asked for by tags
        rise, so a mark that still lies ahead is the answer again."""
        if not (self.asked <= pos <= self.mark or self.mark < 0 <= self.asked <= pos):
            m = _MARK.search(self.page, pos)
            self.asked, self.mark = pos, m.start() if m else -1
        return self.mark

    def after(self, pos: int) -> int:
        """Position of the ``>`` that ends the tag whose name ends at ``pos``, -1 if none."""
        page, known, passed = self.page, self.known, []
        mark = self.next_mark(pos)
        while mark >= 0 and mark not in known and page[mark] != ">":
            passed.append(mark)
            shut = page.find(page[mark], mark + 1)
            m = _MARK.search(page, shut + 1) if shut >= 0 else None
            mark = m.start() if m else -1
        end = known.get(mark, mark)
        for p in passed:
            known[p] = end
        return end


class _Page:
    """Elements and texts of a page in document order. ``tags``, ``parents``: of each
    element; ``spans``: where its attributes are written; ``first``/``last``: the numbers
    of the texts inside it are first..last-1; ``until``: number of the first element
    after its descendants; ``owner``: of each text, the element around it (-1: none);
    ``raw``: bodies of scripts and styles by element."""

    def __init__(self, page: str):
        self.page = page
        self.tags, self.parents, self.spans, self.first, self.last, self.until = [], [], [], [], [], []
        self.texts, self.owner, self.raw = [], [], {}
        self._read: dict[int, dict[str, str]] = {}
        self._scan()

    def _text(self, start: int, stop: int, stack: list[int]) -> None:
        if stop > start:
            text = self.page[start:stop]
            self.texts.append(_html.unescape(text) if "&" in text else text)
            self.owner.append(stack[-1] if stack else -1)

    def _close(self, stack: list[int], size: int, counts: dict[str, int]) -> None:
        for n in stack[size:]:
            self.last[n], self.until[n] = len(self.texts), len(self.tags)
            counts[self.tags[n]] -= 1
        del stack[size:]

    def _scan(self) -> None:
        page, end, ends = self.page, len(self.page), _TagEnds(self.page)
        stack: list[int] = []
        counts: dict[str, int] = {}
        text_from = pos = 0
        while start := _START.search(page, pos):
            at = start.start()
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                self._text(text_from, at, stack)
                text_from = pos = end if stop < 0 else stop + 3
                continue
            if page[at + 1] in "!?":
                stop = page.find(">", at + 2)
                self._text(text_from, at, stack)
                text_from = pos = end if stop < 0 else stop + 1
                continue
            if whole := _TAG.match(page, at, at + _TAG_LENGTH):
                closing, tag, name_end, stop = whole[1], whole[2].lower(), whole.end(2), whole.end() - 1
            else:
                closing = page.startswith("/", at + 1)
                name = _NAME.match(page, at + 1 + closing)
                tag, name_end, stop = name[0].lower(), name.end(), ends.after(name.end())
                if stop < 0:
                    pos = at + 1        # not a tag: text
                    continue
            if at > text_from:
                self._text(text_from, at, stack)
            text_from = pos = stop + 1
            if closing:
                if counts.get(tag):
                    size = len(stack) - 1
                    while self.tags[stack[size]] != tag:
                        size -= 1
                    self._close(stack, size, counts)
                continue
            n = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1] if stack else -1)
            self.spans.append((name_end, stop))
            self.first.append(len(self.texts))
            self.last.append(len(self.texts))
            self.until.append(n + 1)
            if tag in _VOID or page[stop - 1] == "/" and stop > name_end:
                continue
            if tag in _RAW:
                shut = _RAW[tag].search(page, pos)
                self.raw[n] = page[pos:shut.start() if shut else end]
                text_from = pos = shut.end() if shut else end
                continue
            stack.append(n)
            counts[tag] = counts.get(tag, 0) + 1
        self._text(text_from, end, stack)
        self._close(stack, 0, counts)

    def attributes(self, n: int) -> dict[str, str]:
        found = self._read.get(n)
        if found is None:
            found = self._read[n] = {}
            start, stop = self.spans[n]
            if stop > start:
                for a in _ATTRIBUTE.finditer(self.page, start, stop):
                    found.setdefault(a[1].lower(), _html.unescape(a[2] or a[3] or a[4] or ""))
        return found

    def inner(self, n: int, sep: str = "") -> str:
        """The text of an element, up to its own end tag (-1: of the page)."""
        return sep.join(self.texts[self.first[n]:self.last[n]] if n >= 0 else self.texts)


def _has_classes(attributes: dict[str, str], names: list[str]) -> bool:
    written = attributes.get("class", "")
    for n in names:
        if n not in written:
            return False
    return set(names) <= set(written.split())


def _json_texts(body: str) -> list[str]:
    """The JSON texts of a script body one after another; what is no text begins the
    last one, which does not parse."""
    found, at, end = [], 0, len(body)
    while at < end:
        if body[at].isspace():
            at += 1
            continue
        start, depth = at, 0
        if body[at] in '{["':
            for m in _JSON_TOKEN.finditer(body, at):
                if m[0] == '"':
                    break       # a string without an end
                depth += (m[0] in "{[") - (m[0] in "}]")
                at = m.end()
                if depth <= 0:
                    break
            else:
                depth = 1
            if depth > 0 or at == start:
                return [*found, body[start:]]
        elif m := _JSON_SCALAR.match(body, at):
            at = m.end()
        else:
            return [*found, body[start:]]
        found.append(body[start:at])
    return found


def _label_segments(doc: _Page, label) -> list[str]:
    """The texts of the elements around the texts that hold a label; an element inside
    another such element is part of that one."""
    held = sorted({o for o, text in zip(doc.owner, doc.texts, strict=True) if label.search(text)})
    if held and held[0] < 0:
        return [doc.inner(-1, " ")]
    segments, covered = [], 0
    for n in held:
        if n >= covered:
            segments.append(doc.inner(n, " "))
            covered = doc.until[n]
    return segments


def page_parts(label_pattern: str):
    """A function of a page's HTML: ``iframes`` (their ``src``), ``segments`` (the texts of
    the outermost elements that directly hold a text with the label) and ``json``: the JSON texts of each
    ``ld+json`` script."""
    kind = T.StructType([T.StructField("iframes", T.ArrayType(T.StringType())),
                         T.StructField("segments", T.ArrayType(T.StringType())),
                         T.StructField("json", T.ArrayType(T.ArrayType(T.StringType())))])

    def run(pages: pa.Array) -> pa.Array:
        label = re.compile(label_pattern)
        iframes, segments, scripts = [], [], []
        for page in pages.to_pylist():
            if not page:
                iframes.append([])
                segments.append([])
                scripts.append([])
                continue
            doc = _Page(page)
            iframes.append([doc.attributes(n).get("src", "") for n, t in enumerate(doc.tags) if t == "iframe"])
            segments.append(_label_segments(doc, label))
            scripts.append([_json_texts(body) for n, body in doc.raw.items()
                            if doc.tags[n] == "script" and "ld+json" in doc.attributes(n).get("type", "").lower()])
        texts = pa.list_(pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(iframes, texts), pa.array(segments, texts), pa.array(scripts, pa.list_(texts))],
            names=["iframes", "segments", "json"])

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def card_links(card_tag: str, link_classes: list[str]):
    """A function of a page's HTML: for every card the ``href`` of the first link with the
    classes inside it (null if it holds none)."""
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            doc = _Page(page or "")
            links = [n for n, t in enumerate(doc.tags) if t == "a" and _has_classes(doc.attributes(n), link_classes)]
            hrefs = []
            for n in (n for n, t in enumerate(doc.tags) if t == card_tag):
                k = bisect_right(links, n)
                hrefs.append(doc.attributes(links[k]).get("href") if k < len(links) and links[k] < doc.until[n] else None)
            out.append(hrefs)
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))


class _Blocks:
    """The ``div`` blocks of a page and the elements in them, each kind looked up once."""

    def __init__(self, page: str):
        self.doc = doc = _Page(page)
        self.divs = [(n, doc.attributes(n)) for n, t in enumerate(doc.tags) if t == "div"]
        self.whole = "".join(doc.texts)
        self.offset = [0]
        for t in doc.texts:
            self.offset.append(self.offset[-1] + len(t))
        self.targets: dict[tuple, list[int]] = {}
        self.places: dict[str, list[int]] = {}

    def holds(self, n: int, text: str) -> bool:
        """Whether the block's text contains ``text``, in any case."""
        if text not in self.places:
            self.places[text] = [m.start() for m in re.finditer(re.escape(text), self.whole, re.IGNORECASE)]
        k = bisect_left(self.places[text], self.offset[self.doc.first[n]])
        return k < len(self.places[text]) and self.places[text][k] + len(text) <= self.offset[self.doc.last[n]]

    def target(self, n: int, wanted: tuple[str, str, str, bool]) -> int | None:
        """The first element of the kind wanted inside the block."""
        if wanted not in self.targets:
            tag, name, value, exact = wanted
            self.targets[wanted] = [
                k for k, t in enumerate(self.doc.tags) if t == tag and (v := self.doc.attributes(k).get(name)) is not None
                and (v == value if exact else v.startswith(value))]
        found = self.targets[wanted]
        k = bisect_right(found, n)
        return found[k] if k < len(found) and found[k] < self.doc.until[n] else None

    def field(self, block: tuple[list[str], str, bool], wanted) -> str | None:
        classes, text, every = block
        for n, attributes in self.divs:
            if _has_classes(attributes, classes) and (not text or self.holds(n, text)):
                at = n if wanted is None else self.target(n, wanted)
                if at is not None:
                    return self.doc.inner(at)
                if not every:
                    return None
        return None


def posting_texts(spec: list[tuple]):
    """A function of a page's HTML: the text of each field of ``spec``
    ``(name, variant, block, target)``, null where the page has no such element."""
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            blocks = _Blocks(page or "")
            out.append([blocks.field(block, wanted) for _, _, block, wanted in spec])
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))


# Shipped to the workers by value: executors need no copy of this package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
