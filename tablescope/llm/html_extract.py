"""HTML extraction (op 6): tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block elements.
For each path, over all blocks that have it, the length of their text outside links and their
punctuation are taken per block. Both ratios are smoothed along the paths in page order with a
Gaussian and fused (their product); paths above the threshold (the deviation of all, at most half
the largest) are content, and so are all their nodes. From the page's root the search goes down as
long as one child holds nearly all text of content nodes, weighed by the scores of their paths: that
node is the article, whatever it is called. All that is inside of it and not marked as something else is kept, so headings and lists
are not lost; blocks that are mostly links and not content are menus.

Nulls: a null html is empty; a page without text gives the empty string. Pages that repeat a
page_id are extracted each. Extra columns are ignored, whatever their names; an empty table gives
no rows. Paths that tie at the threshold are content. Parsing takes time and memory in proportion
to the page, however long, deep or broken it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
OUTSIDE = frozenset("nav footer aside form dialog menu search button fieldset".split())
ROOTS = frozenset(("article", "main"))
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer form header login masthead menu menus modal nav navbar navigation navbox newsletter notice notices pager pagination popup promo promoted promotion related responses share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
LEAST_LINKS = 0.5
#: The share of the content's weight that a child must hold for the search to go down to it.
NEARLY_ALL = 0.9

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
SPACE = re.compile(r"\s+")
#: What an opening tag closes, up to (not including) the elements of the second tuple.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}


class Node:
    """An open or closed element. ``path`` numbers its tag path; ``out``: marked as no part of an article; ``order``: its place in the page."""

    __slots__ = ("tag", "parent", "path", "out", "depth", "rooted", "order")

    def __init__(self, tag: str, parent: Node | None, out: bool, path: int, order: int):
        self.tag, self.parent, self.out, self.path, self.order = tag, parent, out, path, order
        self.depth = parent.depth + 1 if parent else 0
        self.rooted = tag in ROOTS or (parent is not None and parent.rooted)


def marked(tag: str, attributes: str, parent: Node) -> bool:
    """Is the element, by its name or its class, id or role, not part of an article?"""
    if tag in OUTSIDE or (tag == "header" and not parent.rooted):
        return True
    if tag in ROOTS or tag in ("body", "html") or not attributes:
        return False
    return any(p.lower() in MARKS for m in ATTRIBUTE.finditer(attributes) for p in PART.findall(m[2] or m[3] or m[4] or ""))


class Page:
    """Reads a page once from left to right: ``nodes`` in page order, ``blocks`` of (element, text, characters in links)."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, list[Node]] = {}  # by name, the innermost last
        self.buffer: list[str] = []
        self.links, self.in_link = 0, False
        self.here = self.add("", None, False)
        self.read(page)
        self.flush()

    def add(self, tag: str, parent: Node | None, out: bool) -> Node:
        path = self.paths.setdefault((parent.path if parent else -1, tag), len(self.paths))
        node = Node(tag, parent, out, path, len(self.nodes))
        self.nodes.append(node)
        if parent:
            self.open.setdefault(tag, []).append(node)
        return node

    def innermost(self, names: tuple[str, ...]) -> Node | None:
        return max((self.open[n][-1] for n in names if self.open.get(n)), key=lambda x: x.depth, default=None)

    def close(self, node: Node) -> None:
        """Leave an element and all inside of it."""
        while True:
            self.open[self.here.tag].pop()
            done, self.here = self.here is node, self.here.parent
            if done:
                return

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.blocks.append((self.here, text, self.links))
        self.buffer.clear()
        self.links = 0

    def say(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.buffer.append(text)
            self.links += len(text.strip()) * self.in_link

    def read(self, page: str) -> None:
        at, tag_at = 0, TAG
        while m := MARKUP.search(page, at):
            self.say(page[at : m.start()])
            at, kind = m.start(), m[0]
            if kind in ("<!--", "<![CDATA["):
                end = "-->" if kind == "<!--" else "]]>"
                found = page.find(end, m.end())
                at = found + len(end) if found >= 0 else len(page)
                continue
            if kind in ("<!", "<?"):
                found = page.find(">", at)
                if found < 0:  # no tag can end any more
                    break
                at = found + 1
                continue
            tag = tag_at.match(page, at)
            if not tag and tag_at is TAG:
                # A quote is never closed. From here on quotes don't count, so that no later tag is searched to the end again.
                tag_at = PLAIN_TAG
                tag = tag_at.match(page, at)
            if not tag:
                break
            at = self.element(page, tag)
        self.say(page[at:])

    def element(self, page: str, m: re.Match) -> int:
        """Takes a tag in; where to read on."""
        tag, at = m[2].lower(), m.end()
        if m[1]:
            if tag == "a":
                self.in_link = False
            elif tag in BLOCKS and self.open.get(tag):
                self.flush()
                self.close(self.open[tag][-1])
            elif tag == "p":
                self.flush()
        elif tag in RAW:
            if tag == "head" or (tag != "title" and m[3].rstrip().endswith("/")):
                return at
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            return end.end() if end else len(page)
        elif tag == "br":
            self.buffer.append(" ")
        elif tag == "a":
            self.in_link = True
        elif tag in BLOCKS:
            self.flush()
            names, stop = IMPLIED.get(tag, ((), ()))
            own, limit = self.innermost(names), self.innermost(stop)
            if own and (limit is None or own.depth > limit.depth):
                self.close(own)
            elif not names and self.here.tag == "p":  # a block ends an open paragraph
                self.close(self.here)
            if tag not in VOID:
                self.here = self.add(tag, self.here, self.here.out or marked(tag, m[3], self.here))
        return at


def smoothed(x: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    full = np.convolve(x, kernel)[radius : radius + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[radius : radius + len(x)]


def path_scores(blocks: list[tuple[Node, str, int]]) -> dict[int, float]:
    """The fused, smoothed ratios of each tag path, in page order."""
    paths: dict[int, list[float]] = {}
    for node, text, links in blocks:
        total = paths.setdefault(node.path, [0, 0, 0])
        total[0] += max(0, len(text) - links)
        total[1] += len(PUNCTUATION.findall(text))
        total[2] += 1
    ratios = np.array([[length / n, marks / n] for length, marks, n in paths.values()])
    fused = smoothed(ratios[:, 0]) * (1 + smoothed(ratios[:, 1]))
    return dict(zip(paths, fused.tolist(), strict=True))


def content_paths(scores: dict[int, float]) -> set[int]:
    """The paths at or above the threshold."""
    values = np.array(list(scores.values()))
    threshold = min(float(values.std()), 0.5 * float(values.max()))
    return {p for p, s in scores.items() if s >= threshold}


def article(page: str | None) -> str:
    """The main text of a page."""
    read = Page(page or "")
    usable = [b for b in read.blocks if not b[0].out]
    if not usable:
        return ""
    scores = path_scores(usable)
    chosen = content_paths(scores)
    content = [b for b in usable if b[0].path in chosen and b[2] <= LEAST_LINKS * len(b[1])] or usable
    mass = np.zeros(len(read.nodes))
    for node, text, _ in content:
        mass[node.order] += len(text) * scores[node.path]
    last = np.arange(len(read.nodes))  # the last node inside of each
    for node in reversed(read.nodes[1:]):
        mass[node.parent.order] += mass[node.order]
        last[node.parent.order] = max(last[node.parent.order], last[node.order])
    top = read.nodes[0]
    for node in read.nodes[1:]:  # children come after their parents
        if node.parent is top and node.tag not in LEAVES and mass[node.order] >= NEARLY_ALL * mass[0]:
            top = node
    kept = [text for node, text, links in usable if top.order <= node.order <= last[top.order] and (links <= LEAST_LINKS * len(text) or node.rooted or node.path in chosen)]
    return " ".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [article(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    d = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = StructType([*d.schema.fields[:2], StructField("text", StringType()), StructField("n_chars", LongType())])
    return d.mapInArrow(run, schema)
