"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters per tag, raised where few of them
are link text. A node's density sum adds the densities of its children. The subtree with the
largest sum holds the article; the least density on the way from it up to the body is the
threshold that other subtrees have to reach to be content too.

A page is one row, so pages are worked on where they are read, without a shuffle. The tree is
a few flat lists and is never walked recursively, so depth and length are bounded by memory
only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from roundsman.llm.common import session_ready

# Fixed values of HTML: elements without content, those that start a block, and what a start
# tag closes when its end tag was left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"},
}
# Where a search for an open element ends.
SCOPES = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
    "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"},
    "p": {"table", "td", "th", "caption", "button", "object", "html", "body"},
}
# Elements that are never article text, by name, by role and by words of class and id.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend map menu nav noscript"
    " object option script search select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar footer masthead cookie cookies consent gdpr notice notices banner popup modal newsletter subscribe comment comments"
    " disqus respond reply replies share sharing social related pagination pager".split()
)
#: Whole names of page headers; "article-header" and the like stay.
HEADER_NAMES = frozenset("header site-header page-header top-header topbar top-bar".split())
#: Elements that can hold an article as a whole.
CONTAINERS = frozenset("article body center details div html main section td".split())
_WORD = re.compile(r"[a-z0-9]+")
_UNFINISHED = re.compile(r"</?[A-Za-z]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _named_away(tag: str, attrs: dict[str, str | None]) -> bool:
    if (attrs.get("role") or "").strip().lower() in DROPPED_ROLES:
        return True
    classes = {tag, *(attrs.get("class") or "").lower().split(), (attrs.get("id") or "").lower()}
    if not classes.isdisjoint(HEADER_NAMES):
        return True
    names = set(_WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
    return tag not in ("html", "body", "main") and not names.isdisjoint(DROPPED_NAMES)


class Tree(HTMLParser):
    """A page as flat lists: per node its parent, tag and marks, and the text runs in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.dropped, self.named = [-1], ["html"], [False], [False]
        #: (node, text); a node without text marks the place of a line break
        self.runs: list[tuple[int, str]] = []
        self.open = [0]
        #: open elements by tag, so that a search for one that is not open never starts
        self.n_open = Counter(["html"])
        self.feed(html)
        if _UNFINISHED.match(self.rawdata):  # the page ends inside a tag, which is no text
            self.rawdata = ""
        self.close()

    def _cut(self, at: int) -> None:
        self.n_open.subtract(self.tag[n] for n in self.open[at:])
        del self.open[at:]

    def _close_open(self, tags: set[str], scope: set[str]) -> None:
        """Close back to the outermost open element of ``tags`` before one of ``scope``."""
        if not any(self.n_open[t] for t in tags):
            return
        found = 0
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in scope:
                break
            if tag in tags:
                found = at
        if found:
            self._cut(found)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("html", "body") and self.n_open[tag]:
            return
        if tag in BLOCKS:
            self._close_open({"p"}, SCOPES["p"])
        if tag in CLOSES:
            self._close_open(CLOSES[tag], SCOPES[tag])
        if tag == "body":
            self._close_open({"head"}, set())
        node = len(self.tag)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.dropped.append(tag in DROPPED)
        self.named.append(_named_away(tag, attrs))
        if tag in VOID:
            self.runs.append((node, " " if tag == "br" else ""))
        else:
            self.open.append(node)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # on other elements the slash means nothing

    def handle_endtag(self, tag):
        if not self.n_open[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            here = self.tag[self.open[at]]
            if here == tag:
                self._cut(at)
                return
            # the end of an inline element does not close blocks around its place
            if tag not in BLOCKS and here in BLOCKS:
                return

    def handle_data(self, data):
        if data:
            self.runs.append((self.open[-1], data))

    def unknown_decl(self, data):
        pass


def _left_out(tree: Tree) -> list[bool]:
    """Nodes inside something that is no article text.

    A header, class or id alone does not take away what holds a first-level heading or main
    element; a header that is a child of the body goes in any case.
    """
    size = len(tree.tag)
    holds = [t in ("h1", "main") for t in tree.tag]
    for node in range(size - 1, 0, -1):
        if holds[node]:
            holds[tree.parent[node]] = True
    out = [False] * size
    for node in range(1, size):
        up = tree.parent[node]
        at_top = tree.tag[node] == "header" and tree.tag[up] in ("body", "html")
        out[node] = out[up] or tree.dropped[node] or (tree.named[node] and (at_top or not holds[node]))
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """(composite density, density sum) of every node; links of the whole page set the scale.

    With C characters, T tags, L link characters and A link tags below a node, the density is
    C/T times the logarithm of C/L * T/A. The logarithm's base grows with the node's share of
    link text; it starts at e, not at 1 as published, so that pages without links have one too.
    """
    size = len(tree.tag)
    chars, links, tags, anchors = [0] * size, [0] * size, [0] * size, [0] * size
    whole = whole_links = 0
    in_link = [False] * size
    for node in range(1, size):
        in_link[node] = tree.tag[node] == "a" or in_link[tree.parent[node]]
        if not out[node]:
            tags[tree.parent[node]] += 1
            anchors[node] += tree.tag[node] == "a"
    for node, text in tree.runs:
        n = len("".join(text.split()))
        if tree.dropped[node] and tree.tag[node] in ("script", "style", "title", "noscript", "template"):
            continue
        whole += n
        whole_links += n * in_link[node]
        if not out[node]:
            chars[node] += n
            links[node] += n * in_link[node]
    for node in range(size - 1, 0, -1):
        up = tree.parent[node]
        chars[up] += chars[node]
        links[up] += links[node]
        tags[up] += tags[node]
        anchors[up] += anchors[node]
    ratio = whole_links / max(whole, 1)
    density, sums = [0.0] * size, [0.0] * size
    for node in range(size - 1, -1, -1):
        c, t = chars[node], max(tags[node], 1)
        if c:
            rest = max(c - links[node], 1)
            base = math.e - 1 + math.log(c / rest * links[node] + ratio * c + math.e)
            density[node] = c / t * math.log(1 + c / max(links[node], 1) * t / max(anchors[node], 1), base)
        if node:
            sums[tree.parent[node]] += density[node]
    return density, sums


def _content(tree: Tree, out: list[bool]) -> list[int]:
    """Top nodes of the main text, in page order."""
    density, sums = densities(tree, out)
    size = len(tree.tag)
    body = next((n for n in range(size) if tree.tag[n] == "body"), 0)
    inside = [False] * size
    for node in range(size):
        inside[node] = not out[node] and (node == body or node > 0 and inside[tree.parent[node]])
    whole = [inside[n] and tree.tag[n] in CONTAINERS for n in range(size)]
    best = max((n for n in range(size) if whole[n]), key=lambda n: (sums[n], -n), default=body)
    threshold, at = density[best], best
    while at != body:
        at = tree.parent[at]
        threshold = min(threshold, density[at])
    # the container with the largest sum below each node, itself included
    top = [n if whole[n] else -1 for n in range(size)]
    for node in range(size - 1, body, -1):
        up, here = tree.parent[node], top[node]
        if inside[node] and here >= 0 and (top[up] < 0 or (sums[here], -here) > (sums[top[up]], -top[up])):
            top[up] = here
    chosen: list[int] = []
    children: dict[int, list[int]] = {}
    for node in range(body + 1, size):
        if inside[node]:
            children.setdefault(tree.parent[node], []).append(node)
    look = [body]
    while look:
        node = look.pop()
        if top[node] == node:
            chosen.append(node)
        elif top[node] >= 0 and density[node] >= threshold:
            look += children.get(node, [])
        # what is less dense than the way to the article is no content
    # chosen lie in different branches or a sum of zero; the article is what they have in common
    chosen = [n for n in chosen if sums[n] > 0 or n == best]
    common = best
    for node in chosen:
        ways = set()
        at = node
        while at >= 0:
            ways.add(at)
            at = tree.parent[at]
        while common not in ways:
            common = tree.parent[common]
    if common != body or not children.get(body):
        # all of the element that says it is the article, and the first-level headings ahead
        at = common
        while at != body:
            if tree.tag[at] in ("article", "main"):
                common = at
                break
            at = tree.parent[at]
        return [n for n in range(body, common) if inside[n] and tree.tag[n] == "h1"] + [common]
    # side by side in the body: the branches with content, and headings between them
    keep = set()
    for node in chosen:
        while node != body and tree.parent[node] != body:
            node = tree.parent[node]
        keep.add(node)
    if body in keep:
        return [body]
    return [n for n in children[body] if n in keep or tree.tag[n] in _HEADINGS]


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty without any.

    White space as Unicode has it, the space of ``<br>`` included, becomes one space inside a
    block. Page headers go, the header of an article stays.
    """
    if not html:
        return ""
    tree = Tree(html)
    out = _left_out(tree)
    size = len(tree.tag)
    chosen = set(_content(tree, out))
    kept, block = [False] * size, [0] * size
    for node in range(size):
        up = tree.parent[node]
        kept[node] = not out[node] and (node in chosen or node > 0 and kept[up])
        block[node] = node if node == 0 or tree.tag[node] in BLOCKS else block[up]
    lines: list[list[str]] = []
    last = None
    breaks = _block_breaks(tree, block)
    for at, (node, text) in enumerate(tree.runs):
        if not kept[node] or out[node]:
            continue
        if last is None or block[node] != block[tree.runs[last][0]] or breaks[at] != breaks[last]:
            lines.append([])
        lines[-1].append(text)
        last = at
    joined = (" ".join("".join(parts).split()) for parts in lines)
    return "\n".join(line for line in joined if line)


def _block_breaks(tree: Tree, block: list[int]) -> list[int]:
    """How many block elements have started before each text run: text on both sides of one is two blocks."""
    starts = [0] * (len(tree.tag) + 1)
    for node, tag in enumerate(tree.tag):
        starts[node + 1] = starts[node] + (tag in BLOCKS)
    seen, out = 0, []
    for node, _ in tree.runs:
        seen = max(seen, node)
        out.append(starts[seen + 1])
    return out


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` (code points) of every page's main text.

    Other columns are left out, so they cannot clash; ``keep`` may not name the two new ones.
    A null or empty page gives an empty text; repeated rows each give theirs.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are new columns; rename the page's own")
    session_ready(pages.sparkSession)
    rows = pages.select(*keep, pages[html].alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def work(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    return rows.mapInArrow(work, schema)
