"""HTML extraction by line-block distribution.

A page's markup is stripped to lines, one for each block: block-level tags end a line, inline tags and <br> are a space.
With the markup go elements that never hold an article (scripts, styles, forms, menus, headers outside an article,
footers, asides, and containers whose class, id or role names an advert, a menu, a notice, comments and the like), so an
advert leaves no gap in the text around it.

The distribution: a line weighs its characters outside links, and the weights are summed over WINDOW lines from each line
on and over WINDOW lines up to it.  Text surges where both sums reach the threshold and dives where one of them falls
below it; between a surge and the dive every line is kept, short ones too.  The threshold is SURGE characters, or SHARE of
the page's largest window where that is less, so short pages have text as well.

Tags only add to or take from the weights:
* lines inside <article> or <main> weigh the threshold more, so they reach it alone; on a page that has such text, lines
  outside of it weigh OUTER of their characters, so that only long text joins in;
* on other pages the main container is found by going down from the page into the container (HOLDERS) that has at least
  MOST of the characters, as long as there is one; lines of its textual blocks (paragraphs, headings, items, cells) that
  are not mostly links weigh the threshold more.

Defined results: null and empty pages, and pages without text in their blocks, give an empty text.  Character
references are decoded once; white space in a block becomes one space; blocks are joined by a line feed.  Unclosed tags,
comments and truncated pages are read as far as they go.  Extra columns are ignored, repeated rows judged alike.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import session

WINDOW = 3
#: Characters in a window that make a surge, and the share of the largest window that is enough.
SURGE, SHARE = 120, 0.2
#: Weight of characters outside of a marked article, and the share of a page's characters that a main container has.
OUTER, MOST = 0.125, 0.7
#: Share of characters in links from which on a line is mostly links.
LINKED = 0.6

#: Elements whose content is not text of the page.
SILENT = frozenset("script style noscript template svg math iframe object video audio canvas map head title".split())
#: Of these, those whose content is not markup: they end at their own end tag only.
RAW = frozenset("script style noscript template iframe title".split())
#: Elements that hold no article text.
OUTSIDE = frozenset("nav footer aside form button select textarea dialog menu fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
#: Blocks that hold text, where other blocks hold blocks.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th caption figcaption summary".split())
#: Containers that may hold a whole article.
HOLDERS = frozenset("div section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that mark a container as no part of the article (own choice).
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr"
    " notice notification alert nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail widget"
    " widgets footer header masthead topbar toolbar comment comments disqus respond reply replies share sharing social related"
    " recommended newsletter subscribe subscription signup login search complementary contentinfo skip".split()
)
#: Marks that say nothing where the same attribute also names the article, as in `post-header`.
WEAK = frozenset("header footer widget widgets banner toolbar overlay search skip".split())
NAMES_ARTICLE = frozenset("article post entry content story body text".split())
#: Marks of an <article> that is a reader's comment.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Containers that may be marked; paragraphs and headings are never judged by their class.
MARKED = frozenset("div section ul ol dl table td tr span p aside header footer figure li details".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>?")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I | re.A) for name in RAW}
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def marked_outside(name: str, attributes: str) -> bool:
    """Whether a container's attributes name it as no part of an article."""
    if not attributes or name not in MARKED and name != "article":
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "style" and _HIDDEN.search(value)):
            return True
        words = {w.lower() for w in _WORD.findall(value)}
        if key in ("class", "id", "role") and words & (COMMENTS if name == "article" else MARKS - WEAK if words & NAMES_ARTICLE else MARKS):
            return True
    return False


class Lines:
    """Lines of a page outside of what holds no article: text, characters inside links, whether inside an article, whether
    in a textual block, and the number of the innermost of HOLDERS (0 for the page); above[h] is the holder around holder h."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.inside: list[bool] = []
        self.textual: list[bool] = []
        self.holder: list[int] = []
        self.above = [0]
        self._parts: list[str] = []
        self._links = 0
        self._stack: list[tuple[str, bool, bool, int]] = []  # (name, outside, article, holder)
        self._open_at: dict[str, list[int]] = {}  # places of each name in the stack
        self._blocks: list[int] = []  # places of block elements in the stack
        self._walk(page)
        self._end_line()

    def _end_line(self) -> None:
        if self._parts:
            _, out, inside, holder = self._stack[-1] if self._stack else ("", False, False, 0)
            text = "" if out else " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.text.append(text)
                self.linked.append(min(self._links, len(text)))
                self.inside.append(inside)
                self.textual.append(bool(self._blocks) and self._stack[self._blocks[-1]][0] in TEXTUAL)
                self.holder.append(holder)
        self._parts, self._links = [], 0

    def _walk(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            tag = page.find("<", at)
            if tag < 0:
                self._add(page[at:])
                break
            if tag > at:
                self._add(page[at:tag])
            if page.startswith("<!--", tag):
                stop = page.find("-->", tag + 4)
                at = n if stop < 0 else stop + 3
                continue
            if page[tag + 1 : tag + 2] in ("!", "?"):
                stop = page.find(">", tag)
                at = n if stop < 0 else stop + 1
                continue
            m = _TAG.match(page, tag)
            if not m:
                self._add("<")
                at = tag + 1
                continue
            at, name = m.end(), m[2].lower()
            if not page.startswith(">", at - 1):  # cut off inside a tag, or a stray quote
                stop = page.find(">", at)
                at = n if stop < 0 else stop + 1
            if m[1]:
                self._close(name)
            elif name in SILENT:
                if name in RAW:
                    end = _ENDS[name].search(page, at)
                    after = page.find(">", end.end()) if end else -1
                    at = n if after < 0 else after + 1
                elif not m[3].rstrip().endswith("/"):
                    self._open(name, m[3])
            else:
                self._open(name, m[3])

    def _add(self, text: str) -> None:
        self._parts.append(text)
        if self._open_at.get("a"):
            self._links += len(text)

    #: An opening tag ends an element of these names that is still open (unclosed markup).
    ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
    #: An <a> ends an open one, and without an address it is no link.
    _ADDRESS = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)

    def _open(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._end_line()
            elif name in ("br", "wbr"):
                self._parts.append(" " if name == "br" else "")
            return
        if name == "a":
            if self._open_at.get("a"):
                self._close("a")
            if not self._ADDRESS.search(attributes):
                return
        if name == "body":  # whatever the head left open is over
            self._end_line()
            self._cut(0)
        if name in BLOCKS:
            self._end_line()
            # A block ends an open paragraph and what its markup lets it end; unclosed inline elements end with it.
            while self._stack and (self._stack[-1][0] == "p" or self._stack[-1][0] not in BLOCKS | SILENT | {"a"} or self._stack[-1][0] in self.ENDS.get(name, ())):
                self._cut(len(self._stack) - 1)
        _, out, inside, holder = self._stack[-1] if self._stack else ("", False, False, 0)
        if name in HOLDERS:
            self.above.append(holder)
            holder = len(self.above) - 1
        inside = inside or name in ("article", "main")
        out = out or name in OUTSIDE or name in SILENT or (name == "header" and not inside) or marked_outside(name, attributes)
        self._open_at.setdefault(name, []).append(len(self._stack))
        if name in BLOCKS:
            self._blocks.append(len(self._stack))
        self._stack.append((name, out, inside, holder))

    def _cut(self, size: int) -> None:
        """Close the innermost elements until size are open."""
        while len(self._stack) > size:
            name = self._stack.pop()[0]
            self._open_at[name].pop()
            if name in BLOCKS:
                self._blocks.pop()

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
        places = self._open_at.get(name)
        if name == "br" or name == "p" and not places:
            self._parts.append(" ")
            return
        # An inline end does not close the blocks opened since.
        if places and (name in BLOCKS or not self._blocks or self._blocks[-1] < places[-1]):
            self._cut(places[-1])


def main_container(weight: np.ndarray, holder: np.ndarray, above: list[int]) -> np.ndarray:
    """Whether each line is in the container reached by going down from the page to what holds MOST of the weight."""
    total = np.bincount(holder, weight, len(above))
    for h in range(len(above) - 1, 0, -1):  # a container is numbered after the one around it
        total[above[h]] += total[h]
    main = 0
    for h in range(1, len(above)):
        if above[h] == main and total[h] >= MOST * total[0]:
            main = h
    within = np.zeros(len(above), bool)
    within[main] = True
    for h in range(main + 1, len(above)):
        within[h] = within[above[h]]
    return within[holder]


def weights(lines: Lines) -> tuple[np.ndarray, float]:
    """(weight of each line, threshold) of the distribution."""
    size = np.array([len(t) for t in lines.text], float)
    linked, inside = np.array(lines.linked, float), np.array(lines.inside)
    own = size - linked
    if not own.any():
        own = size  # a page of links only
    if inside.any():
        own = np.where(inside, size, own * OUTER)
        more = inside
    else:
        more = main_container(own, np.array(lines.holder), lines.above) & np.array(lines.textual) & (linked < LINKED * size)
    threshold = min(SURGE, SHARE * np.convolve(own, np.ones(WINDOW)).max())
    return own + more * threshold, threshold


def between_surges(weight: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each line lies between a surge of the window sums and the dive after it."""
    spread = np.convolve(weight, np.ones(WINDOW))
    return np.minimum(spread[WINDOW - 1 :], spread[: len(weight)]) >= threshold * (1 - 1e-9)


def article(page: str) -> str:
    """The main text of one page."""
    lines = Lines(page)
    if not lines.text:
        return ""
    kept = between_surges(*weights(lines))
    return "\n".join(t for t, k in zip(lines.text, kept.tolist()) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of every whole page."""
    session.arrow(pages.sparkSession)
    source = pages.select(F.col(html_col).cast("string").alias(session.free("html", *keep)), *keep)

    def run(batches):
        for batch in batches:
            texts = [article(x.as_py() or "") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    return source.mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
