"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. Each line weighs its text length without that of links;
headings weigh all of theirs. Weights are summed over sliding windows of lines: a passage goes on up to the dive where
the windows hold nothing, and is kept if its windows surge somewhere; its short lines stay with it.

Elements decide two things. What menus, headers, footers, sidebars, forms, notices and the like hold, told by their
element, role or class, is no line at all; such an element that holds an article, or all text of the page, is taken for
a wrapper. And where an article or main element has most of the page's text, lines outside it weigh nothing and don't
stand in a passage, and lines inside it weigh all their text, links too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, utf8

#: Lines of a window.
WINDOW = 3
#: Characters that a window must have for a surge; on pages of less text, over half of the best window's.
SURGE = 80

_RAW = re.compile(r"<(script|style|noscript|template|iframe|svg|math|textarea|title|object|canvas)\b", re.I)
_START = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_BOUND = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr"}
SPACED = {"br", "td", "th", "img"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no part of the article; a header inside an article has its headings.
DROPPED = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "select"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Elements that a class or id name can mark; a paragraph or heading is never dropped for its class.
MARKABLE = {"article", "center", "details", "div", "dl", "fieldset", "figure", "ol", "section", "table", "ul"}
#: Words of class and id names of parts that aren't the article.
MARKED = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "notifications", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "teaser", "teasers", "toolbar", "widget", "widgets"}
#: Words that may stand beside those in a name; a name with any other word, as in share-price, marks nothing.
BESIDE = {"area", "articles", "bar", "block", "blocks", "body", "bottom", "box", "btn", "buttons", "col", "column", "container", "content", "fb", "global", "inline", "inner", "item", "items", "js", "left", "links", "list", "main", "media", "mobile", "news", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section", "side", "site", "slot", "sticky", "stories", "the", "thread", "top", "unit", "user", "view", "wrap", "wrapper"}
#: Of the marking words those that mark an article element too: readers' comments and teasers are articles in some pages.
MARKED_ARTICLES = {"ad", "comment", "comments", "promo", "related", "replies", "reply", "sponsored", "teaser"}


def _marks(value: str, words: set[str]) -> bool:
    """Whether one of the names in a class or id has a word of ``words``, and no words but those and the like."""
    for name in value.split():
        own = {w.lower() for w in _NAME.findall(name) if not w.isdigit()}
        if own & words and own <= MARKED | BESIDE:
            return True
    return False


def _is_dropped(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if "=" not in attributes:
        return "hidden" in attributes.lower().split()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            if name in MARKABLE and _marks(value, MARKED_ARTICLES if name == "article" else MARKED):
                return True
        elif key == "role" and value.strip().lower() in ROLES or key == "aria-hidden" and value.strip().lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return "hidden" in re.sub(r"""=\s*("[^"]*"|'[^']*'|\S+)""", " ", attributes).lower().split()


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup of a page: where it begins and ends, the element's name in lower case, whether it closes, and its attributes.

    Comments, declarations and elements whose content is no text have no name and are one piece each. A tag ends at
    the first > outside quotes; what never ends is text. One pass: quotes are paired once, and where a search for an
    end has failed, none is tried again.
    """
    bounds = [m.start() for m in _BOUND.finditer(html)]
    paired, last = [len(bounds)] * len(bounds), {}
    for i in range(len(bounds) - 1, -1, -1):
        c = html[bounds[i]]
        paired[i] = last.get(c, len(bounds))  # the next bound of the same kind
        last[c] = i
    closing = [i for i, at in enumerate(bounds) if html[at] == ">"]
    ends = [bounds[i] for i in closing]
    dead = bytearray(len(bounds) + 1)
    dead[len(bounds)] = 1
    at = html.find("<")
    while at >= 0:
        end, name, closes, attributes = -1, "", False, ""
        if html.startswith("<!--", at):
            end = html.find("-->", at)
            end = len(html) if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at):
            end = at + 9
        elif raw := _RAW.match(html, at):
            if (i := bisect_left(ends, raw.end())) < len(ends):
                close = re.compile(f"</{raw[1]}\\s*>", re.I).search(html, ends[i] + 1)
                end = close.end() if close else len(html)
        elif html.startswith(("<!", "<?"), at):
            end = ends[i] + 1 if (i := bisect_left(ends, at)) < len(ends) else -1
        elif found := _START.match(html, at):
            i, seen = bisect_left(bounds, found.end()), []
            while not dead[i] and html[bounds[i]] != ">":
                seen.append(i)
                i = paired[i] + 1 if paired[i] < len(bounds) else paired[i]
            if dead[i]:
                for j in seen:
                    dead[j] = 1
            else:
                end, name, closes, attributes = bounds[i] + 1, found[2].lower(), bool(found[1]), html[found.end() : bounds[i]]
        if end >= 0:
            yield at, end, name, closes, attributes
        at = html.find("<", max(end, at + 1))


class _Lines:
    """The lines of a page: texts, how much of each is link text, whether it's a heading and stands in an article, and the droppable elements around it."""

    def __init__(self, html: str) -> None:
        self.lines: list[tuple[str, int, bool, bool, int]] = []
        # droppable elements by number, 0 for none: their name, the one around it, whether it's the header of an article
        self.droppable: list[tuple[str, int, bool]] = [("", 0, False)]
        self.holds_article: set[int] = {0}
        self._buffer: list[str] = []
        self._linked, self._link, self._heading = 0, False, False
        # open elements: name, and what holds inside them: droppable elements around, whether in an article
        self._stack: list[tuple[str, int, bool]] = []
        self._open: Counter = Counter()
        self._around, self._article = 0, False
        at = 0
        for start, end, name, closes, attributes in _tags(html):
            if start > at:
                self._text(html[at:start])
            at = end
            if name and closes:
                self._end(name)
            elif name:
                self._begin(name, attributes)
        self._text(html[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        self._buffer.append(piece)
        if self._link:
            self._linked += len(piece.strip())

    def _flush(self) -> None:
        if self._buffer:
            text = _SPACE.sub(" ", unescape("".join(self._buffer))).strip()
            self._buffer.clear()
            if text:
                self.lines.append((text, self._linked, self._heading, self._article, self._around))
            self._linked = 0

    def _pop(self, depth: int) -> None:
        if any(name not in INLINE for name, *_ in self._stack[depth:]) or self._stack[depth][1] != self._around:
            self._flush()
        for name, *_ in self._stack[depth:]:
            self._open[name] -= 1
        _, self._around, self._article = self._stack[depth]
        del self._stack[depth:]

    def _end(self, name: str) -> None:
        if name == "a":
            self._link = False
        elif self._open[name]:
            depth = next(i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] == name)
            if name not in INLINE or all(x in INLINE for x, *_ in self._stack[depth:]):
                self._pop(depth)
        elif name not in INLINE:
            self._flush()
        if name in HEADINGS:
            self._heading = False

    def _begin(self, name: str, attributes: str) -> None:
        if name == "a":
            self._link = "href" in attributes.lower()
            return
        if name not in INLINE:
            for i in range(len(self._stack) - 1, -1, -1):  # an open paragraph ends where a block begins, an item where the next does
                if self._stack[i][0] == "p" or self._stack[i][0] == name in ("li", "dd", "dt", "option"):
                    self._pop(i)
                    break
                if self._stack[i][0] not in INLINE:
                    break
            self._flush()
            self._heading = name in HEADINGS
        if name in SPACED:
            self._buffer.append(" ")
        if name in VOID or attributes.endswith("/"):
            return
        drop = _is_dropped(name, attributes)
        if name in INLINE and not drop and not self._open[name]:
            return  # inline elements count only where they are dropped
        around, article = self._around, self._article
        if drop:
            self._flush()
            self._around = len(self.droppable)
            self.droppable.append((name, around, name == "header" and article))
        elif name in ("article", "main") or "main" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes) or "articleBody" in attributes:
            self._flush()
            self._article = True
            while around not in self.holds_article:
                self.holds_article.add(around)
                around = self.droppable[around][1]
            around = self._around
        self._stack.append((name, around, article))
        self._open[name] += 1


def weighed(html: str) -> tuple[list[str], list[int]]:
    """The lines of a page that may be article text, and their weights."""
    page = _Lines(html)

    def left(wrappers: set[int]) -> list[tuple[str, int, bool, bool, int]]:
        whole, headings = [True], [True]  # whether all lines, or headings, in each droppable element stay
        for i, (_, around, header) in enumerate(page.droppable[1:], 1):
            whole.append(whole[around] and i in wrappers)
            headings.append(headings[around] and (header or i in wrappers))
        return [x for x in page.lines if whole[x[4]] or x[2] and headings[x[4]]]

    found = left(page.holds_article)
    if not found and page.lines:  # everything stands in droppable elements: one around most of the text is a wrapper
        outer, size = [0], Counter()
        for i, (_, around, _) in enumerate(page.droppable[1:], 1):
            outer.append(outer[around] or i)
        for text, linked, _, _, around in page.lines:
            size[outer[around]] += max(len(text) - linked, 0)
        most, n = size.most_common(1)[0]
        if n and 2 * n > size.total() and page.droppable[most][0] in ("div", "form", "section"):
            found = left(page.holds_article | {most})
    inside = sum(len(text) for text, *_, article, _ in found if article)
    if 2 * inside >= sum(len(text) for text, *_ in found) > 0:
        found = [x for x in found if x[3]]
        return [x[0] for x in found], [len(x[0]) for x in found]
    return [x[0] for x in found], [len(text) if heading else max(len(text) - linked, 0) for text, linked, heading, *_ in found]


def passages(weights: list[int]) -> list[tuple[int, int]]:
    """The surging passages (first, end) of lines with these weights."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    least = min(SURGE, max(sums, default=0) // 2 + 1)
    out, i, n = [], 0, len(weights)
    while i < n:
        if not weights[i]:
            i += 1
            continue
        j, last, top = i, i, 0
        while j < n and sums[j]:  # up to the dive
            top = max(top, sums[j])
            last = j if weights[j] else last
            j += 1
        if top >= least:
            out.append((i, last + 1))
        i = j
    return out


def main_text(html: str) -> str:
    lines, weights = weighed(html)
    return "\n".join("\n".join(lines[a:b]) for a, b in passages(weights))


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, text and n_chars (code points) of each page.

    Character references are decoded, white space inside a block is one space, blocks are joined by line feeds. A null
    or empty page, or one without main text, has an empty text. Repeated rows each have a row; other columns are left
    out; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "html", 4 << 20):
            off, body = utf8(b.column(b.num_columns - 1))
            raw = body.tobytes()
            texts = [main_text(raw[s:e].decode()) if e > s else "" for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    one = pages.select(*keep, F.col(html_col).alias("html"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in one.dtypes[:-1])
    return one.mapInArrow(work, f"{schema}, text string, n_chars long")
