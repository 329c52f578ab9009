"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Elements that never hold article text
(scripts, menus, page headers and footers, sidebars, forms, notices, adverts, reader comments)
leave no line; crossing the border of a container leaves an empty one, the ends of an article
element as many as a window is long. Over the lines slides a window of ``WINDOW`` lines; its
value is the text it holds. A stretch starts at a surge, where the value
leaves zero, and ends at the dive, where it is back at zero. Text between them is kept
whole if the stretch reaches the threshold: ``SURGE`` characters in one window, or half of the
page's best window where the page has less, and is no list of links. Where the page marks its
article, the stretches in it are kept, however short, and no others.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from fillsight.llm.common import map_texts

WINDOW = 3
SURGE = 86
# Share of link text above which a stretch is a list of links.
LINKS = 0.5

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
CONTAINER = {"article", "body", "div", "main", "section", "table", "td", "center", "fieldset", "details"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements without article text, and words of class, id and role that say the same of any element.
DROP = {
    "head", "script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "object", "svg",
    "canvas", "audio", "video", "nav", "menu", "header", "footer", "aside", "form", "dialog", "search", "button", "select", "input",
    "datalist",
}
DROP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "sidebar", "sidebars", "aside", "complementary", "widget", "widgets", "nav",
    "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "header", "masthead", "contentinfo",
    "footer", "copyright", "comment", "comments", "commentlist", "disqus", "discussion", "replies", "respond", "share", "sharing",
    "social", "related", "recommended", "recommendations", "pagination", "pager", "search", "searchbox", "form", "skip", "dialog",
}
# Words of these that an element may carry although it holds the page's article.
MAY_HOLD = {"form", "modal", "overlay", "popup", "widget", "widgets", "dialog", "banner", "header", "login", "search"}
# Words that deny what follows (has-sidebar, no-comments), that make a header the article's own
# (entry-header), and that make a name one of a page frame (content-sidebar-wrap).
DENY = {"has", "have", "with", "without", "no", "hide", "is"}
OWN = {"entry", "post", "article", "story"}
FRAME, FRAMED = {"wrap", "wrapper", "container", "layout"}, {"content", "main", "page", "site"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=[A-Za-z/])[^<]*$", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class _Element:
    """An element: its place among the tokens, its text, and what its attributes say."""

    name: str
    start: int
    parent: int
    end: int | None = None
    closed: bool = False
    named: set = field(default_factory=set)  # words of class, id and role that name it as boilerplate
    hidden: bool = False
    article: bool = False
    holds_article: bool = False
    size: int = 0


@dataclass
class _Line:
    text: str = ""
    size: int = 0
    linked: int = 0
    article: bool = False


@dataclass
class _Page:
    tokens: list = field(default_factory=list)  # (kind, value): text, open, close, void
    elements: list = field(default_factory=list)


def _boilerplate(value: str) -> set[str]:
    """The words of one class, id or role that name boilerplate."""
    words = [w.lower() for w in _WORD.findall(value)]
    if not words or words[-1] in FRAME and words[0] in FRAMED:
        return set()
    before = dict(zip(words[1:], words))
    return {w for w in words if w in DROP_WORDS and before.get(w) not in DENY and not (w == "header" and before.get(w) in OWN)}


def _element(name: str, rest: str, start: int, parent: int) -> _Element:
    out = _Element(name, start, parent)
    if rest.strip(" /\t\n\r"):
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
        values = " ".join(html.unescape(attributes.get(k, "")) for k in ("class", "id", "role")).split()
        out.named = set().union(*map(_boilerplate, values))
        out.hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
        marked = attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
    else:
        marked = False
    out.article = (marked or name in ("article", "main")) and not out.named and not out.hidden
    return out


def _parse(source: str) -> _Page:
    """Tokens of a page, and its elements with their ends; unclosed elements end with their parent."""
    page, stack, at, n = _Page(), [], 0, len(source)
    tokens, elements = page.tokens, page.elements

    def text(part: str) -> None:
        if part:
            part = html.unescape(part) if "&" in part else part
            tokens.append(("text", part))

    def leave(depth: int, closed: bool) -> None:
        while len(stack) > depth:
            e = elements[stack.pop()]
            e.end, e.closed = len(tokens), closed and len(stack) == depth

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if elements[stack[d]].name == name), None)
            if depth is not None:
                leave(depth, True)
                tokens.append(("close", name))
            elif name in ("p", "br"):
                tokens.append(("void", name))
            continue
        if name in VOID:
            tokens.append(("void", name))
            continue
        # a paragraph ends where a block starts; items, cells and rows end their like
        if name in BLOCK and stack and elements[stack[-1]].name == "p":
            leave(len(stack) - 1, True)
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and elements[stack[-1]].name == name:
            leave(len(stack) - 1, True)
        elements.append(_element(name, m[3], len(tokens), stack[-1] if stack else -1))
        stack.append(len(elements) - 1)
        tokens.append(("open", len(elements) - 1))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}>", re.I).search(source, at)
            at = end.end() if end else n
            leave(len(stack) - 1, True)
            tokens.append(("close", name))
    leave(0, False)
    return page


def _plain_drop(e: _Element) -> bool:
    """Dropped whatever it holds."""
    return e.hidden or e.name in DROP and e.name != "form" or bool(e.named - MAY_HOLD)


def _dropped(page: _Page) -> set[int]:
    """Indexes of the elements whose text goes. A form or a frame named so may hold the article."""
    elements, out = page.elements, set()
    for e in reversed(elements):  # children follow their parents
        if (e.article or e.holds_article) and e.parent >= 0 and not _plain_drop(e):
            elements[e.parent].holds_article = True
    for i, e in enumerate(elements):
        if e.name not in ("html", "body") and not e.article and (_plain_drop(e) or (e.named or e.name == "form" and e.closed) and not e.holds_article):
            out.add(i)
    return out


def _lines(page: _Page) -> list[_Line]:
    """Lines of the kept text, with empty ones at container borders."""
    drop, lines, current = _dropped(page), [], _Line()
    elements, open_, links, articles = page.elements, [], 0, 0
    skip_until, inner_header, in_heading = -1, [], 0
    ends: dict[int, list[int]] = {}

    def flush():
        nonlocal current
        words = current.text.split()
        if words:
            joined = " ".join(words)
            lines.append(_Line(joined, sum(map(len, words)), current.linked, articles > 0))
        current = _Line()

    def gap(count):
        lines.extend(_Line(article=articles > 0) for _ in range(count))

    for k, (kind, value) in enumerate(page.tokens):
        for i in ends.pop(k, ()):  # elements that end before this token
            e = elements[i]
            if e.name in BLOCK:
                flush()
            if e.name == "a":
                links -= 1
            if e.name in HEADINGS:
                in_heading -= 1
            if inner_header and inner_header[-1] == i:
                inner_header.pop()
            if e.article:
                articles -= 1
                gap(WINDOW if not articles else 1)
            elif e.name in CONTAINER:
                gap(1)
        if k < skip_until:
            continue
        if kind == "open":
            e = elements[value]
            title = e.name == "header" and articles > 0 and not e.hidden
            if value in drop and not title:
                flush()
                skip_until = e.end if e.closed or e.name in RAW else _until_next_block(page, e)
                if e.name in CONTAINER or e.name in ("nav", "header", "footer", "aside"):
                    gap(0 if articles else 1)
                continue
            ends.setdefault(e.end, []).insert(0, value)
            if e.name in BLOCK:
                flush()
            if e.article:
                gap(WINDOW if not articles else 1)
                articles += 1
            elif e.name in CONTAINER:
                gap(1)
            links += e.name == "a"
            in_heading += e.name in HEADINGS
            if title:
                inner_header.append(value)
        elif kind == "void":
            if value in BLOCK:
                flush()
        elif kind == "text" and (not inner_header or in_heading):
            current.text += value
            if links:
                current.linked += len("".join(value.split()))
    flush()
    return lines


def _until_next_block(page: _Page, e: _Element) -> int:
    """An element to drop that was never closed ends where the next content element starts."""
    for k in range(e.start + 1, e.end):
        kind, value = page.tokens[k]
        if kind == "open" and page.elements[value].name in ("article", "main", "section", "div", "h1", "p", "footer"):
            return k
    return e.end


def stretches(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, best window) of each run of lines between windows of zero length."""
    out, start, i, n = [], None, 0, len(sizes)
    while i < n:
        if sizes[i]:
            start, best, last = i, 0, i
            while i < n and i - last <= WINDOW:
                if sizes[i]:
                    last = i
                best = max(best, sum(sizes[max(start, i - WINDOW + 1) : i + 1]))
                i += 1
            out.append((start, last + 1, best))
        else:
            i += 1
    return out


def main_text(source: str | None) -> str:
    """The article of one page as one line; empty where there is none."""
    lines, found = _lines(_parse(source or "")), []
    for a, b, best in stretches([x.size for x in lines]):
        size, linked = sum(x.size for x in lines[a:b]), sum(x.linked for x in lines[a:b])
        found.append((a, b, best, lines[a].article, linked <= LINKS * size))
    if any(marked for *_, marked, _ in found):
        kept = [x for x in found if x[3]]
    else:
        threshold = min(SURGE, max((x[2] for x in found if x[4]), default=0) / 2)
        kept = [x for x in found if x[4] and x[2] >= threshold]
    return " ".join(x.text for a, b, *_ in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page and its code points.

    NULL and empty pages, and pages without text, give an empty text; repeated rows and ids give
    a row each; other columns are not looked at.
    """

    def run(batch):
        texts = [main_text(s) for s in batch.column("html").to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_texts(pages, run, "text string, n_chars bigint", ["page_id", "url"], "html")
