"""Pages to Markdown, by the standard HTML parser in a pandas UDF."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DROP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "template", "head"}
_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "br", "hr", "figure"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr"}


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []
        self.links: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in _DROP:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden and self.hidden.pop() != tag:
                    pass
            return
        if re.fullmatch(r"h[1-6]", tag) or tag in _BLOCK:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


# Parts of class names and ids that speak for main content, and against it.
CONTENT_NAMES = ("article", "body", "content", "entry", "main", "page", "post", "text", "blog", "story")
OTHER_NAMES = ("comment", "foot", "footer", "header", "menu", "meta", "nav", "promo", "related", "share", "sidebar", "sponsor", "banner", "breadcrumb", "pagination", "advert", "cookie")

_PARAGRAPHS = {"p", "td", "pre", "blockquote"}
_CLOSES_ITSELF = {"p": _BLOCK | {"p", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}, "li": {"li"}, "td": {"td", "th", "tr"}, "tr": {"tr"}}


@dataclass(eq=False)
class _Element:
    """An element with its place in the page; sums are over all that it holds."""

    tag: str
    name: str
    parent: _Element | None
    start: int
    end: int = -1
    chars: int = 0
    links: int = 0
    commas: int = 0
    score: float = 0.0
    children: list[_Element] = field(default_factory=list)

    def link_share(self) -> float:
        return self.links / self.chars if self.chars else 0.0


class _Elements(HTMLParser):
    """The elements of a page, with the characters of text and of links in each."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.root = self.open = _Element("", "", None, 0)
        self.every: list[_Element] = []
        self.hidden = self.linked = 0
        self.feed(html)
        self.close()
        while self.open is not self.root:
            self._leave(len(html))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, end: int) -> None:
        gone = self.open
        gone.end, self.open = end, gone.parent
        self.hidden -= gone.tag in _DROP
        self.linked -= gone.tag == "a"
        for sums in ("chars", "links", "commas"):
            setattr(self.open, sums, getattr(self.open, sums) + getattr(gone, sums))

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag in _CLOSES_ITSELF.get(self.open.tag, ()):
            self._leave(self._at())
        named = dict(attrs)
        one = _Element(tag, f"{named.get('class') or ''} {named.get('id') or ''}".lower(), self.open, self._at())
        self.open.children.append(one)
        self.every.append(one)
        self.open = one
        self.hidden += tag in _DROP
        self.linked += tag == "a"

    def handle_endtag(self, tag):
        at = self.open
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is self.root:
            return
        here = self._at()
        while self.open is not at:
            self._leave(here)
        self._leave(self.html.find(">", here) + 1 or len(self.html))

    def handle_data(self, data):
        if not self.hidden:
            text = " ".join(data.split())
            self.open.chars += len(text)
            self.open.commas += text.count(",")
            self.open.links += len(text) if self.linked else 0


def _weight(element: _Element) -> int:
    return 25 * any(n in element.name for n in CONTENT_NAMES) - 25 * any(n in element.name for n in OTHER_NAMES)


#: Parts of the main content that go if most of their text is links.
_LISTS = {"div", "section", "ul", "ol", "table"}


def _without_links(html: str, element: _Element) -> str:
    """An element's HTML without the lists of links in it."""
    out, at, waiting = [], element.start, list(reversed(element.children))
    while waiting:
        e = waiting.pop()
        if e.tag in _LISTS and e.chars >= 25 and e.link_share() > 0.5:
            out.append(html[at : e.start])
            at = e.end
        else:
            waiting += reversed(e.children)
    return "".join([*out, html[at : element.end]])


def main_content(html: str) -> str:
    """The part of a page that its text and links point to, as HTML: paragraphs pass a
    score to their parent and half of it to the one above; what has the highest score, less
    its share of links, is taken with those beside it that score well or are plain prose.
    The whole page, if there is no paragraph worth the name."""
    page = _Elements(html)
    scored: list[_Element] = []
    for e in page.every:
        bare = not any(c.tag in _BLOCK or c.tag in _PARAGRAPHS for c in e.children)
        if not (e.tag in ("p", "pre", "blockquote") or (e.tag in ("td", "div", "section") and bare)) or e.chars < 25 or e.link_share() > 0.5:
            continue
        points = 1 + e.commas + min(e.chars / 100, 3)
        for up, share in ((e.parent, 1.0), (e.parent.parent, 0.5)):
            if up is None or not up.tag or up.tag in ("html",):
                continue
            if not up.score:
                up.score = 1e-9 + _weight(up)
                scored.append(up)
            up.score += points * share
    best = max(scored, key=lambda e: e.score * (1 - e.link_share()), default=None)
    if best is None or best.tag == "body":
        keep = best.children if best else []
    else:
        keep = best.parent.children
    if not keep:
        return html
    top = best.score * (1 - best.link_share())
    least, out = max(10.0, 0.2 * top), []
    for e in keep:
        own = e.score * (1 - e.link_share()) + (0.2 * top if e.name.strip() and e.name == best.name else 0)
        plain = e.tag == "p" and e.link_share() < 0.25 and e.chars > 80
        headed = re.fullmatch(r"h[1-6]", e.tag) and best.tag == "body"
        if e is best or (e.tag not in _DROP and (own >= least or plain or headed or (best.tag == "body" and e.tag in _PARAGRAPHS and e.link_share() < 0.5))):
            out.append(_without_links(html, e))
    return "\n".join(out)


def html_to_markdown(html: str | None) -> str:
    """The main content of a page: an article or main element, if there is one, else what
    ``main_content`` finds."""
    if not html:
        return ""
    main = re.search(r"<(article|main)\b[^>]*>.*</\1\s*>", html, re.S | re.I)
    reader = _Markdown()
    reader.feed(main[0] if main else main_content(html))
    reader.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(reader.out))).strip()


def raw_markdown(url: str | None) -> bool:
    """Whether an address gives Markdown as it is."""
    return bool(url) and ("raw.githubusercontent.com" in url or url.strip().lower().endswith(".md"))


@F.pandas_udf(StringType())
def page_markdown(url: pd.Series, html: pd.Series) -> pd.Series:
    """Markdown of a page; one that is Markdown already is passed through."""
    return pd.Series([h if raw_markdown(u) else html_to_markdown(h) for u, h in zip(url, html, strict=True)])
