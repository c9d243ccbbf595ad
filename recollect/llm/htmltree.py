"""A tolerant HTML tree for content extraction: elements, and the text blocks that hang below them.

Nodes are numbered in page order, parents before children. Blocks are runs of text not interrupted
by a block-level boundary; inline elements don't make nodes of their own. Scripts, styles, comments,
the head and other text that isn't shown make none. A tag that the page's end cuts off is dropped. Time grows in
proportion to the page, also where tags, quotes or end tags are odd.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

_COMMENT, _ODD = re.compile(r"<!--.*?(?:-->|\Z)", re.S), re.compile(r"<[!?/][^>]*(?:>|\Z)")
#: Most tags: nothing in them opens another one, so the search for their end stays within them.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*)(?=[\s/>])((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*)>")
_NAME, _SPECIAL, _QUOTE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']"), re.compile(r"[\"']")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Fixed sets of the HTML standard: elements without content, with raw text, inline, not shown, and what their start tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input picture".split())
HIDDEN = set("head script style template noscript svg math canvas audio video object iframe select datalist textarea".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "thead"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = set("ul ol dl table body html article section div main aside nav header footer form".split())
_SPACE = re.compile(r"\s+")
_WORD, _LETTER = re.compile(r"[a-z]+"), re.compile("[a-zA-Z]")


@dataclass
class Page:
    """tag, parent, names (words of class, id and role), label of each node; text and linked characters of blocks."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    label: list[str | None] = field(default_factory=list)
    text: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)

    def add(self, tag: str, parent: int, names: list[str], label: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.label.append(label)
        return len(self.tag) - 1


class _Tags:
    """Where tags of a page end: at the first ``>`` outside quotes, or with the page. A tag with a quote that is never closed is
    none; its name may then end before a quote of its own. What lies ahead of a place is looked for once, whatever the
    number of tags that begin before it, so odd pages take time in proportion to their length."""

    def __init__(self, source: str):
        self.source = source
        self.ends: dict[int, int] = {}
        self.special = self.name = (0, -1)
        self.closing: list[int] = []

    def _next_special(self, at: int) -> int:
        low, high = self.special
        if not low <= at <= high:
            m = _SPECIAL.search(self.source, at)
            self.special = at, m.start() if m else len(self.source)
        return self.special[1]

    def _end(self, at: int) -> int:
        """Where a tag ends that is outside quotes at a place; -1 if a quote stays open."""
        seen, n = [], len(self.source)
        while True:
            at = self._next_special(at)
            if at in self.ends or at == n or self.source[at] == ">":
                out = self.ends.get(at, at)
                break
            seen.append(at)
            close = self.source.find(self.source[at], at + 1)
            if close < 0:
                out = -1
                break
            at = close + 1
        for place in seen:
            self.ends[place] = out
        return out

    def match(self, at: int) -> tuple[int, int] | None:
        """(end of the name, end of the tag without its ``>``) of a tag whose name begins here."""
        low, high = self.name
        if not low <= at < high:
            self.name = at, _NAME.match(self.source, at).end()
            quotes = [m.start() for m in _QUOTE.finditer(self.source, at, self.name[1])]
            self.closing = [q for q in quotes if self._end(q) >= 0]
        name = self.name[1]
        end = self._end(name)
        if end < 0:
            if not self.closing or self.closing[-1] <= at:
                return None
            name = self.closing[-1]
            end = self._end(name)
        return name, end


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def parse(source: str) -> Page:
    """The page's tree; node 0 is the root."""
    page = Page()
    open_: list[tuple[str, int]] = [("#root", page.add("#root", -1, []))]
    pieces: list[str] = []
    linked = hidden = anchors = 0
    raw_end = None
    tags, last = _Tags(source), defaultdict(list)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                node = page.add("#text", open_[-1][1], [])
                page.text[node], page.linked[node] = text, linked
            pieces.clear()
        linked = 0

    def said(begin: int, end: int) -> int:
        nonlocal linked
        if not hidden:
            pieces.append(source[begin:end])
            if anchors:
                linked += len(source[begin:end].strip())
        return end

    def close(count: int) -> None:
        nonlocal hidden
        for _ in range(count):
            tag = open_.pop()[0]
            last[tag].pop()
            hidden -= tag in HIDDEN

    def innermost(names: set[str]) -> int:
        """The place of the innermost open element of these names, 0 without one."""
        return max((last[t][-1] for t in names if last[t]), default=0)

    at, n = 0, len(source)
    while at < n:
        if raw_end is not None:
            stop = raw_end.search(source, at)
            at, raw_end = (stop.start() if stop else n), None
            continue
        if source[at] != "<":
            end = source.find("<", at)
            at = said(at, n if end < 0 else end)
            continue
        m = _PLAIN.match(source, at)
        if m:
            closes, tag, attrs, at = bool(m[1]), m[2].lower(), m[3], m.end()
        else:
            closes, m = source.startswith("</", at), _COMMENT.match(source, at)
            found = tags.match(at + 1 + closes) if not m and _LETTER.match(source, at + 1 + closes) else None
            if not found:
                m = m or _ODD.match(source, at)
                at = m.end() if m else said(at, at + 1)
                continue
            name, end = found
            tag, attrs, at = source[at + 1 + closes : name].lower(), source[name:end], min(end + 1, n)
        if tag in INLINE or tag == "br":
            if tag == "a":
                anchors = max(0, anchors - 1) if closes else anchors + 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        anchors = 0
        if closes:
            if last[tag]:
                close(len(open_) - last[tag][-1])
            continue
        above = open_[-1][0]
        if above == "p":
            close(1)
        elif tag in CLOSES:
            depth = innermost(CLOSES[tag])
            if depth > innermost(SCOPE):
                close(len(open_) - depth)
        if tag in VOID:
            continue
        attrs = _attributes(attrs) if attrs else {}
        names = _WORD.findall(" ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower())
        last[tag].append(len(open_))
        open_.append((tag, page.add(tag, open_[-1][1], names, attrs.get("data-y"))))
        hidden += tag in HIDDEN
        if tag in RAW:
            raw_end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I)
    flush()
    return page
