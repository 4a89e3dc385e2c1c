"""Pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Elements whose content is no page text, those of them whose content is tags and not mere text, elements
#: that stand inside a line, elements without an end tag (or, as head, with one that pages leave out), and elements
#: that end an open one of the same kind (or of those named).
UNSEEN = {"script", "style", "noscript", "template", "title", "svg", "iframe", "object"}
NESTED = {"noscript", "template", "svg", "object"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img",
}
VOID = {"area", "base", "br", "col", "embed", "head", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S
)
_SPANS = {
    tag: re.compile(
        rf"<!--(?:.*?-->|.*\Z)|<(script|style|title|iframe)(?=[\s/>])(?:.*?</\1(?=[\s/>])|.*\Z)"
        rf"|<(/?){tag}(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<(/?){tag}(?=[\s/>])([^>]*)(?:>|\Z)", re.S | re.I
    )
    for tag in NESTED
}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


class Path:
    """An open element and, through its parent, those around it; equal parts of paths are shared."""

    __slots__ = ("parent", "tag", "names", "depth", "linked", "solid", "mask")

    def __init__(self, parent: Path | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names, self.mask = parent, tag, names, None
        self.depth = parent.depth + 1 if parent else 1
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.solid = (parent.solid if parent else None) if tag in INLINE else self  # the innermost element that isn't inside a line

    @classmethod
    def of(cls, parts: Iterable[tuple[str, tuple[str, ...]]]) -> Path | None:
        """The path of (tag, names) from the outside in."""
        path = None
        for tag, names in parts:
            path = cls(path, tag, names)
        return path

    def parts(self) -> list[tuple[str, tuple[str, ...]]]:
        out, at = [], self
        while at:
            out.append((at.tag, at.names))
            at = at.parent
        return out[::-1]


@dataclass(slots=True)
class Block:
    """A run of text that no block element divides. path: its elements, None at the top; linked: characters in links."""

    path: Path | None
    text: str
    linked: int = 0


@dataclass
class _Open:
    path: Path | None = None
    count: Counter = field(default_factory=Counter)
    text: list[str] = field(default_factory=list)
    link: list[str] = field(default_factory=list)
    began: bool = False
    seen: Path | None = None

    def pop(self) -> str:
        tag = self.path.tag
        self.path = self.path.parent
        self.count[tag] -= 1
        return tag


def _spans(page: str, tag: str) -> dict[int, int]:
    """Where each element of a kind that has an end tag begins, and where its end tag ends."""
    out, opened = {}, []
    for m in _SPANS[tag].finditer(page):
        if m[3] is None and m[5] is None:
            continue
        if not (m[2] or m[4]):
            if not (m[3] or m[5] or "").endswith("/"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, character references decoded and white space as single blanks; never empty ones."""
    page = page or ""
    state, out, at, spans = _Open(), [], 0, {}

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if not text.isspace() and not state.began:
                state.began, state.seen = True, state.path
            state.text.append(text)
            if state.path and state.path.linked:
                state.link.append(text)

    def end_block() -> None:
        text = " ".join("".join(state.text).split())
        if text:
            out.append(Block(state.seen, text, len(" ".join("".join(state.link).split()))))
        state.text, state.link, state.began, state.seen = [], [], False, None

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in UNSEEN:
            end_block()
        if end:
            if state.count[tag]:
                while state.pop() != tag:
                    pass
            continue
        if tag in UNSEEN and not rest.endswith("/"):
            if tag in NESTED:  # without an end tag only the tag itself goes
                if tag not in spans:
                    spans[tag] = _spans(page, tag)
                at = spans[tag].get(m.start(), at)
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            solid = state.path.solid if state.path else None
            if solid and (solid.tag == "p" or solid.tag in ENDS.get(tag, ())):
                while state.path is not solid.parent:
                    state.pop()
        if tag not in VOID and not rest.endswith("/"):
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if "=" in rest else ""
            state.path = Path(state.path, tag, tuple(_PART.findall(names)))
            state.count[tag] += 1
    add(page[at:])
    end_block()
    return out
