"""A small tree for HTML as pages deliver it, and the outline that parsers fill."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "wbr"}
_HIDDEN = {"script", "style", "template", "noscript"}
_INLINE = {"a", "abbr", "b", "em", "i", "span", "strong", "sub", "sup", "u", "small", "br", "q", "cite", "code"}


class SourceError(ValueError):
    """A source that does not have the structure expected; nothing of it may be taken over."""


@dataclass
class Tag:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Tag | str] = field(default_factory=list)

    def tags(self, *names: str) -> list[Tag]:
        """The direct children with one of the names; all of them without names."""
        return [c for c in self.children if isinstance(c, Tag) and (not names or c.name in names)]

    def walk(self):
        """All tags below, in document order."""
        for c in self.tags():
            yield c
            yield from c.walk()

    def first(self, *names: str) -> Tag | None:
        return next((t for t in self.walk() if t.name in names), None)

    def has(self, css: str) -> bool:
        return css in self.attrs.get("class", "").split()

    def text(self) -> str:
        """The wording below, blanks squeezed; only block tags separate words."""
        return squeeze(self._raw())

    def _raw(self) -> str:
        parts = []
        for c in self.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.name not in _HIDDEN:
                inner = c._raw()
                parts.append(inner if c.name in _INLINE and c.name != "br" else f" {inner} ")
        return "".join(parts)


def squeeze(text: str) -> str:
    """Blanks of every kind as single ones, none at the ends."""
    return " ".join(text.replace("​", "").split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Tag("")
        self.open = [self.root]

    def handle_starttag(self, name, attrs):
        tag = Tag(name, {k: v or "" for k, v in attrs})
        if name in ("p", "li", "tr", "td") and self.open[-1].name == name:
            self.open.pop()
        self.open[-1].children.append(tag)
        if name not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, name, attrs):
        self.open[-1].children.append(Tag(name, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, name):
        if any(t.name == name for t in self.open[1:]):
            while self.open.pop().name != name:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read_html(page: str) -> Tag:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


@dataclass
class Block:
    """A paragraph (no mark) or a list item with its mark and nesting depth."""

    text: str
    mark: str | None = None
    depth: int = 0

    def row(self) -> dict:
        return {"art": "p" if self.mark is None else "punkt", "m": self.mark, "t": self.text, "tiefe": self.depth}


@dataclass
class Node:
    id: str
    kind: str
    number: str | None = None
    label: str | None = None
    title: str | None = None
    path: str | None = None
    parent: Node | None = None
    blocks: list[Block] = field(default_factory=list)


class Outline:
    """Nodes in document order; the tree is in their parents."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.title: str | None = None
        self.date: str | None = None

    def add(self, node: Node) -> Node:
        self.nodes.append(node)
        return node

    def keep_with_text(self) -> None:
        """Drop branches that hold no text at all."""
        needed = set()
        for n in self.nodes:
            at = n if n.blocks else None
            while at is not None and id(at) not in needed:
                needed.add(id(at))
                at = at.parent
        self.nodes = [n for n in self.nodes if id(n) in needed]

    def require(self, least: int) -> Outline:
        """Raise unless at least ``least`` nodes hold text: a broken source must not replace a good version."""
        found = sum(bool(n.blocks) for n in self.nodes)
        if found < least:
            raise SourceError(f"only {found} passages with text, {least} expected")
        return self

    def rows(self) -> list[dict]:
        depth: dict[int, int] = {}
        out = []
        for k, n in enumerate(self.nodes):
            depth[id(n)] = depth.get(id(n.parent), -1) + 1 if n.parent else 0
            out.append({"id": n.id, "eltern": n.parent.id if n.parent else None, "ord": k, "tiefe": depth[id(n)], "art": n.kind, "nummer": n.number, "bez": n.label, "titel": n.title, "pfad": n.path, "bloecke": [b.row() for b in n.blocks]})
        return out


_MARK = re.compile(r"^\(?(?:\d{1,3}|[a-zA-Z]{1,5})[.)]\)?$")


def is_mark(text: str) -> bool:
    """Whether a short text is the mark of a list item: 1. a) (2) iii)"""
    return len(text) <= 7 and bool(_MARK.match(text))
