"""A small element tree over the standard library's HTML parser, for single pages.

A page's elements are numbered in page order, so that those within an element are a range of
numbers; tags and classes are looked up in indexes of the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import cached_property
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Plain markup, which every version of the parser reads alike: a start tag whose attributes are in double quotes
#: without references, an end tag, a comment without dashes, a doctype, or text before the next tag.
PLAIN = re.compile(r'<(?:([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*)[ \t\n\r\f]*(/?)>|/([a-zA-Z][a-zA-Z0-9]*)>|!(?:--[^->]*--|(?i:doctype)[^>]*)>)|([^<]+)(?=<)')
ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
#: Elements whose content isn't markup; of these only scripts and styles without a ``<`` are plain.
RAW, UNPLAIN = {"script", "style"}, {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}
RAW_CONTENT = re.compile(r"([^<]*)</(script|style)>")


class Index:
    """The elements of a page, and the numbers of those of each tag and class."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.tags: dict[str, list[int]] = defaultdict(list)
        self.classes: dict[str, list[int]] = defaultdict(list)

    def add(self, node: Node) -> None:
        at = len(self.nodes)
        node.at = at
        self.nodes.append(node)
        self.tags[node.tag].append(at)
        if said := node.attrs.get("class"):
            node.classes = set(said.split())
            for name in node.classes:
                self.classes[name].append(at)


class Node:
    classes: set[str] = frozenset()
    end: int | None = None  #: the number after those of the elements within; none while the element is open

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, index: Index):
        self.tag, self.attrs, self.parent, self.index, self.at = tag, attrs, parent, index, -1
        self.children: list[Node | str] = []

    def below(self) -> list[Node]:
        """All elements below, in page order."""
        return self.index.nodes[self.at + 1 : self.end]

    def _of(self, numbers: list[int]) -> list[int]:
        """Of rising element numbers, those within."""
        end = len(numbers) if self.end is None else bisect_left(numbers, self.end)
        return numbers[bisect_right(numbers, self.at) : end]

    def all(self, *tags: str, cls: str | None = None, where: Callable[[Node], bool] | None = None) -> list[Node]:
        nodes = self.index.nodes
        if cls is not None:
            found = [n for i in self._of(self.index.classes.get(cls, [])) if (n := nodes[i]) and (not tags or n.tag in tags)]
        elif tags:
            numbers = [i for t in dict.fromkeys(tags) for i in self._of(self.index.tags.get(t, []))]
            found = [nodes[i] for i in (numbers if len(tags) == 1 else sorted(numbers))]
        else:
            found = self.below()
        return found if where is None else [n for n in found if where(n)]

    def first(self, *tags: str, cls: str | None = None, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next(iter(self.all(*tags, cls=cls, where=where)), None)

    def text(self, without: set[str] = frozenset()) -> str:
        """All text, but for elements with a class of ``without``."""
        if not without and len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif not without or not node.classes & without:
                stack += reversed(node.children)
        return "".join(out)

    @cached_property
    def said(self) -> str:
        """All text with one space for white space; made once, as pages are only searched when whole."""
        return " ".join(self.text().split())

    def own_text(self) -> str:
        return " ".join(t for c in self.children if isinstance(c, str) and (t := c.strip()))

    def drop(self) -> None:
        """Takes a page that has been read apart: elements name each other, and would stay until Python looks for cycles."""
        for node in self.index.nodes:
            node.children.clear()
        self.children.clear()
        self.index.nodes.clear()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.index = Index()
        self.root = self.at = Node("", {}, None, self.index)

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at, self.index)
        self.index.add(node)
        self.at.children.append(node)
        if tag in VOID:
            node.end = node.at + 1
        else:
            self.at = node

    def handle_starttag(self, tag, attrs):
        self.start(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            end, closed = len(self.index.nodes), self.at
            while closed is not node.parent:
                closed.end = end
                closed = closed.parent
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def plain(self, html: str) -> int:
        """Reads plain markup from the start; where it ends."""
        at = 0
        while token := PLAIN.match(html, at):
            tag, attrs, empty, end, data = token.groups()
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif end:
                self.handle_endtag(end.lower())
            elif tag:
                tag, content = tag.lower(), None
                if tag in UNPLAIN:
                    content = RAW_CONTENT.match(html, token.end()) if tag in RAW and not empty else None
                    if content is None or content[2] != tag:
                        return at
                self.start(tag, {k.lower(): v for k, v in ATTRIBUTE.findall(attrs)} if attrs else {})
                if content:
                    if content[1]:
                        self.handle_data(content[1])
                    self.handle_endtag(tag)
                    at = content.end()
                    continue
                if empty:
                    self.handle_endtag(tag)
            at = token.end()
        return at


def parse(html: str | None) -> Node:
    html = html or ""
    builder = _Builder()
    builder.feed(html[builder.plain(html) :])
    unread = builder.rawdata if builder.cdata_elem else ""  # of a script that the page's end cuts off
    builder.close()
    if unread:
        builder.handle_data(unread)
    return builder.root


def text_of(node: Node | None) -> str:
    return node.said if node else ""
