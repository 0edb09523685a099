"""HTML pages as sequences of leaf blocks with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element kinds of HTML.
_RAW = frozenset("script style noscript template iframe object svg math head title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_ENDS_ITSELF = frozenset("li dt dd tr td th option p".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PIECE = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """An open block-level element. Blocks of one element share its node, and a node its parent's chain."""

    name: str
    words: list[str]  # class, id and role words
    parent: Node | None
    depth: int
    memo: object = None  # what a reader of the path keeps here


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None  # the element it stands in; None at the top
    linked: int  # characters inside links


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order: runs of text between block-level tags, character references decoded, white space folded.

    Scripts, styles, comments and the head hold no text. Tags left open or cut off at the end are taken as
    browsers take them: an unclosed element ends with its parent, a list item or paragraph with the next. Time
    and memory are linear in the page whatever the nesting: open elements are found by name.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[str] = []  # names of open elements
    open_at: dict[str, list[int]] = {}  # their places in the stack, by name
    solid: list[tuple[int, Node]] = []  # the block-level ones
    texts: list[str] = []
    linked = 0
    at, size = 0, len(page)

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append(Block(text, solid[-1][1] if solid else None, linked))
            texts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        texts.append(text)
        if open_at.get("a"):
            linked += len(text)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop()].pop()
        while solid and solid[-1][0] >= depth:
            solid.pop()

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if m.group(1) or m.group(4):
            if not inline:
                close()
            places = open_at.get(name)
            if places and (not inline or not solid or solid[-1][0] < places[-1]):
                leave(places[-1])
            continue
        if name in _RAW and name != "head":
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            close()
            continue
        if name in _VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                close()
            continue
        if not inline:
            close()
            if solid and (name in _ENDS_ITSELF or stack[-1] in _INLINE or stack[-1] == "p"):
                place, open_name = solid[-1][0], solid[-1][1].name
                if open_name == "p" or open_name == name and name in _ENDS_ITSELF or {open_name, name} <= {"td", "th"} or {open_name, name} <= {"dt", "dd"}:
                    leave(place)
        given = m.group(3) or m.group(6) or ""
        if given.rstrip().endswith("/") and not inline:
            continue
        if not inline:
            words: list[str] = []
            if given and not given.isspace():
                for a, b, c in _NAMED.findall(given):
                    words += _PIECE.findall((a or b or c).lower())
            parent = solid[-1][1] if solid else None
            solid.append((len(stack), Node(name, words, parent, parent.depth + 1 if parent else 1)))
        open_at.setdefault(name, []).append(len(stack))
        stack.append(name)
    close()
    return found
