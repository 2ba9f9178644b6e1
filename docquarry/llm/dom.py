"""A forgiving HTML tree of block nodes with their texts, for content extraction."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

#: Names of elements by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
#: Without an end tag these reach to the end of the page; another one is passed over.
TO_END = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts semantics annotation".split()
)
#: These, and what they hold, end where their start tags close themselves.
FOREIGN = frozenset({"svg", "math"})
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An opening tag ends the open one of these, not beyond the boundary.
SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}

#: A quote counts behind an equals sign only; any other is a character of a tag. Outside of
#: quotes a tag holds no other tag's start, so each look ahead is short.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]++|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


@dataclass
class Node:
    """A variable of the model: an element that isn't plain inline markup."""

    tag: str
    parent: int
    depth: int
    attrs: str
    under: str = ""
    chars: int = 0
    link_chars: int = 0
    stops: int = 0
    paragraphs: int = 0


@dataclass
class Page:
    """Nodes in document order (parents first) and text pieces (node, block, text)."""

    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    """Attribute values by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(text: str) -> Page:
    """The page's block tree. Open elements end where HTML lets them; nothing is an error.

    Time is in proportion to the text: what is looked for upwards or ahead is known to be
    there first.
    """
    page = Page([Node("#root", -1, 0, "")])
    nodes, pieces = page.nodes, page.pieces
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, node, is a node's own
    block, links, at = 0, 0, 0
    scan, n = _TAG.search, len(text)
    is_open, unclosed = Counter(), set()  # open elements by name; raw ones without an end tag from here on

    def words(raw: str) -> None:
        if raw and not raw.isspace():
            node = stack[-1][1]
            told = entities.unescape(raw) if "&" in raw else raw
            pieces.append((node, block, told))
            own = nodes[node]
            own.chars += len(told)
            own.stops += told.count(".") + told.count(",") + told.count("?") + told.count("!")
            if links:
                own.link_chars += len(told)
        elif raw and pieces and pieces[-1][1] == block:
            pieces.append((stack[-1][1], block, " "))

    def close(count: int) -> None:
        nonlocal links, block
        for _ in range(count):
            tag = stack.pop()[0]
            is_open[tag] -= 1
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE:
                block += 1

    while m := scan(text, at):
        words(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not is_open[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(len(stack) - depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag not in INLINE and tag != "img" and tag != "input":
                block += 1
            continue
        if tag in RAW:
            end = None
            if not m[3].endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            if end:
                at = end.end()
            elif not m[3].endswith("/"):
                unclosed.add(tag)
                at = n if tag in TO_END else at
            continue
        if m[3].endswith("/") and (tag in FOREIGN or any(is_open[x] for x in FOREIGN)):
            continue
        if tag in CLOSES_P and is_open["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(len(stack) - depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in SIBLINGS and any(is_open[x] for x in SIBLINGS[tag][0]):
            same, limit = SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in limit:
                    break
                if stack[depth][0] in same:
                    close(len(stack) - depth)
                    break
        inline = tag in INLINE
        if tag == "a":
            links += 1
        if not inline:
            block += 1
        parent = stack[-1][1]
        is_open[tag] += 1
        if inline and not ("class" in m[3] or "id=" in m[3]):
            stack.append((tag, parent, False))
            continue
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, m[3], nodes[parent].tag))
        stack.append((tag, len(nodes) - 1, True))
    words(text[at:])
    for i in range(len(nodes) - 1, 0, -1):
        own, up = nodes[i], nodes[nodes[i].parent]
        up.chars += own.chars
        up.link_chars += own.link_chars
        up.stops += own.stops
        up.paragraphs += own.paragraphs + (own.tag == "p" and own.chars > 0)
    return page


def text_of(page: Page, content: list[bool]) -> str:
    """The kept nodes' text: white space as one space in a block, blocks joined by newlines."""
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if content[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)
