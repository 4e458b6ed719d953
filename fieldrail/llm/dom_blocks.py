"""Leaf blocks of HTML pages: text between the tags of block elements, and where it stands.

A page is walked once.  The open block elements are a path; tags that HTML lets authors leave out are closed by
what follows (a paragraph by the next block, a list item by the next one).  Inline elements are
passed over, but for links, whose characters are counted.  Scripts, styles, comments and the like have
no text.  Elements nested deeper than ``DEPTH`` stand in their last allowed ancestor, as in browsers.

Paths are nodes that share what they have in common, so a page's work grows with its length.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

DEPTH = 512
BITS = 16

#: Elements that stand on lines of their own, and elements whose content isn't text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object".split())
#: What an opening tag closes, up to the elements that stop it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_P_STOPS = frozenset("table td th caption button".split())

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKED = re.compile(r"\bdata-main=\"([01])\"")


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _signs(tag: str, attributes: str) -> frozenset[int]:
    """Features that an element gives to all blocks inside it."""
    found = {bucket(f"in {tag}")}
    for kind, *values in _NAMED.findall(attributes):
        for token in _TOKEN.findall("".join(values)):
            low = token.lower()
            found |= {bucket(f"{'role' if kind.lower() == 'role' else 'name'} {low}"), bucket(f"names {low[:4]}")}
    return frozenset(found)


@dataclass(eq=False)
class Node:
    """A path of open block elements; ``inside`` has the features of all of them."""

    tag: str
    parent: Node | None
    inside: frozenset[int]
    main: int | None = None
    children: dict[tuple[str, str], Node] = field(default_factory=dict)
    score: float | None = None

    def child(self, tag: str, attributes: str) -> Node:
        key = (tag, attributes)
        if key not in self.children:
            signs = _signs(tag, attributes)
            mark = _MARKED.search(attributes)
            self.children[key] = Node(tag, self, self.inside if signs <= self.inside else self.inside | signs, int(mark[1]) if mark else self.main)
        return self.children[key]

    def own(self) -> tuple[int, int]:
        """Features of the innermost element."""
        up = self.parent.tag if self.parent else ""
        return bucket(f"tag {self.tag}"), bucket(f"pair {up} {self.tag}")


def root() -> Node:
    return Node("body", None, frozenset())


@dataclass
class Block:
    text: str
    linked: int
    node: Node


def _tag_end(page: str, at: int, gone: set[str]) -> int:
    """The place of the tag's ``>``, past quoted values; -1 if there is none."""
    begin = at
    while found := _STOP.search(page, at):
        at = found.end()
        if found[0] == ">":
            return found.start()
        quote = found[0][-1]
        end = -1 if quote in gone else page.find(quote, at)
        if end < 0:
            gone.add(quote)
            return page.find(">", begin)
        at = end + 1
    return -1


def blocks(page: str, top: Node) -> tuple[list[Block], str]:
    """(leaf blocks with text in page order, title) of a page; paths start at ``top``."""
    out: list[Block] = []
    stack = [top]
    pieces: list[str] = []
    linked: list[str] = []
    gone: set[str] = set()  # what doesn't come any more
    link, title, at, size = False, "", 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            out.append(Block(text, len(" ".join(html.unescape(" ".join(linked)).split())), stack[-1]))
        pieces.clear()
        linked.clear()

    def put(text: str) -> None:
        if text:
            pieces.append(text)
            if link:
                linked.append(text)

    def close(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    def find(what: str, begin: int) -> int:
        end = -1 if what in gone else page.find(what, begin)
        if end < 0:
            gone.add(what)
        return end

    while found := _OPEN.search(page, at):
        begin = found.start()
        put(page[at:begin])
        kind = page[begin + 1]
        if kind in "!?":
            comment = page.startswith("<!--", begin)
            end = find("-->", begin + 2) if comment else find(">", begin)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        name = _NAME.match(page, begin + 1)
        if not name:  # "</" with no name: nothing, as in browsers
            end = find(">", begin)
            at = size if end < 0 else end + 1
            continue
        end = _tag_end(page, name.end(), gone)
        if end < 0:  # a tag that is cut off at the end of the page
            at = size
            break
        tag, at = name[1].lower(), end + 1
        if tag in HIDDEN and kind != "/":
            if page[end - 1] == "/" and tag in ("svg", "math"):
                continue
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I)
            past = None if tag in gone else shut.search(page, at)
            if past is None:
                gone.add(tag)
                continue
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at : past.start()]).split())
            stop = find(">", past.end())
            at = size if stop < 0 else stop + 1
            pieces.append(" ")
        elif tag == "a":
            link = kind != "/"
        elif tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            flush()
            if tag in ("html", "body", "head"):
                continue
            if kind == "/":
                close({tag}, frozenset())
                continue
            close({"p"}, _P_STOPS)
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag != "hr" and len(stack) <= DEPTH:
                stack.append(stack[-1].child(tag, page[name.end() : end]))
    put(page[at:])
    flush()
    return out, title


#: Upper ends of the classes of lengths.
_LENGTHS = (12, 25, 50, 100, 200, 400, 800)


def _class(value: float, ends: tuple[float, ...]) -> int:
    return sum(value > e for e in ends)


def _shape(block: Block) -> tuple[int, int, str]:
    return _class(len(block.text), _LENGTHS), _class(block.linked / max(len(block.text), 1), (0, 0.3, 0.6, 0.95)), block.node.tag


_SHAPES = {}


def _cached(*key: object) -> int:
    if key not in _SHAPES:
        if len(_SHAPES) > 1 << 16:
            _SHAPES.clear()
        _SHAPES[key] = bucket(" ".join(map(str, key)))
    return _SHAPES[key]


def text_features(found: list[Block], title: str) -> Iterator[list[int]]:
    """Features of each block's text and of its neighbours (not of its path)."""
    shapes = [("", "", "start"), *map(_shape, found), ("", "", "end")]
    n = len(found)
    for i, block in enumerate(found):
        text, (size, links, tag) = block.text, shapes[i + 1]
        ends, words = text[-1] in ".!?…。»\"”", text.count(" ") + 1
        out = [
            _cached("size", size),
            _cached("links", links),
            _cached("size links", size, links),
            _cached("tag size", tag, size),
            _cached("ends", ends),
            _cached("commas", _class(text.count(","), (0, 1, 3, 8))),
            _cached("stops", _class(text.count(". "), (0, 1, 3, 8))),
            _cached("capital", text[:1].isupper()),
            _cached("word", _class(len(text) / words, (3, 5, 7, 10))),
            _cached("signs", _class(sum(text.count(c) for c in "|©•·»→"), (0, 1))),
            _cached("from start", min(i, 6)),
            _cached("from end", min(n - 1 - i, 4)),
            _cached("before", *shapes[i]),
            _cached("after", *shapes[i + 2]),
            _cached("before tag", shapes[i][2], tag),
            _cached("after tag", tag, shapes[i + 2][2]),
            _cached("title", bool(title) and (text.startswith(title) or title.startswith(text))),
        ]
        yield out
