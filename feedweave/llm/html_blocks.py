"""Pages as sequences of leaf blocks: text between block-level tags, with the path of open elements."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterator, Sequence
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")

#: Element names of the HTML standard, by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style template noscript iframe svg math object".split())
#: An element that one of the same kind, or any block, closes.
SAME_CLOSES = frozenset("li dt dd tr td th option thead tbody tfoot optgroup".split())
#: An element that one outside it can't be closed through by the next of its kind.
HOLDS_ITEMS = ("ul", "ol", "dl", "table", "select")

#: Quotes hold a > or < only after an =; outside them a tag ends at the next < too, so that no tag is read further than once.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|(?=<)|\Z)", re.DOTALL)
_OPEN_END = re.compile(r"<[/A-Za-z!?][^<>]*\Z")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN}


class Path:
    """Open elements from the root on: a chain that paths share, so that a block costs no copy of it.

    names: what the innermost element says of itself; fresh: those that no element around it says.
    """

    __slots__ = ("parent", "names", "fresh", "inner")
    made = 0

    def __init__(self, parent: Path | None, names: tuple[str, ...], fresh: tuple[str, ...]):
        self.parent, self.names, self.fresh = parent, names, fresh
        self.inner: dict[tuple[str, ...], Path] = {}

    def child(self, names: tuple[str, ...], around: Container[str]) -> Path:
        """The path of an element inside; around: all names on this path. Equal paths of one root are one object."""
        found = self.inner.get(names)
        if found is None:
            found = self.inner[names] = Path(self, names, tuple(dict.fromkeys(x for x in names if x not in around)))
            Path.made += 1
        return found

    def backwards(self) -> Iterator[str]:
        at = self
        while at is not None:
            yield from reversed(at.names)
            at = at.parent

    def __iter__(self) -> Iterator[str]:
        return iter(list(self.backwards())[::-1])

    def fold(self, known: dict[Path, T], start: T, step: Callable[[T, Path], T]) -> T:
        """step(value of the parent, path) from the root on; known keeps the values, so that each path is stepped once."""
        way, at = [], self
        while at.parent is not None and at not in known:
            way.append(at)
            at = at.parent
        value = known.get(at, start)
        for at in reversed(way):
            value = known[at] = step(value, at)
        return value


#: Paths that one root keeps for later pages.
KEPT_PATHS = 50_000
_root = Path(None, (), ())


def root() -> Path:
    """Where paths begin: the same root for many pages, a new one after KEPT_PATHS paths."""
    global _root
    if Path.made > KEPT_PATHS:
        _root, Path.made = Path(None, (), ()), 0
    return _root


def path_of(names: Sequence[str]) -> Path:
    """A path of elements that say one name each."""
    at, around = root(), set()
    for name in names:
        at = at.child((name,), around)
        around.add(name)
    return at


@dataclass
class Block:
    text: str
    path: Path
    linked: int  # code points of the text inside links


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    """What the path says of an element: its name, and the words of its class, id and role."""
    if "=" not in attributes:
        return (name,)
    words = [w for found in _NAMES.findall(attributes.lower()) for w in _WORD.findall("".join(found))]
    return (name, *words)


class _Open:
    """The open elements. What would be a walk over all of them is looked up by name, so that deep nesting costs no more than flat."""

    def __init__(self):
        self.elements: list[tuple[str, str]] = []
        self.by_name: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # which of them are blocks
        self.paths = [root()]  # of the first elements, as far as a block of text has asked for them
        self.names: Counter[str] = Counter()  # on the last of these

    def push(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.blocks.append(len(self.elements))
        self.by_name[name].append(len(self.elements))
        self.elements.append((name, attributes))

    def pop(self, to: int) -> None:
        while len(self.elements) > to:
            self.by_name[self.elements.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        while len(self.paths) > to + 1:
            for x in self.paths.pop().names:
                self.names[x] -= 1
                if not self.names[x]:
                    del self.names[x]

    def last(self, name: str) -> int:
        """Where the innermost element of that name is; -1 if there is none."""
        found = self.by_name.get(name)
        return found[-1] if found else -1

    def path(self) -> Path:
        for name, attributes in self.elements[len(self.paths) - 1:]:
            own = _tokens(name, attributes)
            self.paths.append(self.paths[-1].child(own, self.names))
            self.names.update(own)
        return self.paths[-1]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; white space is single spaces, character references are decoded.

    Unclosed markup is closed much as browsers do; a tag without its > ends
    where the next begins, or is dropped at the page's end. Time grows with
    the page's length, whatever is unclosed or nested in it.
    """
    out: list[Block] = []
    open_ones = _Open()
    parts: list[str] = []
    linked = 0
    page = _OPEN_END.sub("", page)

    def end() -> None:
        nonlocal linked
        if parts:
            whole = " ".join(html.unescape("".join(parts)).split())
            if whole:
                out.append(Block(whole, open_ones.path(), min(linked, len(whole))))
            parts.clear()
            linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if open_ones.last("a") >= 0:
            linked += len(raw)

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if at < m.start():
            text(page[at:m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in HIDDEN:
            if not m[2] and not m[4].endswith("/"):
                close = _HIDDEN_END[name].search(page, at)
                at = close.end() if close else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name not in INLINE
        if block:
            end()
        if m[2]:
            where = open_ones.last(name)
            # an inline end tag reaches no further than the block it is in
            if where >= 0 and (block or not open_ones.blocks or open_ones.blocks[-1] < where):
                open_ones.pop(where)
            continue
        if block:
            where = open_ones.last("p")
            if where >= 0:
                open_ones.pop(where)
            if name in SAME_CLOSES and (where := open_ones.last(name)) > max(map(open_ones.last, HOLDS_ITEMS)):
                open_ones.pop(where)
        if name not in VOID and not m[4].endswith("/"):
            open_ones.push(name, m[4])
    if at < len(page):
        text(page[at:])
    end()
    return out
