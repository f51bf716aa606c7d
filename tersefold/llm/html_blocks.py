"""HTML cut into DOM leaf blocks: texts with the elements around them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br img".split())
RAW = "script|style|textarea|title|iframe|noscript|noembed|noframes|xmp|svg|template"
CLOSED_BY = {  # an open element of the key is closed by the start of one of these
    "p": frozenset(
        "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
        "h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPES = frozenset(["ul", "ol", "dl", "table", "select", "body", "article", "section", "div", "td", "th"])
SECTIONS = frozenset("article aside footer form header main nav section td".split())
CLOSES: dict[str, list[str]] = {}
for _open, _starts in CLOSED_BY.items():
    for _start in _starts:
        CLOSES.setdefault(_start, []).append(_open)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+(?:>|\Z)"
    r"|<svg(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"  # closed by itself, holds nothing
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*+(?:>(?:.*?</(?P=raw)\s*+>|.*\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True, eq=False)
class Place:
    """An open block-level element: what it adds to those around it, so deep nesting costs no more than its elements.

    words: of class, id and role. fresh_tag, fresh_words: what no element around it has.
    sections: the last two sections, itself included. nearest: words of the innermost
    element that has any. score is for the reader's use.
    """

    tag: str
    words: tuple[str, ...]
    parent: Place | None
    fresh_tag: bool
    fresh_words: tuple[str, ...]
    sections: tuple[str, ...]
    nearest: tuple[str, ...]
    score: tuple[float, float] | None = None


@dataclass(slots=True)
class Block:
    text: str
    place: Place | None  # of the innermost block-level element
    link_chars: int


class _Stack:
    """Open elements, outermost first, with the places of each tag; every question takes constant time."""

    def __init__(self):
        self.tags: list[str] = []
        self.places: list[Place] = []
        self.at: dict[str, list[int]] = {}     # of each tag
        self.blocks: list[int] = []            # of block-level elements
        self.scopes: list[int] = []
        self.tag_count: Counter[str] = Counter()
        self.word_count: Counter[str] = Counter()
        self.links = 0

    @property
    def place(self) -> Place | None:
        return self.places[-1] if self.places else None

    def push(self, tag: str, attrs: str) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(k)
        self.links += tag == "a"
        if tag in SCOPES:
            self.scopes.append(k)
        if tag in INLINE:
            return
        self.blocks.append(k)
        around, words = self.place, _attr_words(attrs)
        sections, nearest = (around.sections, around.nearest) if around else ((), ())
        self.places.append(Place(
            tag, words, around, not self.tag_count[tag], tuple(w for w in words if not self.word_count[w]),
            (*sections[-1:], tag) if tag in SECTIONS else sections, words or nearest))
        self.tag_count[tag] += 1
        self.word_count.update(words)

    def cut(self, k: int) -> None:
        """Close the element at k and those inside it."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.at[tag].pop()
            self.links -= tag == "a"
            if tag in SCOPES:
                self.scopes.pop()
            if tag not in INLINE:
                self.blocks.pop()
                place = self.places.pop()
                self.tag_count[tag] -= 1
                self.word_count.subtract(place.words)

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its tag; an inline one none beyond a block."""
        k = self.at[tag][-1] if self.at.get(tag) else -1
        if k >= 0 and (tag not in INLINE or not self.blocks or k > self.blocks[-1]):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Close the innermost element that a start of `tag` closes, if no scope is inside it."""
        k = max((self.at[t][-1] for t in CLOSES.get(tag, ()) if self.at.get(t)), default=-1)
        if k >= 0 and (not self.scopes or k >= self.scopes[-1]):
            self.cut(k)


def _attr_words(attrs: str) -> tuple[str, ...]:
    return tuple(sorted({w.lower() for m in _NAMED.finditer(attrs) for w in _PARTS.findall(m[1] or m[2] or m[3] or "")}))


def blocks(page: str) -> list[Block]:
    """Texts between block-level tags, references decoded, white space folded, with their elements.

    Unclosed and wrongly nested elements are closed as far as their kind tells.
    Comments, scripts, styles, titles and the like hold no text.
    """
    out: list[Block] = []
    stack = _Stack()
    text: list[str] = []
    linked, said_some = 0, False
    place: Place | None = None

    def flush() -> None:
        nonlocal linked, said_some
        if said_some:
            out.append(Block(" ".join("".join(text).split()), place, linked))
        text.clear()
        linked, said_some = 0, False

    def say(raw: str) -> None:
        nonlocal linked, place, said_some
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            text.append(said)
            visible = said.strip()
            if visible and not said_some:
                place, said_some = stack.place, True
            if stack.links:
                linked += len(visible)

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at: m.start()])
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m["end"] or m["end2"]:
            stack.end(tag)
            continue
        if tag == "br":
            text.append(" ")
        stack.make_room(tag)
        if tag not in VOID:
            stack.push(tag, m["attrs"] or m["attrs2"] or "")
    say(page[at:])
    flush()
    return out
