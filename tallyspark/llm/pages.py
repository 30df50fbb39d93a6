"""Leaf blocks of HTML pages, and what a model can tell of them.

A leaf block is the text between two borders of block-level elements. The
reader follows the rules of HTML where they matter for blocks: tags that are
implied or never closed, comments, raw text, character references.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
UNREAD = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset(["template", "head"])
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol optgroup option p "
    "pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body button caption html label noscript optgroup option select svg tbody td template tfoot th thead tr".split())
#: An element of the key is ended by a start tag of one of the values, if no element of the second set is between.
_CELLS = frozenset(["td", "th"])
_ROWS = frozenset(["tr", "tbody", "thead", "tfoot"])
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "td": (_CELLS, frozenset(["table", "tr"])),
    "th": (_CELLS, frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]) | _CELLS, frozenset(["table"])),
    "tbody": (_ROWS | _CELLS, frozenset(["table"])),
    "thead": (_ROWS | _CELLS, frozenset(["table"])),
    "tfoot": (_ROWS | _CELLS, frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_SCOPE = frozenset(["td", "th", "table", "button", "caption", "template", "html"])
_TABLE = frozenset(["table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "body", "html"])
#: Elements nested deeper are read as if their tags were not there.
DEPTH = 512

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(
    r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?)"""
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in UNREAD}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    parent: Element | None
    traits: tuple[str, ...] = ()
    known: frozenset | None = None


@dataclass
class Block:
    element: Element
    text: str
    linked: int
    bold: bool


@dataclass
class _Reader:
    """Open elements and the text of the block that is being read."""

    root: Element = field(default_factory=lambda: Element("body", None))
    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)
    too_deep: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bold: int = 0
    length: int = 0

    def text(self, raw: str) -> None:
        if not raw:
            return
        if any(self.count.get(name) for name in HIDDEN):
            # text that is not blank ends the head
            if self.count.get("template") or not raw.strip():
                return
            self.close(lambda tag: tag == "head")
        shown = unescape(raw) if "&" in raw else raw
        self.parts.append(shown)
        solid = len(shown) - shown.count(" ")
        self.length += solid
        if self.count.get("a"):
            self.linked += solid
        if self.count.get("b") or self.count.get("strong"):
            self.bold += solid

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                above = self.stack[-1] if self.stack else None
                while above is not None and above.tag not in BLOCKS:
                    above = above.parent
                self.blocks.append(Block(above or self.root, text, self.linked, 2 * self.bold > self.length))
        self.parts, self.linked, self.bold, self.length = [], 0, 0, 0

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.count[tag] -= 1
        return tag

    def close(self, wanted, stop=frozenset(), last: bool = False) -> bool:
        """End the innermost wanted element, or with ``last`` the outermost, and all inside it."""
        found = -1
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if wanted(tag):
                found = i
                if not last:
                    break
            elif tag in stop:
                break
        if found < 0:
            return False
        while len(self.stack) > found:
            self.pop()
        return True

    def start(self, tag: str, traits: tuple[str, ...]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P and self.count.get("p"):
                self.close(lambda t: t == "p", _SCOPE)
            if tag in CLOSES:
                ends, stop = CLOSES[tag]
                self.close(ends.__contains__, stop, last=True)
        if tag in VOID:
            return
        if tag in ("html", "body") and self.count.get(tag):
            return
        if len(self.stack) >= DEPTH:
            self.too_deep[tag] = self.too_deep.get(tag, 0) + 1
            return
        self.stack.append(Element(tag, self.stack[-1] if self.stack else None, traits))
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        if self.too_deep.get(tag):
            self.too_deep[tag] -= 1
        elif self.count.get(tag) and tag not in ("html", "body"):
            stop = frozenset() if tag in _TABLE else _SCOPE if tag in BLOCKS else BLOCKS
            self.close(lambda t: t == tag, stop - {tag})


def _tokens(value: str) -> list[str]:
    return [token.lower() for token in _TOKEN.findall(value)]


def _traits(attributes: dict[str, str]) -> tuple[str, ...]:
    """Words of the class, id, role and the like, whole and by their first four letters."""
    named = " ".join(attributes.get(name, "") for name in ("class", "id", "role", "itemprop", "aria-label"))
    if not named.strip() and "hidden" not in attributes and "style" not in attributes:
        return ()
    found = []
    for token in _tokens(named)[:24]:
        found += [f"name={token}", f"name={token[:4]}.."] if len(token) > 4 else [f"name={token}"]
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or "display:none" in style or "visibility:hidden" in style:
        found.append("unseen")
    return tuple(dict.fromkeys(found))


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order.

    White space of a block is one blank, none at its ends. A tag or comment
    that never ends takes the rest of the page; a quote that never ends is none.
    """
    reader, at, text_from, size = _Reader(), 0, 0, len(html)
    while True:
        tag_at = html.find("<", at)
        if tag_at < 0:
            reader.text(html[text_from:])
            break
        mark = html[tag_at + 1 : tag_at + 2]
        ending = mark == "/"
        letter = html[tag_at + 2 : tag_at + 3] if ending else mark
        if not (letter.isascii() and letter.isalpha()):
            if mark not in ("!", "?", "/") or not mark:
                at = tag_at + 1
                continue
            reader.text(html[text_from:tag_at])
            if html.startswith("<!--", tag_at):
                # <!--> and <!---> are whole comments
                close = html.find("-->", tag_at + 2)
                at = close + 3 if close >= 0 else size
            else:
                close = html.find(">", tag_at)
                at = close + 1 if close >= 0 else size
            text_from = at
            continue
        reader.text(html[text_from:tag_at])
        name = _NAME.match(html, tag_at + 1 + ending)
        tag, at, attributes = name.group().lower(), name.end(), {}
        while True:
            found = _ATTRIBUTE.match(html, at)
            at = found.end() if found else size
            if not found or found.group(1):
                break
            key = found.group(2).lower()
            value = found.group(3) or found.group(4) or found.group(5) or ""
            if key not in attributes:
                attributes[key] = value
        text_from = at
        if not found:
            break
        if ending:
            reader.end(tag)
        elif tag in UNREAD:
            close = _END[tag].search(html, at)
            at = text_from = close.start() if close else size
            if close:
                close = html.find(">", at)
                at = text_from = close + 1 if close >= 0 else size
        else:
            reader.start(tag, _traits(attributes))
    reader.flush()
    return reader.blocks


_KNOWN: dict[tuple, frozenset] = {}
#: Sets of ancestors' features that a worker keeps; when there are more, it starts anew.
KEPT_PATHS = 100_000
_SECTIONS = frozenset("article aside body footer form header main nav section table".split())


def path_features(element: Element) -> frozenset:
    """Features of an element and its ancestors, as one set; equal paths share it."""
    chain = []
    while element is not None and element.known is None:
        chain.append(element)
        element = element.parent
    known = element.known if element is not None else frozenset()
    for element in reversed(chain):
        key = (known, element.tag, element.traits)
        found = _KNOWN.get(key)
        if found is None:
            if len(_KNOWN) >= KEPT_PATHS:
                _KNOWN.clear()
            own = {f"in={element.tag}", *element.traits}
            if element.tag in _SECTIONS:
                own.add(f"section={element.tag}")
                known = frozenset(f for f in known if not f.startswith("section="))
            found = _KNOWN[key] = known | own
        known = element.known = found
    return known


def _bucket(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= bound for bound in bounds)


_WORD = re.compile(r"[^\W\d_]+")


def features(page: list[Block]) -> list[tuple[frozenset, list[str]]]:
    """Per block: the shared set of its path's features, and those of its text and place in the page."""
    sums: dict[int, int] = {}
    for block in page:
        above = block.element.parent
        sums[id(above)] = sums.get(id(above), 0) + max(0, len(block.text) - block.linked)
    densest = max(sums.values(), default=0)
    heads = [block.element.parent for block in page if block.element.tag == "h1"]
    head = heads[0] if heads else None
    under: dict[int, bool] = {}
    found = []
    seen_head = False
    for number, block in enumerate(page):
        element, text = block.element, block.text
        words = text.count(" ") + 1
        own = [
            "bias",
            f"leaf={element.tag}",
            f"up={element.parent.tag if element.parent else 'none'}",
            f"words={_bucket(words, (2, 4, 8, 16, 32, 64))}",
            f"linked={_bucket(block.linked / max(1, len(text)), (0.01, 0.25, 0.5, 0.8))}",
            f"dense={_bucket(sums[id(element.parent)] / max(1, densest), (0.02, 0.1, 0.3, 0.6, 1.0))}",
        ]
        if text[-1] in ".!?…。":
            own.append("sentence")
        if block.bold:
            own.append("bold")
        if "©" in text:
            own.append("copyright")
        if head is not None:
            chain, inside = element, None
            passed = []
            while chain is not None and inside is None:
                passed.append(id(chain))
                inside = under.get(id(chain), True if chain is head else None)
                chain = chain.parent
            for known in passed:
                under[known] = bool(inside)
            own.append("beside_head" if inside else "away_from_head")
            seen_head = seen_head or element.tag == "h1"
            own.append("after_head" if seen_head else "before_head")
        own += [f"word={w.lower()}" for w in dict.fromkeys(_WORD.findall(text))] if words <= 40 else []
        found.append((path_features(element), own))
    return found
