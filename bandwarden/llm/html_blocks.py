"""Blocks of raw HTML pages: leaf texts in page order, each with the path of elements above it."""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Quotes count after an equals sign only; nothing is tried twice, so a page takes time in proportion to its length.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>])*+)>|[^<]++|<""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")

#: Elements whose text is never shown as such; everything up to their end is passed over.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas textarea select".split())
_RAW = frozenset("script style title textarea noscript iframe template".split())  # no tags inside
#: Elements inside a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr br img".split())
_IN_HEAD = frozenset("base link meta noscript script style template title bgsound basefont noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                    "section table ul".split())


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]   # per element: its tag, then the parts of its class, id and role
    text: str
    link_chars: int = 0


@dataclass
class _Reader:
    stack: list[tuple[str, ...]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    link: int = 0
    link_chars: int = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(tuple(self.stack), text, self.link_chars))
            self.parts, self.link_chars = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        if tag in _ENDS_P and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        if tag in _CLOSES and self.stack and self.stack[-1][0] in _CLOSES[tag]:
            self.stack.pop()
        if tag not in VOID:
            names = [x for m in _NAMES.findall(attributes) for x in _PART.findall("".join(m).lower())] if attributes.strip() else []
            self.stack.append((tag, *names))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in INLINE:
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break


def page_blocks(page: str | None) -> list[Block]:
    """Blocks of a page; unclosed and misnested elements are closed as late as their neighbours allow.

    A hidden element that nobody closes hides no more than it must: a head ends with the first thing that cannot stand in
    one, a drawing or a list of options with the first block, the others with the block around them; one that
    is open at the end of the page is read as an ordinary block."""
    page, plain = page or "", set()
    while True:
        blocks, unclosed = _read(page, plain)
        if unclosed is None:
            return blocks
        plain.add(unclosed)   # at most once for each kind of hidden element


def _read(page: str, plain: set[str]) -> tuple[list[Block], str | None]:
    """Blocks, and the kind of hidden element that was left open; kinds in ``plain`` hide nothing."""
    reader, at = _Reader(), 0
    hidden, inner = None, {}
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m.group(2)
        if not tag:
            text = m.group(0)
            if text.startswith(("<!", "<?")):
                continue
            if hidden == "head" and not text.isspace():
                hidden = None
            if hidden is None:
                reader.parts.append(text)
                reader.link_chars += reader.link * len(text)
            continue
        tag, closing, attributes = tag.lower(), bool(m.group(1)), m.group(3)
        if hidden is not None and _ends_hidden(hidden, inner, tag, closing, reader):
            hidden = None
            if closing and tag in HIDDEN:
                continue
        if tag in _RAW and not closing and tag not in plain and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None and hidden is None and tag not in ("script", "style"):
                return [], tag
            at = end.end() if end else len(page)
        elif hidden is not None:
            if tag not in VOID and not attributes.endswith("/"):
                inner[tag] = inner.get(tag, 0) + (-1 if closing else 1)
        elif tag in HIDDEN and tag not in plain and not closing and not attributes.endswith("/"):
            hidden, inner = tag, {tag: 1}
            reader.flush()
        elif closing:
            reader.close(tag)
        else:
            reader.open(tag, attributes)
    reader.flush()
    return reader.blocks, None if hidden in (None, "head") else hidden


def _ends_hidden(hidden: str, inner: dict[str, int], tag: str, closing: bool, reader: _Reader) -> bool:
    """Whether a tag ends the hidden element; ``inner`` counts what is open in it, itself included."""
    if closing:
        if inner.get(tag, 0) > 0:
            return tag == hidden and inner[tag] == 1
        return any(names[0] == tag for names in reader.stack)
    if hidden == "head":
        return tag not in _IN_HEAD
    return hidden in ("select", "svg", "math") and tag in _ENDS_P and not inner.get("foreignobject")
