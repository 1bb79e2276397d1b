"""A small, forgiving HTML reader: text blocks with the elements they stand in.

Only what text extraction needs: elements that may be left open are closed where
HTML closes them, end tags without start are ignored, scripts, styles, templates,
comments and the head hold no text. One pass over the page, no recursion.
"""

from __future__ import annotations

import html
import re

#: Tags that do not end a block of text.
INLINE = frozenset("a b br code em kbd span strong".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template textarea svg iframe object".split())
BLOCKS = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:\s*(?:\"[^\"]*\"|'[^']*'|[^'\">\s]|\s)+?)??)\s*>|(?P<text>[^<]+)|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: Which open element a start tag ends, and which elements shield it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}


class Element:
    """An element that is not inline: its tag, attributes, parent, and the blocks directly in it."""

    __slots__ = ("attributes", "blocks", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element] = []
        self.blocks: list[Block] = []
        if parent is not None:
            parent.children.append(self)

    def attribute(self, name: str) -> str:
        """The value of an attribute, entities decoded; '' if absent."""
        for key, a, b, c in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return ""


class Block:
    """A run of text between two tags that are not inline."""

    __slots__ = ("element", "link_chars", "text")

    def __init__(self, text: str, link_chars: int, element: Element):
        self.text, self.link_chars, self.element = text, link_chars, element


def parse(page: str) -> tuple[Element, list[Block]]:
    """The root element and all text blocks of a page in order; blank blocks are left out."""
    root = Element("html", "", None)
    now, blocks = root, []
    parts: list[str] = []
    link, in_link, at, size = 0, False, 0, len(page)

    def close_block() -> None:
        nonlocal link
        if parts:
            text = html.unescape("".join(parts))
            if text.strip():
                block = Block(text, link, now)
                now.blocks.append(block)
                blocks.append(block)
            parts.clear()
        link = 0

    while at < size:
        found = TOKEN.match(page, at)
        if found is None:
            at += 1
            continue
        at = found.end()
        text = found["text"]
        if text is not None:
            parts.append(text)
            if in_link:
                link += len(text.strip())
            continue
        tag = found["tag"]
        if tag is None:
            if found[0] == "<":
                parts.append("<")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not found["end"]
            elif tag == "br":
                parts.append(" ")
            continue
        close_block()
        in_link = False
        if found["end"]:
            open_ = now
            while open_ is not None and open_.tag != tag:
                if tag in ("p", "li", "dt", "dd") and open_.tag in ("ul", "ol", "dl", "table", "td", "body") and tag != open_.tag:
                    open_ = None
                    break
                open_ = open_.parent
            if open_ is not None and open_.parent is not None:
                now = open_.parent
            continue
        if tag in SILENT:
            if not found["rest"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>|<body\b" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, at)
                if end is None:
                    at = size if tag != "head" else at
                else:
                    at = end.end() if end[0][1] == "/" else end.start()
            continue
        if tag in ("html", "body") and now is not root:
            continue
        if tag == "html":
            continue
        if tag in BLOCKS and now.tag == "p" or tag in HEADINGS and now.tag in HEADINGS:
            now = now.parent
        if tag in ENDS:
            ended, shields = ENDS[tag]
            open_ = now
            while open_ is not None and open_.tag not in shields and open_.tag not in ended:
                open_ = open_.parent
            while open_ is not None and open_.tag in ended and open_.parent is not None:
                now = open_.parent
                open_ = now if now.tag in ended else None
        if tag in VOID:
            continue
        now = Element(tag, found["rest"] or "", now)
    close_block()
    return root, blocks
