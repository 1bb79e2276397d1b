"""From fetched pages to clean Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import clean_markdown

#: Names of site builders in the order in which they are tried.
FRAMEWORKS = ("mintlify", "docusaurus", "mkdocs", "sphinx")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("script", "style", "noscript"))
BLOCK = frozenset("address article aside blockquote body dd details div dl dt figcaption figure footer form header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


def detect_framework(page: Column) -> Column:
    """The site builder whose name the page holds anywhere, in any case; 'generic' if none. Null stays null."""
    low = F.lower(page)
    found = F.lit("generic")
    for name in reversed(FRAMEWORKS):
        found = F.when(low.contains(name), F.lit(name)).otherwise(found)
    return F.when(page.isNotNull(), found)


class _Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str | None], parent: _Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


class _Tree(HTMLParser):
    """A plain tree: elements close at their own end tags or their ancestors'."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, dict(attrs), self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.now.children.append(_Node(tag, dict(attrs), self.now))

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def _parsed(page: str) -> _Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def _first(root: _Node, wanted) -> _Node | None:
    stack = [root]
    while stack:
        node = stack.pop()
        if wanted(node):
            return node
        stack.extend(c for c in reversed(node.children) if isinstance(c, _Node) and c.tag not in DROPPED)
    return None


def main_node(root: _Node) -> _Node:
    """The first ``main``, else the first ``article``, else the first role ``main``, else all of the page."""
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attributes.get("role") == "main")
    return next((n for t in tests if (n := _first(root, t)) is not None), root)


def _inline(text: str) -> str:
    return re.sub(r"[ \t\r\n\f]+", " ", text)


def _markdown(node: _Node | str, depth: int = 0, ordered: int = 0, raw: bool = False) -> str:
    if isinstance(node, str):
        return node if raw else _inline(node)
    tag = node.tag
    if tag in DROPPED:
        return ""
    if tag in ("ul", "ol"):
        lines, number = [], 0
        for child in node.children:
            if isinstance(child, str) and not child.strip():
                continue
            number += 1
            body = _markdown(child, depth + 1).strip()
            mark = f"{number}. " if tag == "ol" else "* "
            lines.append("  " * depth + mark + body)
        return "\n\n" + "\n".join(lines) + "\n\n" if depth == 0 else "\n" + "\n".join(lines)
    if tag == "pre":
        code = "".join(_markdown(c, raw=True) for c in node.children).strip("\n")
        return f"\n\n```\n{code}\n```\n\n"
    if tag == "table":
        return _table(node)
    inner = "".join(_markdown(c, depth, ordered, raw) for c in node.children)
    if raw:
        return "\n" if tag == "br" else inner
    if re.fullmatch(r"h[1-6]", tag):
        title = inner.strip()
        return f"\n\n{'#' * int(tag[1])} {title}\n\n" if title else ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("b", "strong", "em", "i", "code", "del"):
        mark = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "del": "~~"}[tag]
        text = inner.strip()
        left = " " if inner[:1] == " " else ""
        right = " " if inner[-1:] == " " else ""
        return f"{left}{mark}{text}{mark}{right}" if text else inner
    if tag == "a":
        href, text = node.attributes.get("href"), inner.strip()
        return f"[{text}]({href})" if href and text else inner
    if tag == "img":
        return f"![{node.attributes.get('alt') or ''}]({node.attributes.get('src') or ''})"
    if tag == "blockquote":
        body = re.sub(r"\n{3,}", "\n\n", inner.strip())
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in body.split("\n")) + "\n\n" if body else ""
    if tag in BLOCK:
        return f"\n\n{inner.strip()}\n\n" if inner.strip() else ""
    return inner


def _table(node: _Node) -> str:
    rows, stack = [], [node]
    while stack:
        at = stack.pop()
        if at.tag == "tr":
            cells = [c for c in at.children if isinstance(c, _Node) and c.tag in ("td", "th")]
            rows.append([re.sub(r"\s+", " ", _markdown(c).strip()).replace("|", "\\|") for c in cells])
            continue
        stack.extend(c for c in reversed(at.children) if isinstance(c, _Node))
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"


def html_to_markdown(page: str, main_only: bool = True) -> str:
    """A page as Markdown: ATX headings, paragraphs, lists, links, emphasis, code, quotations and tables."""
    root = _parsed(page)
    node = main_node(root) if main_only else root
    try:
        return _markdown(node)
    except RecursionError:  # thousands of nested elements: the text without marks
        parts, stack = [], [node]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at.tag not in DROPPED:
                stack.extend(reversed(at.children))
        return "".join(parts)


@F.pandas_udf(T.StringType())
def _to_markdown(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else html_to_markdown(p))


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    def text(node: _Node) -> str:
        parts: list[str] = []
        stack: list[_Node | str] = [node]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                parts.append(at)
            elif at.tag not in DROPPED:
                stack.extend(reversed(at.children))
        return "".join(parts)

    return pages.map(lambda p: None if p is None else text(main_node(_parsed(p))))


def main_text(page: Column) -> Column:
    """The text of the main part of a page; null stays null."""
    return _main_text(page)


def ingest(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages with ``framework`` and clean ``markdown`` of their main part; a null page has null for both."""
    markdown = clean_markdown(_to_markdown(F.col(html_col)))
    return pages.withColumn("framework", detect_framework(F.col(html_col))).withColumn("markdown", markdown)
