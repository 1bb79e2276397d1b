"""The main body of a web page, without all that surrounds or interrupts it.

Method: consensus host paths. Each page's containers are scored by the running
text that stands in them directly, that is, in paragraphs, headings, lists,
code, tables, quotations and definitions reached without passing another
container. Each page votes for its best container by a generalised path of tags
and classes; votes are counted for each host, and for all hosts together where
a host has too few. Of a page's containers on winning paths the one whose path
has the most votes is the body, and only among equals the page's own score
counts. Then each page is extracted again, from that container; pages without
one have no main body.

What interrupts a body (banners, share bars, link boxes) stands in containers of
its own and so is no part of the body's direct content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.htmltree import HEADINGS, Block, Element, parse
from docloom.functions.urls import host
from docloom.plans.shared import Scratch

FLOW = frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption i u s small sub sup q cite abbr var samp mark del ins".split()) | HEADINGS
RICH = frozenset("pre dl table blockquote".split())
NOT_ALNUM = re.compile(r"[\W_]+")
HASHED = re.compile(r"(?<=[-_])[0-9a-f]{4,}$|\d{2,}$")
PATH_STEPS = 3
#: A container votes if it has at least so many words of running text, or a heading with text below it.
VOTE_WORDS = 12
MIN_HOST_VOTES = 5
#: Trust in a path is compared in steps of a tenth: smaller differences are chance.
STEPS = 1
#: A host with more than one in HOT_SHARE of all containers is hot (there are fewer than HOT_SHARE of them), and its
#: containers meet its paths in as many places as keep about HOT_BLOCK of them in each. Paths are spread over PATH_SALTS places.
HOT_SHARE, HOT_BLOCK, PATH_SALTS = 1000, 100_000, 16


def block_key(text: str) -> str:
    """16 hex digits of the MD5 of a block's letters and digits in lower case; '' if it has none."""
    bare = NOT_ALNUM.sub("", text.lower())
    return hashlib.md5(bare.encode("utf-8", "surrogatepass")).hexdigest()[:16] if bare else ""


def step(element: Element) -> str:
    """A container in a path: its tag, and its id, class or role without numbers and hashes."""
    name = element.attribute("class") or element.attribute("id") or element.attribute("role")
    names = " ".join(sorted(HASHED.sub("#", n) for n in name.lower().split()))
    return f"{element.tag}.{names}" if names else element.tag


def path_of(element: Element) -> str:
    steps: list[str] = []
    while element is not None and len(steps) < PATH_STEPS:
        if is_container(element):
            steps.append(step(element))
        element = element.parent
    return ">".join(reversed(steps))


def _plain_words(block: Block) -> int:
    """Words of a block that stand in no link."""
    total = len(block.text.strip())
    return round(len(block.text.split()) * max(0, total - block.link_chars) / total) if total else 0


def is_paragraph(element: Element) -> bool:
    """Whether a div only wraps a paragraph: running text, no further elements."""
    return element.tag == "div" and not element.children and sum(map(_plain_words, element.blocks)) >= 5


def is_container(element: Element) -> bool:
    if element.tag in ("td", "th"):
        return any(c.tag not in FLOW or c.tag in HEADINGS for c in element.children)
    if element.tag in ("table", "tbody", "thead", "tr"):
        return False
    return element.tag not in FLOW and not is_paragraph(element)


def direct_blocks(container: Element) -> list[Block]:
    """The blocks of a container that are reached without passing another container, in order of elements."""
    out, stack = [], [container]
    while stack:
        element = stack.pop()
        if element is container and element.tag not in FLOW:
            pass  # bare text of a container is no paragraph of the page
        else:
            out.extend(element.blocks)
        stack.extend(c for c in reversed(element.children) if not is_container(c))
    return out


def _table_of(element: Element) -> Element | None:
    while element is not None and element.tag in ("td", "th", "tr", "tbody", "thead"):
        element = element.parent
    return element


def score(blocks: list[Block]) -> tuple[float, int, bool]:
    """(score, words of running text, whether it has a heading or rich element) of a container's direct blocks."""
    words, extra, rich = 0, 0, False
    for block in blocks:
        words += _plain_words(block)
        tags = set()
        element = block.element
        while element is not None and element.tag in FLOW:
            tags.add(element.tag)
            element = element.parent
        if tags & HEADINGS:
            extra, rich = extra + 10, True
        elif tags & RICH:
            extra, rich = extra + 5, True
    return float(words + extra), words, rich


def _containers(page: str) -> Iterator[tuple[Element, list[Block]]]:
    """The containers of a page with direct text, in order."""
    root, _ = parse(page)
    stack = [root]
    while stack:
        element = stack.pop()
        stack.extend(reversed(element.children))
        if is_container(element):
            blocks = direct_blocks(element)
            if any(NOT_ALNUM.sub("", b.text) for b in blocks):
                yield element, blocks


def containers(page: str) -> list[tuple[str, float, bool, list[str]]]:
    """(path, score, whether it may vote, block keys) of each container with direct text."""
    out = []
    for element, blocks in _containers(page):
        keys = list(dict.fromkeys(k for k in (block_key(b.text) for b in blocks) if k))
        points, words, rich = score(blocks)
        out.append((path_of(element), points, rich or words >= VOTE_WORDS, keys))
    return out


def _tags(element: Element | None) -> list[str]:
    tags = []
    while element is not None and element.tag in FLOW:
        tags.append(element.tag)
        element = element.parent
    return tags


def markdown_of(blocks: list[Block]) -> str:
    """Blocks as Markdown: headings, list items, code, quotations and plain paragraphs, in order."""
    out = []
    for block in blocks:
        tags = _tags(block.element)
        if "pre" in tags:
            out.append("```\n" + block.text.strip("\n") + "\n```")
            continue
        text = " ".join(block.text.split())
        heading = next((t for t in tags if t in HEADINGS), None)
        if not text:
            continue
        if heading:
            out.append("#" * int(heading[1]) + " " + text)
        elif "li" in tags:
            out.append("  " * (sum(t in ("ul", "ol") for t in tags) - 1) + "* " + text)
        else:
            out.append(("> " if "blockquote" in tags else "") + text)
    return "\n\n".join(out)


SCHEMA = "raw_id bigint, host string, no int, path string, score double, votes boolean, best boolean, keys array<string>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for id_, host_, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = containers(page)
            top = max((f[1] for f in found), default=0.0)
            for no, (path, points, votes, keys) in enumerate(found):
                for col, value in zip(cols, (id_, host_, no, path, points, votes, votes and points == top, keys), strict=True):
                    col.append(value)
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
        names = ["raw_id", "host", "no", "path", "score", "votes", "best", "keys"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def winning_paths(candidates: DataFrame) -> DataFrame:
    """(host, path, trust): paths for which at least half of their pages vote, by host.

    ``trust`` is the share of a path's pages that vote for it. Hosts with fewer
    than ``MIN_HOST_VOTES`` pages on a path take the share over all hosts.
    """
    at_host = candidates.groupBy("host", "path").agg(
        F.count_if("best").alias("wins"), F.count(F.lit(1)).alias("pages")
    )
    overall = at_host.groupBy("path").agg((F.sum("wins") / F.sum("pages")).alias("all_share"))
    # A path that most hosts have is no single key of the join.
    place = F.pmod(F.xxhash64("host"), F.lit(PATH_SALTS)).cast("int")
    spread = overall.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PATH_SALTS - 1))))
    own = F.col("wins") / F.col("pages")
    trust = F.when(F.col("pages") >= MIN_HOST_VOTES, own).otherwise((own * F.col("pages") + F.col("all_share") * MIN_HOST_VOTES) / (F.col("pages") + MIN_HOST_VOTES))
    return at_host.withColumn("salt", place).join(spread, ["path", "salt"]).select("host", "path", trust.alias("trust")).where("trust >= 0.5")


def _usable(pages: DataFrame, id_col: str, url_col: str, html_col: str, status_col: str) -> DataFrame:
    rows = pages.where((F.col(status_col) == 200) & F.col(html_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("raw_id"), F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))


def _chosen(usable: DataFrame, scratch: Scratch) -> DataFrame:
    """(raw_id, no, keys): the container of each page that the votes choose."""
    found = scratch.write(usable.mapInArrow(_candidates, SCHEMA), "candidates")
    winners = scratch.write(winning_paths(found.select("host", "path", "best")), "winners")
    sizes = scratch.write(found.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = sizes.where(F.col("n") * HOT_SHARE > total).select("host", F.ceil(F.col("n") / HOT_BLOCK).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = found.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.col("raw_id"), salts).cast("int")).drop("salts")
    right = winners.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    on_path = left.join(right, ["host", "path", "salt"])
    # The votes rank; the page's own score decides among paths of equal trust.
    rank = F.struct(F.round("trust", STEPS).alias("t"), "score", "trust", "path", "no")
    return on_path.groupBy("raw_id").agg(F.max_by(F.struct("no", "keys"), rank).alias("c")).select("raw_id", "c.no", "c.keys")


def main_blocks(pages: DataFrame, id_col: str = "raw_id", url_col: str = "url", html_col: str = "html", status_col: str = "status_code") -> DataFrame:
    """(raw_id, position, block_key) of the distinct blocks of each page's main body.

    Only rows with status 200 and a page are read; null and empty pages and pages
    without a body have no rows. Pages without host form a host of their own.
    Columns other than the named ones are not read; an empty table gives an
    empty result.
    """
    scratch = Scratch(pages.sparkSession, "main-body")
    chosen = _chosen(_usable(pages, id_col, url_col, html_col, status_col), scratch)
    return scratch.result(chosen.select("raw_id", F.posexplode("keys").alias("position", "block_key")))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = []
        for page, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            blocks = None if wanted is None else next((b for i, (_, b) in enumerate(_containers(page)) if i == wanted), None)
            bodies.append(None if blocks is None else markdown_of(blocks))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["raw_id", "body"])


def main_bodies(pages: DataFrame, id_col: str = "raw_id", url_col: str = "url", html_col: str = "html", status_col: str = "status_code") -> DataFrame:
    """(raw_id, body): the main body of each page as Markdown, extracted again from the container that the votes choose.

    One row for each row with status 200 and a page, ids not null and unique;
    the body is null where no container of the page is on a winning path.
    """
    scratch = Scratch(pages.sparkSession, "main-body")
    usable = _usable(pages, id_col, url_col, html_col, status_col)
    chosen = scratch.write(_chosen(usable, scratch).select(F.col("raw_id").alias("id"), "no"), "chosen")
    scratch.keep("chosen")
    return usable.select("raw_id", "html").join(chosen, F.col("raw_id") == F.col("id"), "left").select("raw_id", "html", "no").mapInArrow(_texts, "raw_id bigint, body string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_blocks(spark.read.parquet(f"{sf_dir}/raw_documents.parquet")).select("raw_id", "block_key")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each fetched page as Markdown."""
    return main_bodies(spark.read.parquet(f"{sf_dir}/raw_documents.parquet"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
ORACLES: dict[str, str] = {}
