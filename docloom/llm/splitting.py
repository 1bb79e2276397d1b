"""Splitting oversized items at natural boundaries.

Method: offsets of the units (characters, or tokens of a public tokenizer) are
prefix sums; the offsets of all natural boundaries form one sorted array for each
kind of boundary. A piece ends at the last boundary within the limit, found by
binary search: in the second half of the window the strongest kind first, else
the last one of any kind behind the overlap. Only where there is none either is
the piece cut hard at the limit. The next piece begins the overlap before that
end. Within fenced code only line ends, and after them blanks, are boundaries,
weaker than any outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.markdown import code_lines, sections
from docloom.llm.tokens import VOCABULARY, token_bytes, tokenizer

LIMIT, OVERLAP = 4000, 400
TOKENS, TOKEN_OVERLAP = 1024, 100
#: Kinds of boundaries outside code, the strongest first; a piece may end behind each match.
BOUNDARIES = [re.compile(r"\n[ \t]*\n+"), re.compile(r"\n"), re.compile(r"[.!?;:。！？][\"')\]]*\s|[。！？]"), re.compile(r"\s")]
#: Kinds within fenced code, as indexes of ``BOUNDARIES``.
IN_CODE = (1, 3)


def _behind(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets of each kind of boundary, the strongest kind first: those outside fenced code, then those within."""
    kinds = [_behind(p, text) for p in BOUNDARIES]
    if "```" not in text and "~~~" not in text:
        return kinds
    lines = text.split("\n")
    inside = np.array(code_lines(lines))
    starts = np.concatenate(([0], np.cumsum([len(line) + 1 for line in lines])))[: len(lines)]
    # A boundary belongs to the line in which its last character stands; the end of a fence's last line is outside.
    last = np.concatenate((inside[1:], [False]))
    coded = [inside[at] & (last[at] | (kind < starts[at] + np.array([len(lines[i]) for i in at], dtype=np.int64) + 1)) if len(kind) else np.zeros(0, bool)
             for kind in kinds for at in [np.searchsorted(starts, kind - 1, side="right") - 1]]
    return [kind[~code] for kind, code in zip(kinds, coded, strict=True)] + [kinds[i][coded[i]] for i in IN_CODE]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) offsets of the pieces of a text; they cover it and overlap by ``overlap``.

    ``sizes`` gives the size of each character (default 1 each), so that limits
    can be in tokens. A text within the limit is one piece; an empty one none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    if not text:
        return []
    sums = np.arange(len(text) + 1) if sizes is None else np.concatenate(([0], np.cumsum(sizes)))
    kinds = boundaries(text) if sums[-1] > limit else []
    out, start = [], 0
    while True:
        # The farthest end within the limit, at least one character on.
        far = max(start + 1, int(np.searchsorted(sums, sums[start] + limit, side="right")) - 1)
        if far >= len(text):
            out.append((start, len(text)))
            return out
        floor = max(start + 1, int(np.searchsorted(sums, sums[start] + max(limit // 2, overlap + 1), side="left")))
        for ends in kinds:
            i = int(np.searchsorted(ends, far, side="right")) - 1
            if i >= 0 and ends[i] >= floor:
                end = int(ends[i])
                break
        else:
            # Behind the overlap, so that the next piece begins farther on.
            low = int(np.searchsorted(sums, sums[start] + overlap + 1, side="left"))
            last = max((int(ends[i - 1]) for ends in kinds if (i := int(np.searchsorted(ends, far, side="right")))), default=0)
            end = last if last >= max(start + 1, low) else far
        out.append((start, end))
        start = max(start + 1, int(np.searchsorted(sums, sums[end] - overlap, side="left")))


def trimmed(text: str) -> str:
    """A text as its size is counted: CRLF as one character, no outer white space."""
    return text.replace("\r\n", "\n").strip()


def token_sizes(text: str, path: str) -> np.ndarray:
    """How many tokens begin at each character of a text."""
    encoding, sizes = tokenizer(path), token_bytes(path)
    begins = np.concatenate(([0], np.cumsum(sizes[encoding.encode_ordinary(text)])))[:-1]
    # The character in which a token's first byte stands.
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    owner = np.cumsum((data & 0xC0) != 0x80) - 1
    return np.bincount(owner[np.minimum(begins, len(data) - 1)], minlength=len(text))


def cut_tokens(text: str, limit: int, overlap: int, path: str) -> list[tuple[int, int]]:
    """``cut`` with sizes in tokens: each piece, encoded on its own, has at most ``limit`` tokens.

    A piece encoded alone may have a token or two more than stand in it within
    the whole; then all are cut again with as much less room.
    """
    sizes, room = token_sizes(text, path), limit
    while True:
        pieces = cut(text, room, min(overlap, room - 1), sizes)
        over = max((len(tokenizer(path).encode_ordinary(text[a:b])) for a, b in pieces), default=0) - limit
        if over <= 0 or room == 1:
            return pieces
        room = max(1, room - over)


def _items(batches: Iterator[pa.RecordBatch], whole: bool, limit: int, overlap: int, path: str | None) -> Iterator[pa.RecordBatch]:
    """From (id, text, header path) batches the pieces of oversized sections."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("item_id", "section_no", "piece_no", "start", "end", "header_path", "content")}
        for id_, text, given in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            normal = text.replace("\r\n", "\n")
            parts = [(0, len(normal), tuple(given or ()))] if whole else sections(normal)
            for number, (begin, finish, header) in enumerate(parts):
                content = normal[begin:finish].strip()
                # A text has no more tokens than bytes, and few texts have as many.
                if path is None and len(content) <= limit or path is not None and len(content.encode("utf-8", "surrogatepass")) <= limit:
                    continue
                if path is not None and len(tokenizer(path).encode_ordinary(content)) <= limit:
                    continue
                pieces = cut(content, limit, overlap) if path is None else cut_tokens(content, limit, overlap, path)
                for piece, (start, end) in enumerate(pieces):
                    for key, value in zip(rows, (id_, number, piece, start, end, list(header), content[start:end]), strict=True):
                        rows[key].append(value)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))


SCHEMA = "item_id bigint, section_no int, piece_no int, start int, end int, header_path array<string>, content string"


def oversized(
    items: DataFrame, id_col: str, text_col: str, header_col: str | None = None,
    limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of items longer than ``limit``: ``SCHEMA``.

    With ``header_col`` an item is one section, 0, with that header path;
    without, it is Markdown and cut into its sections first, numbered from 0.
    Limit and overlap count characters, or with ``vocabulary`` (a rank file)
    tokens of that tokenizer. Texts are taken with CRLF as LF and without outer
    white space, and offsets are characters of that. Null ids and null or short
    texts give nothing; they are dropped before any Python runs. Every piece is
    at most ``limit`` long; consecutive pieces share exactly ``overlap``
    characters, or at least as many characters as ``overlap`` tokens begin in.
    """
    header = F.col(header_col) if header_col else F.lit(None).cast("array<string>")
    slim = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), header.alias("header"))
    size = F.length("text") if vocabulary is None else F.octet_length("text")
    slim = slim.where(F.col("id").isNotNull() & (size > limit))
    return slim.mapInArrow(lambda b: _items(b, header_col is not None, limit, overlap, vocabulary), SCHEMA)


def _both(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/clean_documents.parquet")
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    a = oversized(pages, "page_id", "markdown", **options)
    b = oversized(chunks, "load_seq", "content", "header_path", **options)
    return a.withColumn("item_table", F.lit("clean_documents")).unionByName(b.withColumn("item_table", F.lit("chunks")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).where("piece_no = 0").select("item_table", "item_id", "section_no")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).select(
        "item_table", "item_id", "section_no", "piece_no", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "header_path", "content"
    )


def p6_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items cut into pieces of at most 1,024 tokens that overlap by 100 tokens."""
    return _both(spark, sf_dir, limit=TOKENS, overlap=TOKEN_OVERLAP, vocabulary=VOCABULARY).select(
        "item_table", "item_id", "section_no", "piece_no", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), "header_path", "content"
    )


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_token_pieces": p6_token_pieces}

#: Lines of texts ({0}: a query for id and text) with the state of fenced code before each: its marker or ''.
FENCED_LINES = r"""
src AS ({0}),
split AS (SELECT id, string_split(text, chr(10)) AS ls FROM src),
marks AS (SELECT id, i AS no, l, regexp_extract(l, '^[ \t]*(`{{3,}}|~{{3,}})([^\n]*)', ['m', 'rest'], 's') AS f FROM (SELECT id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM split)),
fences AS (SELECT id, no, f.m AS m, trim(f.rest, E' \t\r\f\v') AS rest, row_number() OVER (PARTITION BY id ORDER BY no) AS k FROM marks WHERE f.m <> ''),
walk AS (
  SELECT id, 1::BIGINT AS k, m AS open FROM fences WHERE k = 1
  UNION ALL
  SELECT f.id, f.k, CASE WHEN w.open = '' THEN f.m WHEN f.m[1] = w.open[1] AND length(f.m) >= length(w.open) AND f.rest = '' THEN '' ELSE w.open END
  FROM walk w JOIN fences f ON f.id = w.id AND f.k = w.k + 1),
state AS (SELECT f.id, f.no, w.open, lag(w.open, 1, '') OVER (PARTITION BY f.id ORDER BY f.no) AS before FROM fences f JOIN walk w USING (id, k)),
fenced_lines AS (
  SELECT m.id, m.no, m.l, CASE WHEN m.f.m <> '' THEN s.before <> '' OR s.open <> '' ELSE coalesce(s.open, '') <> '' END AS code
  FROM marks m ASOF LEFT JOIN state s ON m.id = s.id AND m.no >= s.no)"""

ORACLES = {
    "p6_found": "WITH RECURSIVE " + FENCED_LINES.format("SELECT page_id AS id, replace(markdown, chr(13) || chr(10), chr(10)) AS text FROM clean_documents WHERE length(markdown) > 4000") + r""",
heads AS (SELECT *, NOT code AND regexp_matches(l, '^#{1,4}[ \t]') AS head FROM fenced_lines),
secs AS (SELECT id, no, l, sum(head::INT) OVER (PARTITION BY id ORDER BY no) AS n FROM heads),
texts AS (SELECT id, n, string_agg(l, chr(10) ORDER BY no) AS t FROM secs GROUP BY 1, 2),
trimmed AS (SELECT id, n, regexp_replace(t, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS t FROM texts),
kept AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS no FROM trimmed WHERE n > 0 OR t <> '')
SELECT 'clean_documents' AS item_table, id AS item_id, no::INT AS section_no FROM kept WHERE length(t) > 4000
UNION ALL SELECT 'chunks', load_seq, 0 FROM (SELECT load_seq, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '^[\s\x{0b}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{0b}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g') AS t FROM chunks) WHERE length(t) > 4000""",
}
