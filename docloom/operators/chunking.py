"""Documents to chunks with content-addressed ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import ChunkingConfig
from docloom.functions.chunker import chunk_markdown, heading_sections
from docloom.functions.identity import chunk_id, sha256

PIECES = "package string, version string, source_url string, page_title string, document bigint, header_path array<string>, content string, chunk_index int"


def _pieces(batches: Iterator[pa.RecordBatch], config: ChunkingConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, paths, contents, indexes = [], [], [], []
        for row, text in enumerate(batch.column(5).to_pylist()):
            for i, (path, content) in enumerate(chunk_markdown(text, config.max_characters, config.overlap_characters, config.levels)):
                rows.append(row)
                paths.append(list(path))
                contents.append(content)
                indexes.append(i)
        kept = batch.take(pa.array(rows, pa.int64()))
        columns = [*kept.columns[:5], pa.array(paths, pa.list_(pa.string())), pa.array(contents, pa.string()), pa.array(indexes, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["package", "version", "source_url", "page_title", "document", "header_path", "content", "chunk_index"])


def document_sections(documents: DataFrame, id_col: str, text_col: str, config: ChunkingConfig | None = None) -> DataFrame:
    """(id, section_no, header_path, content): the sections of Markdown texts that are not blank, numbered from 0 in each text.

    Rows with a null id or text have none.
    """
    levels = (config or ChunkingConfig()).levels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(i, n, list(path), content) for i, text in texts for n, (path, content) in enumerate(heading_sections(text, levels))]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [id_col, "section_no", "header_path", "content"])

    slim = documents.select(id_col, text_col).dropna()
    return slim.mapInArrow(work, f"`{id_col}` {dict(documents.dtypes)[id_col]}, section_no int, header_path array<string>, content string")


def chunk_documents(documents: DataFrame, config: ChunkingConfig | None = None, order_col: str | None = None) -> DataFrame:
    """Chunks (``schemas.CHUNK``) of documents (package, version, url, title, markdown).

    The text is cut in Python, in one Arrow pass; hashes and ids are columns. A
    null title counts as empty; documents with a null package, version, url or
    markdown, and blank ones, have no chunks. The same chunk id of several
    documents comes once, from the first by ``order_col`` (default: any).
    """
    config = config or ChunkingConfig()
    order = F.col(order_col).cast("bigint") if order_col else F.lit(0).cast("bigint")
    slim = documents.select(
        "package", "version", F.col("url").alias("source_url"), F.coalesce("title", F.lit("")).alias("page_title"), order.alias("document"), "markdown"
    ).dropna(subset=["package", "version", "source_url", "markdown"])
    pieces = slim.mapInArrow(lambda b: _pieces(b, config), PIECES)
    hashed = pieces.withColumn("content_hash", sha256(F.col("content"))).withColumn("character_count", F.length("content"))
    keyed = hashed.withColumn(
        "id", chunk_id(*[F.col(c) for c in ("package", "version", "source_url", "header_path", "chunk_index", "content_hash")])
    )
    return first_of_each(keyed, "id", "document").select("id", "content", "package", "version", "source_url", "page_title", "header_path", "chunk_index", "content_hash", "character_count")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows without those whose key an earlier row (by ``order``) has; a null key is a key of its own."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return first.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def rebuild_documents(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Documents (package, version, url, title, markdown, metadata) from their chunks.

    Contents are joined by blank lines in the order of chunk_index, then of the
    content; the title is the first chunk's. Null contents are skipped.
    """
    part = F.struct(F.col("chunk_index").alias("i"), F.col(content).alias("text"), F.col("page_title").alias("title"))
    grouped = chunks.groupBy("package", "version", "source_url").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(
        "package",
        "version",
        F.col("source_url").alias("url"),
        F.get("parts", F.lit(0))["title"].alias("title"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("markdown"),
        F.create_map(F.lit("reconstructed_from"), F.lit("chunks_jsonl")).alias("metadata"),
    )


def require_identity(chunks: DataFrame, package: str, version: str) -> DataFrame:
    """The chunks; ValueError if one names another package or version, compared as written."""
    other = chunks.where(~(F.col("package").eqNullSafe(package) & F.col("version").eqNullSafe(version)))
    if other.limit(1).count():
        raise ValueError("all chunks must match the requested package and version")
    return chunks
