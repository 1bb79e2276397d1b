"""Exact cosine search over stored vectors with a bounded lexical rerank.

Up to ``FEW`` queries are sent to all tasks, which keep the best candidates of
each query in their own rows, and only those are shuffled. More queries are cut
into blocks, the corpus into parts, and each block meets each part in one task;
no query passes the driver. The number of blocks and parts follows from the
tables' sizes. For very many queries an index is cheaper: ``operators.index``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import lexical_forms, lexical_relevance_of, query_terms_column
from docloom.operators.embedding import Embedder, embed_column
from docloom.plans.topk import best, reaching

SIMILARITY_WEIGHT, LEXICAL_WEIGHT = 0.85, 0.15
#: So many queries at most are broadcast: of 1024 dimensions they are 8 MB.
FEW = 1024
#: Rows of a block of queries and of a part of the corpus that meet in one task, and how many queries are scored at once.
QUERY_BLOCK, CORPUS_PART, SLICE = 4096, 16384, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors in double precision; null if one is null, all zero or of another length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def unit_rows(vectors: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the vectors of ``size`` finite numbers that are not all zero."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    if not len(rows) or not size:
        return rows[:0], np.zeros((0, size))
    data = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    norms = np.linalg.norm(data, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return rows[good], data[good] / norms[good, None]


def scored(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, similarities) of the ``k`` best rows of ``data`` for each query; rounded to 12 digits, so that copies tie."""
    out: list[tuple] = [(query_ids[:0], ids[:0], np.zeros(0))]
    for start in range(0, len(matrix), SLICE):
        scores = np.clip(np.round(matrix[start : start + SLICE] @ data.T, 12), -1.0, 1.0)
        rows, columns = reaching(scores, k)
        values, names = scores[rows, columns], ids[columns]
        kept = best(rows, values, names, k)
        out.append((query_ids[start + rows[kept]], names[kept], values[kept]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def ids_of(column: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The ids of some rows, as integers or texts."""
    taken = column.take(pa.array(rows))
    return taken.to_numpy(zero_copy_only=False) if pa.types.is_integer(taken.type) else np.array(taken.to_pylist(), dtype=str)


def _few(corpus: DataFrame, kind: str, queries: list, k: int) -> DataFrame:
    """The ``k`` best of each task for queries on the driver: (query_id, id, similarity)."""
    by_size: dict[int, list] = {}
    for query_id, vector in queries:
        by_size.setdefault(len(vector), []).append((query_id, vector))
    ready = []
    for size, rows in by_size.items():
        kept, matrix = unit_rows(pa.array([r[1] for r in rows], pa.list_(pa.float32())), size)
        ready.append((size, np.array([r[0] for r in rows], dtype=np.int64)[kept], matrix))
    shared = corpus.sparkSession.sparkContext.broadcast(ready)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple | None] = [None] * len(shared.value)
        for batch in batches:
            for i, (size, query_ids, matrix) in enumerate(shared.value):
                rows, data = unit_rows(batch.column(1), size)
                found = scored(ids_of(batch.column(0), rows), data, query_ids, matrix, k)
                if held[i] is not None:
                    found = tuple(np.concatenate(pair) for pair in zip(held[i], found, strict=True))
                    kept = best(found[0], found[2], found[1], k)
                    found = tuple(f[kept] for f in found)
                held[i] = found
        for found in held:
            if found is not None:
                arrays = [pa.array(found[0], pa.int64()), pa.array(found[1].tolist(), pa.int64() if kind == "bigint" else pa.string()), pa.array(found[2])]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "id", "similarity"])

    return corpus.mapInArrow(work, f"query_id bigint, id {kind}, similarity double")


def _many(corpus: DataFrame, kind: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each meeting of a block of queries with a part of the corpus: (query_id, id, similarity)."""
    size = F.size("vector").alias("size")
    sizes = {r["size"]: (-(-r["n"] // CORPUS_PART), -(-r["m"] // QUERY_BLOCK)) for r in (
        corpus.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("m"))
        .unionByName(queries.groupBy(size).agg(F.lit(0).alias("n"), F.count(F.lit(1)).alias("m")))
        .groupBy("size").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 and m > 0").collect()
    )}

    def placed(rows: DataFrame, id_: str, parts: int, blocks: int, asks: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(id_), F.lit(blocks if asks else parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit((parts if asks else blocks) - 1)))
        return rows.withColumn("own", own).withColumn("other", every).select(
            F.col("own" if asks else "other").alias("block"), F.col("other" if asks else "own").alias("part"), F.col(id_).alias("id"), "vector"
        )

    def meet(theirs: pa.Table, mine: pa.Table) -> pa.Table:
        length = next((len(v) for v in mine.column("vector").to_pylist()[:1]), 0)
        query_rows, matrix = unit_rows(mine.column("vector"), length)
        rows, data = unit_rows(theirs.column("vector"), length)
        asked, ids, values = scored(ids_of(theirs.column("id"), rows), data, ids_of(mine.column("id"), query_rows).astype(np.int64), matrix, k)
        return pa.table({"query_id": pa.array(asked, pa.int64()), "id": pa.array(ids.tolist(), pa.int64() if kind == "bigint" else pa.string()), "similarity": pa.array(values, pa.float64())})

    found = []
    for length, (parts, blocks) in sorted(sizes.items()):
        theirs = placed(corpus.where(F.size("vector") == length), "id", parts, blocks, False)
        mine = placed(queries.where(F.size("vector") == length), "query_id", parts, blocks, True)
        pairs = theirs.groupBy("block", "part").cogroup(mine.groupBy("block", "part"))
        found.append(pairs.applyInArrow(meet, f"query_id bigint, id {kind}, similarity double"))
    return reduce(DataFrame.unionByName, found) if found else corpus.sparkSession.createDataFrame([], f"query_id bigint, id {kind}, similarity double")


def top_k(corpus: DataFrame, queries: DataFrame, k: int, few: int = FEW) -> DataFrame:
    """(query_id, id, similarity, rank) of the ``k`` corpus vectors nearest to each query by exact cosine.

    ``corpus``: id, vector; ``queries``: query_id, vector. Ties go to the smaller
    id; similarities stay within [-1, 1]. Vectors that are null, all zero, not
    finite or of another length than the query are never found, and such queries
    find nothing. Query ids are unique.
    """
    if k <= 0:
        raise ValueError("limit must be positive")
    kind = "bigint" if dict(corpus.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint") else "string"
    corpus = corpus.select(F.col("id").cast(kind).alias("id"), F.col("vector").cast("array<float>").alias("vector")).where("id is not null and vector is not null")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")).where("query_id is not null and vector is not null")
    first = asked.limit(few + 1).collect()
    hits = _few(corpus, kind, first, k) if len(first) <= few else _many(corpus, kind, asked, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_scores(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, id, lexical) of the distinct pairs of query text and chunk in ``hits`` (query, id).

    ``chunks``: id, content, source_url, page_title, header_path. The texts of a
    chunk are brought to their normal forms once, whatever the number of its hits.
    """
    pairs = hits.select("query", "id").distinct()
    heading = F.array_join(F.coalesce("header_path", F.array().cast("array<string>")), " ")
    forms = chunks.join(pairs.select("id").distinct(), "id", "left_semi").select("id", lexical_forms(heading, F.col("page_title"), F.col("content"), F.col("source_url")).alias("forms"))
    terms = pairs.select("query").distinct().select("query", query_terms_column(F.col("query")).alias("terms"))
    scored = pairs.join(forms, "id").join(terms, "query")
    return scored.select("query", "id", lexical_relevance_of(F.col("terms"), F.col("forms")).alias("lexical"))


def rerank(hits: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits ordered anew by similarity and lexical relevance: adds ``lexical``, ``score``, ``position``.

    ``hits``: query_id, query, id, similarity; ``chunks``: see ``lexical_scores``.
    Equal scores keep the order of similarity, then of ids. A null query text has no lexical relevance.
    """
    scored = hits.join(lexical_scores(hits.where("query is not null"), chunks), ["query", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    scored = scored.withColumn("score", SIMILARITY_WEIGHT * F.col("similarity") + LEXICAL_WEIGHT * F.col("lexical"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "id")
    ranked = scored.withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= limit) if limit is not None else ranked


def search(
    chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, version_id, limit: int = 5,
    hybrid: bool = True, candidate_multiplier: int = 8, index=None,
) -> DataFrame:
    """Hits (query_id, chunk_id, content, source_url, page_title, header_path, score, position) of each query.

    ``chunks`` are those that may be found, with ``id``; ``embeddings``: chunk_id,
    embedding_version_id, embedding; ``queries``: query_id, query, vector. The
    hybrid form reranks ``limit * candidate_multiplier`` nearest chunks. Texts
    are fetched for the hits that stay, after all ranking. With ``index`` (an
    ``operators.index.VectorIndex`` over chunk ids of that version) the nearest
    are those that it finds, else all vectors are compared.
    """
    if limit <= 0 or candidate_multiplier <= 0:
        raise ValueError("limit and candidate_multiplier must be positive")
    candidates = limit * candidate_multiplier if hybrid else limit
    if index is not None:
        near = index.top_k(queries, candidates, allowed=chunks.select("id"))
    else:
        corpus = embeddings.where(F.col("embedding_version_id") == version_id).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
        near = top_k(corpus.join(chunks.select("id"), "id", "left_semi"), queries, candidates)
    if hybrid:
        hits = rerank(near.join(queries.select(F.col("query_id").cast("bigint"), "query"), "query_id"), chunks, limit)
    else:
        hits = near.withColumn("score", F.col("similarity")).withColumn("position", F.col("rank"))
    texts = chunks.select("id", "content", "source_url", "page_title", "header_path")
    return hits.select("query_id", "id", "score", "position").join(texts, "id").select(
        "query_id", F.col("id").alias("chunk_id"), "content", "source_url", "page_title", "header_path", "score", "position"
    )


def with_vectors(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """Queries (query_id, query) with their vectors; a query is embedded like a text."""
    return queries.withColumn("vector", embed_column(embedder)("query"))
