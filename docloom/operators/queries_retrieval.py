"""Registered queries of embeddings, search, evaluation and lineage, and their SQL.

The chunks table serves as the store: its chunk ids, packages and texts. The
query vectors are stored vectors themselves.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import EmbeddingConfig
from docloom.operators import chunking, embedding, evaluation, lineage, search, snapshot
from docloom.operators.index import VectorIndex
from docloom.plans.shared import Scratch
from docloom.schemas import upgrade

QUERY_TEXT = "restore the SessionCrawler registry"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """(id, dimension) of the embedding versions, a table of fixed size."""
    return [tuple(r) for r in _t(spark, sf_dir, "embedding_versions").select("embedding_version_id", "dimension").orderBy("embedding_version_id").collect()]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors of all embedding versions."""
    dims = _t(spark, sf_dir, "embedding_versions").select("embedding_version_id", "dimension")
    rows = _t(spark, sf_dir, "chunk_embeddings").join(F.broadcast(dims), "embedding_version_id").where("embedding is not null and size(embedding) = dimension")
    return rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


def _each_version(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    """``run`` (version, its vectors) for each version, united, with ``embedding_version_id``."""
    vectors = _vectors(spark, sf_dir)
    parts = [run(v, vectors.where(F.col("embedding_version_id") == v)).withColumn("embedding_version_id", F.lit(v)) for v, _ in _versions(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 vectors nearest to the first one of each embedding version, by distance and id."""

    def run(_: int, vectors: DataFrame) -> DataFrame:
        first = vectors.orderBy("vec_id").limit(1).select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))
        return search.top_k(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), first, 10)

    near = _each_version(spark, sf_dir, run)
    return near.select("embedding_version_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def vector_topk_batch(spark: SparkSession, sf_dir: str, few: int = search.FEW) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 20, within its embedding version."""

    def run(_: int, vectors: DataFrame) -> DataFrame:
        queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        return search.top_k(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, 5, few)

    return _each_version(spark, sf_dir, run).select("embedding_version_id", "query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def vector_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_topk_batch`` by blocks of queries that meet parts of the corpus, as more queries than ``search.FEW`` do."""
    return vector_topk_batch(spark, sf_dir, few=0)


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored index of each embedding version finds at least 0.9 of the 5 nearest of the queries of ``vector_topk_batch``."""
    vectors, exact = _vectors(spark, sf_dir), vector_topk_batch(spark, sf_dir)
    exact = Scratch(spark, "recall").write(exact.select(F.col("query_id").alias("q"), F.col("vec_id").alias("v"), F.col("embedding_version_id").alias("version")), "exact")
    parts = []
    for version, dimension in _versions(spark, sf_dir):
        own = vectors.where(F.col("embedding_version_id") == version)
        built = VectorIndex.build(own.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), f"{Scratch(spark, 'index').root}/index", dimension)
        queries = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        found = built.top_k(queries, 5).select(F.col("query_id").alias("fq"), F.col("id").alias("fv"))
        joined = exact.where(F.col("version") == version).join(found, (F.col("q") == F.col("fq")) & (F.col("v") == F.col("fv")), "left")
        parts.append(joined.groupBy("version").agg(F.count_distinct("q").alias("queries"), (F.count("fv") >= 0.9 * F.count(F.lit(1))).alias("good")))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("version", "embedding_version_id")


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(QUERY_TEXT).alias("query"), F.col("embedding").alias("vector"))


def _hits(spark: SparkSession, sf_dir: str, hybrid: bool) -> DataFrame:
    chunks = _t(spark, sf_dir, "chunks").where("content is not null")
    columns = ("content", "source_url", "page_title", "header_path")
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*columns), "load_seq").alias("c")).select(F.col("chunk_id").alias("id"), "c.*")
    # Read for each version by the search, the rerank and the hits' texts.
    first = Scratch(spark, "search").write(first, "chunks")

    def run(version: int, vectors: DataFrame) -> DataFrame:
        one = vectors.groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
        rows = one.select("chunk_id", F.lit(version).alias("embedding_version_id"), "embedding")
        return search.search(first, rows, _queries(vectors), version, limit=5, hybrid=hybrid)

    return _each_version(spark, sf_dir, run)


def _cases(spark: SparkSession, sf_dir: str, *expected: str) -> DataFrame:
    """The evaluation cases: every query, whether it has hits or not."""
    return _queries(_vectors(spark, sf_dir)).select("query_id", "query", F.array(*[F.lit(e) for e in expected]).alias("expected_any"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine search of many query vectors among chunks, reranked by one query text."""
    return _hits(spark, sf_dir, True).select("embedding_version_id", "query_id", "chunk_id", F.round("score", 6).alias("score"), "position")


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical relevance of every chunk to one query."""
    from docloom.functions.text import lexical_relevance, query_terms

    chunks = _t(spark, sf_dir, "chunks")
    terms = F.array(*[F.lit(t) for t in query_terms(QUERY_TEXT)])
    heading = F.array_join(F.coalesce("header_path", F.array().cast("array<string>")), " ")
    score = lexical_relevance(terms, heading, F.col("page_title"), F.col("content"), F.col("source_url"))
    return chunks.select("load_seq", F.round(score, 6).alias("relevance"))


def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and mean reciprocal rank of plain search: relevant are chunks that name a session."""
    scored = evaluation.evaluate(evaluation.relevant_ranks(_cases(spark, sf_dir, "session_crawler", "Session"), _hits(spark, sf_dir, False)))
    return scored.select("query_count", "hits_at_k", F.round("hit_rate_at_k", 6).alias("hit_rate_at_k"), F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"), F.to_json("ranks").alias("ranks"))


def evaluation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the same cases without and with the lexical rerank."""

    def run(hybrid: bool) -> DataFrame:
        return evaluation.relevant_ranks(_cases(spark, sf_dir, "Session"), _hits(spark, sf_dir, hybrid))

    return evaluation.compare(run(False), run(True))


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids without a vector of the first embedding version."""
    chunks = _t(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id")).distinct()
    absent = embedding.missing_embeddings(chunks, _t(spark, sf_dir, "chunk_embeddings"), 1)
    return absent.select(F.col("id").alias("chunk_id"))


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all chunk ids each embedding identity covers."""
    chunks = _t(spark, sf_dir, "chunks").select("chunk_id").distinct()
    have = _t(spark, sf_dir, "chunk_embeddings").select("chunk_id", "embedding_version_id").distinct()
    covered = have.join(chunks, "chunk_id", "left_semi").groupBy("embedding_version_id").agg(F.count(F.lit(1)).alias("covered"))
    versions = _t(spark, sf_dir, "embedding_versions").select("embedding_version_id", "provider", "model_name", "dimension")
    return versions.join(covered, "embedding_version_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new embeddings, metrics) of the hashing embedder over chunks of current pages; vectors of version 1 are taken for its own."""
    config = EmbeddingConfig("local", "hashing", 384)
    own = F.when(F.col("embedding_version_id") == 1, embedding.embedding_version_id(config)).otherwise(F.col("embedding_version_id").cast("string"))
    have = _t(spark, sf_dir, "chunk_embeddings").select("chunk_id", own.alias("embedding_version_id"))
    pages = _t(spark, sf_dir, "clean_documents").select(F.col("page_id").alias("id"), (F.col("page_id") % 10 != 0).alias("is_current"))
    chunks = _t(spark, sf_dir, "chunks").where("content is not null").select(F.col("chunk_id").alias("id"), F.col("page_id").alias("source_document_id"), "content", "load_seq")
    return embedding.index_chunks(chunking.first_of_each(chunks, "id", "load_seq"), pages, have, config, embedding.HashingEmbedder(384))


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors for the chunks of current pages without one: their number of dimensions and length."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return _index(spark, sf_dir)[0].select("chunk_id", F.size("embedding").alias("dimension"), F.round(squares, 3).alias("squared_length"))


def index_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of current pages would be embedded, and how many have a vector already."""
    return _index(spark, sf_dir)[1].select("model", "dimension", "chunks_indexed", "chunks_reused")


def current_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's fetches as revisions: which supersedes which, until when it is valid, and which is current."""
    pages = _t(spark, sf_dir, "clean_documents").withColumnRenamed("package_name", "package").withColumnRenamed("package_version", "version")
    return lineage.revisions(pages, "page_id", "fetched_at").select("page_id", "canonical_url", "supersedes", "valid_to", "is_current")


FIRST, SECOND = datetime(2025, 1, 1, tzinfo=UTC), datetime(2026, 1, 1, tzinfo=UTC)


def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as a first and a second import: pages fetched before 2025, then all pages."""
    pages = _t(spark, sf_dir, "clean_documents").withColumnRenamed("package_name", "package").withColumnRenamed("package_version", "version").withColumnRenamed("page_id", "position")
    return pages.where(F.col("fetched_at") < F.lit(FIRST)), pages


def _whole(documents: DataFrame) -> DataFrame:
    """Each document that counts as one chunk."""
    last = lineage.incoming_documents(documents)
    return last.select(
        F.sha2(F.concat_ws("\0", "package_name", "package_version", "url"), 256).alias("id"), F.col("package_name").alias("package"), F.col("package_version").alias("version"),
        F.col("url").alias("source_url"), "page_title", F.array().cast("array<string>").alias("header_path"), F.lit(0).alias("chunk_index"),
        F.col("markdown").alias("content"), F.col("normalized_content_hash").alias("content_hash"), F.length("markdown").alias("character_count"),
    )


def _second_plan(spark: SparkSession, sf_dir: str) -> tuple[lineage.Tables, lineage.Tables]:
    """(store after the first import, plan of the second)."""
    first, every = _imports(spark, sf_dir)
    store = upgrade(spark, {})
    store = lineage.apply_lineage(store, lineage.plan_lineage(store, first, _whole(first), FIRST), FIRST)
    return store, lineage.plan_lineage(store, every, _whole(every), SECOND)


def lineage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a second import over a first one, planned without writing; a document is one chunk."""
    metrics = _second_plan(spark, sf_dir)[1]["metrics"]
    return metrics.select(*[F.col(n).cast("bigint").alias(n) for n in metrics.columns])


def lineage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document revisions that both imports leave: which are current, until when the others were, what they supersede."""
    store, plan = _second_plan(spark, sf_dir)
    after = lineage.apply_lineage(store, plan, SECOND)
    documents = after["source_documents"].select("id", "source_id", "canonical_url", "normalized_content_hash", "is_current", "valid_to", "supersedes_id")
    older = documents.select(F.col("id").alias("o"), F.col("normalized_content_hash").alias("supersedes_hash"))
    sources = after["sources"].select(F.col("id").alias("s"), "documentation_version_id")
    versions = after["documentation_versions"].select(F.col("id").alias("v"), "package_id", "package_version")
    packages = after["packages"].select(F.col("id").alias("p"), F.col("name").alias("package_name"))
    joined = documents.join(older, F.col("supersedes_id") == F.col("o"), "left").join(sources, F.col("source_id") == F.col("s"))
    joined = joined.join(versions, F.col("documentation_version_id") == F.col("v")).join(packages, F.col("package_id") == F.col("p"))
    return joined.select("package_name", "package_version", "canonical_url", F.col("normalized_content_hash").alias("hash"), "is_current", "valid_to", "supersedes_hash")


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of current documents after both imports: those of a package are found by its name."""
    store, plan = _second_plan(spark, sf_dir)
    after = lineage.apply_lineage(store, plan, SECOND)
    chunks = embedding.current_chunks(after["chunks"], after["source_documents"], "zuvelgraph")
    return chunks.select("package_version", "source_url", "content_hash", "character_count")


def _store(spark: SparkSession, sf_dir: str) -> lineage.Tables:
    """The tables as a store: a run and its sources for each documentation version, some of them unfinished or superseded."""
    text = lambda name: F.col(name).cast("string")
    versions = _t(spark, sf_dir, "documentation_versions")
    packages = _t(spark, sf_dir, "packages").select(text("package_id").alias("id"), F.lit("pypi").alias("ecosystem"), F.col("package_name").alias("name"))
    runs = versions.select(
        text("version_id").alias("id"), text("version_id").alias("documentation_version_id"), F.when(F.col("version_id") % 7 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("version_id") % 11 != 0, F.col("created_at")).alias("completed_at"),
    )
    pages = _t(spark, sf_dir, "clean_documents").select("page_id", "package_name", "package_version")
    named = versions.join(_t(spark, sf_dir, "packages").select("package_id", "package_name"), "package_id").select("version_id", "package_name", "package_version")
    owned = pages.join(named, ["package_name", "package_version"])
    chunks = _t(spark, sf_dir, "chunks")
    first = chunks.groupBy("chunk_id").agg(F.min_by(F.struct("page_id", "content_hash", "package_name", "package_version"), "load_seq").alias("c"))
    return {
        "packages": packages,
        "documentation_versions": versions.select(text("version_id").alias("id"), text("package_id").alias("package_id"), "package_version", "status"),
        "pipeline_runs": runs,
        "sources": owned.select(text("page_id").alias("id"), text("version_id").alias("documentation_version_id")),
        "source_documents": owned.select(text("page_id").alias("id"), text("page_id").alias("source_id"), text("version_id").alias("pipeline_run_id"), (F.col("page_id") % 97 != 0).alias("is_current")),
        "chunks": first.select(F.col("chunk_id").alias("id"), F.col("c.page_id").cast("string").alias("source_document_id"), "c.content_hash", "c.package_name", "c.package_version"),
        "embedding_versions": _t(spark, sf_dir, "embedding_versions").select(text("embedding_version_id").alias("id"), "provider", "model_name", "dimension"),
        "chunk_embeddings": _t(spark, sf_dir, "chunk_embeddings").select("chunk_id", text("embedding_version_id").alias("embedding_version_id")),
    }


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run of the store its counts and what keeps it from being a snapshot."""
    store = _store(spark, sf_dir)
    identity = store["embedding_versions"].where("id = '1'").first()
    report = snapshot.run_report(store, EmbeddingConfig(identity["provider"], identity["model_name"], identity["dimension"]))
    return report.select("run_id", "package", "version", "documents", "superseded", "bare_documents", "chunks", "foreign_chunks", "embedded", "problem")


def lineage_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of an import of all pages over one of the pages fetched before 2025; chunks are those of the documents that count."""

    def chunks(documents: DataFrame) -> DataFrame:
        # Of several fetches of a URL only the last is a document; the others' chunks are not its chunks.
        last = lineage.incoming_documents(documents)
        return chunking.chunk_documents(last.withColumnsRenamed({"package_name": "package", "package_version": "version", "page_title": "title"}), order_col="position")

    first, pages = _imports(spark, sf_dir)
    store = upgrade(spark, {})
    store = lineage.apply_lineage(store, lineage.plan_lineage(store, first, chunks(first), FIRST), FIRST)
    metrics = lineage.plan_lineage(store, pages, chunks(pages), SECOND)["metrics"]
    return metrics.select(*[F.col(n).cast("bigint").alias(n) for n in metrics.columns])


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_batch, vector_topk_blocks, index_recall, hybrid_search, lexical_scores, retrieval_evaluation, evaluation_comparison, missing_embeddings, embedding_coverage,
        indexed_chunks, index_metrics, current_revisions, lineage_counters, lineage_documents, stored_chunks, lineage_imports, run_report,
    )
}

_USABLE = """usable AS (
  SELECT e.vec_id, e.chunk_id, e.embedding_version_id AS ver, list_transform(e.embedding, lambda x: x::DOUBLE) AS v
  FROM chunk_embeddings e JOIN embedding_versions w ON e.embedding_version_id = w.embedding_version_id AND len(e.embedding) = w.dimension
  WHERE len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)"""
_SIM = "greatest(-1.0, least(1.0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))))"


def _words(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(replace(coalesce({x}, ''), '\\_', '_'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def _lexical(heading: str, title: str, content: str, url: str) -> str:
    terms = ["restore", "session", "crawler", "registry"]
    one = [
        f"greatest(CASE WHEN list_contains(string_split({heading}, ' '), '{t}') THEN 1.0 ELSE 0 END, CASE WHEN list_contains(string_split({title}, ' '), '{t}') THEN 0.8 ELSE 0 END, "
        f"CASE WHEN list_contains(string_split({content}, ' '), '{t}') THEN 0.55 ELSE 0 END, CASE WHEN list_contains(string_split({url}, ' '), '{t}') THEN 0.35 ELSE 0 END)::DOUBLE"
        for t in terms
    ]
    phrase = " ".join(terms)
    return (
        f"least(1.0::DOUBLE, ({' + '.join(one)}) / 4 + CASE WHEN contains({heading}, '{phrase}') THEN 0.25::DOUBLE WHEN contains({content}, '{phrase}') THEN 0.15::DOUBLE ELSE 0::DOUBLE END)"
    )


_FIRST = f"""firsts AS (SELECT chunk_id, arg_min(content, load_seq) AS content, arg_min(source_url, load_seq) AS source_url,
  first(page_title ORDER BY load_seq) AS page_title, first(header_path ORDER BY load_seq) AS header_path FROM chunks WHERE content IS NOT NULL GROUP BY 1),
one AS (SELECT ver, chunk_id, arg_min(v, vec_id) AS v FROM usable GROUP BY 1, 2),
scored AS (SELECT a.vec_id AS query_id, a.ver, b.chunk_id, {_SIM} AS sim FROM usable a JOIN (SELECT * FROM one WHERE chunk_id IN (SELECT chunk_id FROM firsts)) b ON a.ver = b.ver WHERE a.vec_id % 20 = 0),
cases AS (SELECT DISTINCT vec_id AS query_id FROM usable WHERE vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS r FROM scored),
texts AS (SELECT chunk_id, {_words("array_to_string(header_path, ' ')")} AS h, {_words("page_title")} AS t, {_words("content")} AS c, {_words("source_url")} AS u,
  trim(regexp_replace(lower(replace(concat_ws(' ', page_title, array_to_string(header_path, ' '), source_url, content), '\\_', '_')), '[^a-z0-9]+', ' ', 'g')) AS hit FROM firsts)"""
_HYBRID = f"""{_FIRST},
hybrid AS (SELECT query_id, ver, n.chunk_id, sim, 0.85::DOUBLE * sim + 0.15::DOUBLE * {_lexical("h", "t", "c", "u")} AS score, hit FROM near n JOIN texts USING (chunk_id) WHERE r <= 40),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, chunk_id)::INT AS position FROM hybrid)"""

_INDEX = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY load_seq) AS n FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL)
  WHERE n = 1 AND page_id IN (SELECT page_id FROM clean_documents WHERE page_id % 10 <> 0)),
h AS (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE embedding_version_id = 1 AND chunk_id IS NOT NULL)"""

_IMPORTS = r"""
WITH d AS (SELECT page_id, nullif(trim(lower(regexp_replace(package_name, '[-_.]+', '-', 'g')), '-'), '') AS p, package_version AS v, url, length(markdown) AS n, fetched_at,
    CASE WHEN regexp_replace(b, '/+$', '') = '' THEN b ELSE regexp_replace(b, '/+$', '') END AS u, sha256(markdown) AS h
  FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM clean_documents WHERE url IS NOT NULL AND markdown IS NOT NULL)),
a AS (SELECT p, v, u, arg_max(h, page_id) AS h FROM d WHERE p IS NOT NULL AND v IS NOT NULL AND fetched_at < TIMESTAMP '2025-01-01' GROUP BY ALL),
b AS (SELECT p, v, u, arg_max(h, page_id) AS h FROM d WHERE p IS NOT NULL AND v IS NOT NULL GROUP BY ALL)"""

ORACLES = {
    "vector_topk": f"""
WITH {_USABLE}, q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ver ORDER BY vec_id) AS n FROM usable) WHERE n = 1),
s AS (SELECT b.ver, b.vec_id, {_SIM} AS sim FROM q a JOIN usable b ON a.ver = b.ver)
SELECT ver AS embedding_version_id, vec_id, round(sim, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ver ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "vector_topk_batch": (_BATCH := f"""
WITH {_USABLE}, s AS (SELECT a.ver, a.vec_id AS query_id, b.vec_id, {_SIM} AS sim FROM usable a JOIN usable b ON a.ver = b.ver WHERE a.vec_id % 20 = 0)
SELECT ver AS embedding_version_id, query_id, vec_id, round(sim, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""),
    "vector_topk_blocks": _BATCH,
    "index_recall": f"WITH {_USABLE} SELECT ver AS embedding_version_id, count(DISTINCT vec_id)::BIGINT AS queries, true AS good FROM usable WHERE vec_id % 20 = 0 GROUP BY 1",
    "lexical_scores": f"""
SELECT load_seq, round({_lexical("h", "t", "c", "u")}, 6) AS relevance FROM (
  SELECT load_seq, {_words("array_to_string(header_path, ' ')")} AS h, {_words("page_title")} AS t, {_words("content")} AS c, {_words("source_url")} AS u FROM chunks)""",
    "hybrid_search": f"WITH {_USABLE}, {_HYBRID} SELECT ver AS embedding_version_id, query_id, chunk_id, round(score, 6) AS score, position FROM ranked WHERE position <= 5",
    "retrieval_evaluation": f"""
WITH {_USABLE}, {_FIRST},
found AS (SELECT query_id, min(r) FILTER (WHERE contains(hit, 'session')) AS rank FROM near JOIN texts USING (chunk_id) WHERE r <= 5 GROUP BY 1),
ranks AS (SELECT query_id, rank FROM cases LEFT JOIN found USING (query_id))
SELECT count(*)::BIGINT AS query_count, count(rank)::BIGINT AS hits_at_k, round(count(rank) / count(*), 6) AS hit_rate_at_k,
       round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mean_reciprocal_rank, '[' || string_agg(coalesce(rank::VARCHAR, 'null'), ',' ORDER BY query_id) || ']' AS ranks
FROM ranks""",
    "evaluation_comparison": f"""
WITH {_USABLE}, {_HYBRID},
a AS (SELECT query_id, min(r) FILTER (WHERE contains(hit, 'session'))::INT AS x FROM near JOIN texts USING (chunk_id) WHERE r <= 5 GROUP BY 1),
b AS (SELECT query_id, min(position) FILTER (WHERE contains(hit, 'session'))::INT AS y FROM ranked WHERE position <= 5 GROUP BY 1)
SELECT query_id, '{QUERY_TEXT}' AS query, x AS baseline_rank, y AS tuned_rank FROM cases LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""",
    "indexed_chunks": _INDEX + """
SELECT chunk_id, 384 AS dimension, CASE WHEN regexp_matches(content, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_length FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM h)""",
    "index_metrics": _INDEX + """
SELECT 'hashing' AS model, 384 AS dimension, count(*) FILTER (WHERE chunk_id NOT IN (SELECT chunk_id FROM h))::BIGINT AS chunks_indexed, count(*) FILTER (WHERE chunk_id IN (SELECT chunk_id FROM h))::BIGINT AS chunks_reused FROM c""",
    "missing_embeddings": """
SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE embedding_version_id = 1 AND chunk_id IS NOT NULL)""",
    "embedding_coverage": """
SELECT v.embedding_version_id, provider, model_name, dimension, count(DISTINCT e.chunk_id)::BIGINT AS covered
FROM embedding_versions v LEFT JOIN (SELECT * FROM chunk_embeddings WHERE chunk_id IN (SELECT chunk_id FROM chunks)) e USING (embedding_version_id) GROUP BY ALL""",
    "current_revisions": r"""
WITH r AS (SELECT page_id, package_name, package_version, CASE WHEN regexp_replace(b, '/+$', '') = '' THEN b ELSE regexp_replace(b, '/+$', '') END AS canonical_url, sha256(markdown) AS h, fetched_at
  FROM (SELECT *, regexp_replace(trim(url), '#.*$', '') AS b FROM clean_documents WHERE url IS NOT NULL AND markdown IS NOT NULL AND package_name IS NOT NULL)),
c AS (SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY package_name, package_version, canonical_url ORDER BY fetched_at, page_id) AS before FROM r) WHERE before IS NULL OR before <> h),
f AS (SELECT *, lag(page_id) OVER w AS supersedes, lead(fetched_at) OVER w AS valid_to FROM c WINDOW w AS (PARTITION BY package_name, package_version, canonical_url ORDER BY fetched_at, page_id))
SELECT page_id, canonical_url, supersedes, valid_to, valid_to IS NULL AS is_current FROM f""",
    "lineage_counters": _IMPORTS + """
SELECT (SELECT count(*) FROM (SELECT p FROM b EXCEPT SELECT p FROM a))::BIGINT AS packages_inserted,
       (SELECT count(*) FROM (SELECT p, v FROM b EXCEPT SELECT p, v FROM a))::BIGINT AS versions_inserted,
       (SELECT count(*) FROM (SELECT p, v, list(u || h ORDER BY u) FROM b GROUP BY 1, 2 EXCEPT SELECT p, v, list(u || h ORDER BY u) FROM a GROUP BY 1, 2))::BIGINT AS runs_inserted,
       count(*) FILTER (WHERE a.u IS NULL)::BIGINT AS sources_inserted, count(a.u)::BIGINT AS sources_reused,
       count(*) FILTER (WHERE a.h IS DISTINCT FROM b.h)::BIGINT AS documents_inserted, count(*) FILTER (WHERE a.h = b.h)::BIGINT AS documents_reused,
       count(*) FILTER (WHERE a.h IS DISTINCT FROM b.h)::BIGINT AS chunks_inserted, count(*) FILTER (WHERE a.h = b.h)::BIGINT AS chunks_reused
FROM b LEFT JOIN a USING (p, v, u)""",
    "lineage_documents": _IMPORTS + """
SELECT p AS package_name, v AS package_version, u AS canonical_url, a.h AS hash, b.h = a.h AS is_current, CASE WHEN b.h <> a.h THEN TIMESTAMP '2026-01-01' END AS valid_to, NULL::VARCHAR AS supersedes_hash FROM a JOIN b USING (p, v, u)
UNION ALL SELECT p, v, u, b.h, true, NULL, a.h FROM b LEFT JOIN a USING (p, v, u) WHERE a.h IS DISTINCT FROM b.h""",
    "stored_chunks": _IMPORTS + """
SELECT v AS package_version, arg_max(url, page_id) AS source_url, arg_max(h, page_id) AS content_hash, arg_max(n, page_id)::INT AS character_count
FROM d WHERE p = 'zuvelgraph' AND v IS NOT NULL GROUP BY v, u""",
    "run_report": """
WITH c AS (SELECT chunk_id, arg_min(page_id, load_seq) AS page_id, arg_min(package_name, load_seq) AS pn, arg_min(package_version, load_seq) AS pv FROM chunks GROUP BY 1),
ver AS (SELECT v.version_id, p.package_name, v.package_version, v.status, v.created_at FROM documentation_versions v JOIN packages p USING (package_id)),
d AS (SELECT v.version_id, d.page_id, d.page_id % 97 <> 0 AS cur FROM clean_documents d JOIN ver v USING (package_name, package_version)),
e AS (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE embedding_version_id = 1),
per AS (SELECT d.version_id, d.page_id, d.cur, count(c.chunk_id) AS n, count(e.chunk_id) AS m,
          count(*) FILTER (WHERE c.chunk_id IS NOT NULL AND (c.pn IS DISTINCT FROM v.package_name OR c.pv IS DISTINCT FROM v.package_version)) AS f
        FROM d JOIN ver v USING (version_id) LEFT JOIN c ON c.page_id = d.page_id LEFT JOIN e ON e.chunk_id = c.chunk_id GROUP BY ALL),
t AS (SELECT version_id, count(*) AS documents, count(*) FILTER (WHERE NOT cur) AS superseded, count(*) FILTER (WHERE n = 0) AS bare, sum(n) AS chunks, sum(f) AS foreign_, sum(m) AS embedded FROM per GROUP BY 1),
r AS (SELECT v.*, coalesce(documents, 0)::BIGINT AS documents, coalesce(superseded, 0)::BIGINT AS superseded, coalesce(bare, 0)::BIGINT AS bare, coalesce(chunks, 0)::BIGINT AS chunks,
        coalesce(foreign_, 0)::BIGINT AS foreign_, coalesce(embedded, 0)::BIGINT AS embedded FROM ver v LEFT JOIN t USING (version_id))
SELECT version_id::VARCHAR AS run_id, package_name AS package, package_version AS version, documents, superseded, bare AS bare_documents, chunks, foreign_ AS foreign_chunks, embedded,
  CASE WHEN status <> 'completed' THEN 'version_not_completed' WHEN version_id % 7 = 0 OR version_id % 11 = 0 OR created_at IS NULL THEN 'run_not_completed' WHEN documents = 0 THEN 'no_documents'
       WHEN superseded > 0 THEN 'superseded_documents' WHEN chunks = 0 THEN 'no_chunks' WHEN foreign_ > 0 THEN 'foreign_chunks' WHEN bare > 0 THEN 'bare_documents'
       WHEN embedded < chunks THEN 'missing_vectors' END AS problem
FROM r""",
}
