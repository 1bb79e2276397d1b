"""The pipeline from packages to an indexed store, as one chain of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import ChunkingConfig, CrawlConfig, EmbeddingConfig
from docloom.operators import chunking, discovery, embedding, ingest, lineage
from docloom.sources.readers import DiscoveryProvider, captured_pages
from docloom.sources.writers import StageLog


@dataclass(frozen=True)
class PipelineFrames:
    """What the stages hand on; each stage returns a new object."""

    packages: DataFrame  # package, version
    sources: DataFrame | None = None
    plan: DataFrame | None = None
    raw_documents: DataFrame | None = None
    clean_documents: DataFrame | None = None
    chunks: DataFrame | None = None
    import_counts: dict[str, int] | None = None
    index_counts: dict[str, object] | None = None


def discover(frames: PipelineFrames, provider: DiscoveryProvider, answers: DataFrame) -> PipelineFrames:
    """Sources of the packages, validated by ``answers`` (url, status_code, final_url, error)."""
    found = discovery.manifest_sources(provider.discover(frames.packages))
    return replace(frames, sources=discovery.validate_sources(found.withColumn("http_status", F.lit(None).cast("int")).withColumn("redirect_url", F.lit(None).cast("string")).withColumn("notes", F.lit("")), answers))


def plan_crawl(frames: PipelineFrames, captured: DataFrame, strict: bool = False) -> PipelineFrames:
    """The pages linked from each package's documentation, whatever the source's status."""
    if frames.sources is None:
        raise RuntimeError("discovery must run before crawl planning")
    docs = frames.sources.where("source_type = 'documentation'").groupBy("package", "version").agg(F.min("url").alias("root"))
    pages = docs.join(captured.select(F.col("url").alias("u"), "html"), F.col("root") == F.col("u"))
    plan = discovery.crawl_plan(pages.select(F.col("root").alias("url"), "html").distinct(), strict=strict)
    return replace(frames, plan=plan.join(docs, F.col("root_url") == F.col("root")).drop("root"))


def fetch_and_clean(frames: PipelineFrames, captured: DataFrame, config: CrawlConfig | None = None) -> PipelineFrames:
    """The first pages of each plan, fetched and turned into clean Markdown."""
    if frames.plan is None:
        raise RuntimeError("crawl planning must run before ingestion")
    order = Window.partitionBy("package", "version").orderBy("position")
    first = frames.plan.withColumn("position", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("position") < (config or CrawlConfig()).max_pages)
    fetched = captured_pages(first.select("title", "url").distinct(), captured)
    raw = first.select("package", "version", "position", "url", "title").join(fetched.drop("title").dropDuplicates(["url"]), "url")
    clean = ingest.ingest(raw)
    return replace(frames, raw_documents=clean.drop("markdown"), clean_documents=clean)


def chunk(frames: PipelineFrames, config: ChunkingConfig | None = None) -> PipelineFrames:
    if frames.clean_documents is None:
        raise RuntimeError("ingestion must run before chunking")
    return replace(frames, chunks=chunking.chunk_documents(frames.clean_documents, config, "position"))


def persist(frames: PipelineFrames, store: lineage.SnapshotStore, now: datetime | None = None, config: ChunkingConfig | None = None) -> PipelineFrames:
    return replace(frames, import_counts=lineage.import_frames(store, frames.clean_documents, frames.chunks, now, config))


def index(frames: PipelineFrames, store: lineage.SnapshotStore, config: EmbeddingConfig, embedder: embedding.Embedder) -> PipelineFrames:
    """Embed what the store lacks and commit it."""
    tables = store.read()
    new, metrics = embedding.index_chunks(tables["chunks"], tables["source_documents"], tables["chunk_embeddings"], config, embedder)
    counts = metrics.first().asDict()
    version = tables["packages"].sparkSession.createDataFrame(
        [(embedding.embedding_version_id(config), config.provider, config.model, config.dimension)], tables["embedding_versions"].schema
    )
    known = tables["embedding_versions"].select("id")
    store.append({"embedding_versions": version.join(known, "id", "left_anti"), "chunk_embeddings": new})
    return replace(frames, index_counts=counts)


def run_pipeline(
    packages: DataFrame, provider: DiscoveryProvider, answers: DataFrame, captured: DataFrame, store: lineage.SnapshotStore,
    embedding_config: EmbeddingConfig, embedder: embedding.Embedder, reporter: StageLog | None = None,
    chunking_config: ChunkingConfig | None = None, crawl_config: CrawlConfig | None = None, now: datetime | None = None,
) -> PipelineFrames:
    """All stages in order, reported as each completes."""
    report = reporter or StageLog()
    frames = discover(PipelineFrames(packages), provider, answers)
    found = frames.sources.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "verified").alias("v")).first()
    report.done("Official documentation discovery", {"sources_found": found["n"], "sources_verified": found["v"]})
    frames = plan_crawl(frames, captured)
    report.done("Crawl planning", {"pages_planned": frames.plan.count()})
    frames = fetch_and_clean(frames, captured, crawl_config)
    report.done("Download, extraction, and Markdown normalization", {"documents_cleaned": frames.clean_documents.count()})
    frames = chunk(frames, chunking_config)
    report.done("Markdown chunking", {"chunks_created": frames.chunks.count()})
    frames = persist(frames, store, now or datetime.now(UTC), chunking_config)
    report.done("Lineage persistence", frames.import_counts)
    frames = index(frames, store, embedding_config, embedder)
    report.done("Embeddings and indexing", frames.index_counts)
    report.next("Metadata-filtered retrieval evaluation")
    return frames
