"""Command line: import, index, search and evaluate a store, or check the embedder.

    python -m docloom.cli import chunks.jsonl --store DIR --package P --version V
    python -m docloom.cli index --store DIR --package P --version V
    python -m docloom.cli search "how to install" --store DIR --package P --version V
    python -m docloom.cli evaluate cases.json --store DIR --package P --version V
    python -m docloom.cli prepare
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import EmbeddingConfig
from docloom.functions.identity import package_name
from docloom.operators import chunking, embedding, evaluation, lineage, search
from docloom.sources import readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docloom", description=__doc__.split("\n")[0])
    out.add_argument("--dimension", type=int, default=384, help="dimension of the hashing embedder")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("import", "index", "search", "evaluate"):
        command = commands.add_parser(name)
        if name != "index":
            command.add_argument("input", help={"import": "chunk artifact", "search": "query", "evaluate": "JSON file of cases"}[name])
        for option in ("--store", "--package", "--version"):
            command.add_argument(option, required=True)
        if name in ("search", "evaluate"):
            command.add_argument("--limit", type=int, default=5)
            command.add_argument("--no-rerank", action="store_true")
    commands.add_parser("prepare")
    return out


def import_artifact(store: lineage.SnapshotStore, path: str, package: str, version: str) -> dict[str, int]:
    """Import a chunk artifact: documents are rebuilt from their chunks."""
    chunks = chunking.require_identity(readers.read_chunks_jsonl(store.spark, path), package, version)
    documents = chunking.rebuild_documents(chunks).withColumn("position", F.lit(0).cast("bigint"))
    return lineage.import_frames(store, documents, chunks, datetime.now(UTC))


def index(store: lineage.SnapshotStore, config: EmbeddingConfig, embedder: embedding.Embedder, package: str, version: str) -> dict[str, object]:
    """Embed the current chunks of a package version that lack a vector."""
    tables = store.read()
    new, metrics = embedding.index_chunks(tables["chunks"], tables["source_documents"], tables["chunk_embeddings"], config, embedder, package_name(package), version)
    counts = metrics.first().asDict()
    known = tables["embedding_versions"]
    row = store.spark.createDataFrame([(embedding.embedding_version_id(config), config.provider, config.model, config.dimension)], known.schema)
    store.append({"embedding_versions": row.join(known.select("id"), "id", "left_anti"), "chunk_embeddings": new})
    return counts


def find(store: lineage.SnapshotStore, queries: DataFrame, config: EmbeddingConfig, embedder: embedding.Embedder, package: str, version: str, limit: int, hybrid: bool) -> DataFrame:
    """Hits of queries (query_id, query) among the current chunks of a package version."""
    tables = store.read()
    chunks = embedding.current_chunks(tables["chunks"], tables["source_documents"], package_name(package), version)
    return search.search(chunks, tables["chunk_embeddings"], search.with_vectors(queries, embedder), embedding.embedding_version_id(config), limit, hybrid)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    embedder = embedding.HashingEmbedder(given.dimension)
    embedding.self_check(embedder)
    if given.command == "prepare":
        print(json.dumps({"dimension": given.dimension, "ready": True}))
        return 0
    spark = spark or SparkSession.builder.appName("docloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = EmbeddingConfig("local", "hashing", given.dimension)
    store = lineage.SnapshotStore(spark, given.store)
    where = (given.package, given.version)
    if given.command == "import":
        print(json.dumps(import_artifact(store, given.input, *where)))
    elif given.command == "index":
        print(json.dumps(index(store, config, embedder, *where)))
    elif given.command == "search":
        queries = spark.createDataFrame([(0, given.input)], "query_id long, query string")
        for hit in find(store, queries, config, embedder, *where, given.limit, not given.no_rerank).orderBy("position").collect():
            print(f"{hit.position}. {hit.score:.3f} {hit.source_url}\n   {' > '.join(hit.header_path)}\n   {hit.content[:240]}")
    else:
        cases = readers.read_evaluation_cases(spark, given.input)
        runs = [evaluation.relevant_ranks(cases, find(store, cases.select("query_id", "query"), config, embedder, *where, given.limit, hybrid)) for hybrid in (False, not given.no_rerank)]
        baseline, tuned = (evaluation.evaluate(r).first().asDict() for r in runs)
        changes = [r.asDict() for r in evaluation.compare(*runs).orderBy("query_id").collect()]
        print(json.dumps({"baseline": baseline, "tuned": tuned, "queries": changes}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
