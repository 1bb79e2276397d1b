"""Snapshots of the store that a catalog can be built from, checked and hashed.

All pipeline runs are examined at once: ``run_report`` has a row for each, with
its counts and the first thing that keeps it from being a snapshot. Resolving one
run is looking up its row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EmbeddingConfig
from docloom.functions.identity import package_name, sha256_of
from docloom.operators.embedding import embedding_version_id
from docloom.plans.digests import set_digest

ID = re.compile(r"[0-9a-f]{64}|[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}")
#: What can be wrong with a run, in the order in which it is looked for: code, condition over ``run_report``'s columns.
PROBLEMS = (
    ("version_not_completed", "version_status <> 'completed'"),
    ("run_not_completed", "run_status <> 'completed' or completed_at is null"),
    ("no_documents", "documents = 0"),
    ("superseded_documents", "superseded > 0"),
    ("no_chunks", "chunks = 0"),
    ("foreign_chunks", "foreign_chunks > 0"),
    ("bare_documents", "bare_documents > 0"),
    ("unknown_embedding", "not embedding_known"),
    ("missing_vectors", "embedded < chunks"),
)


class UnusableSnapshot(ValueError):
    """A run that no catalog can be built from; ``code`` is one of ``PROBLEMS``, malformed_run_id or unknown_run."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Snapshot:
    """A usable run: its lineage, its chunks (id, content_hash), and the identity of all that."""

    package: str
    package_version: str
    documentation_version_id: str
    run_id: str
    embedding_version_id: str
    chunks: DataFrame
    chunk_count: int
    digest: str


def snapshot_hash(package: str, version: str, documentation_version_id: str, run_id: str, chunks: DataFrame) -> str:
    """The identity of a snapshot: its lineage and the set of its (id, content_hash), whatever their order.

    The set is hashed as a tree (``plans.digests``), so no task sees all chunks.
    """
    digest = set_digest(chunks, [], F.concat_ws("\0", "id", "content_hash"), "d").first()
    return sha256_of([package_name(package), version, documentation_version_id, run_id, digest["d"] if digest else ""])


def flat_snapshot_hash(package: str, version: str, documentation_version_id: str, run_id: str, chunks: list[tuple[str, str]]) -> str:
    """The same identity over a list that is already on the driver, as plain canonical JSON."""
    # The keys under which stored snapshot identities were hashed.
    keys = ("package", "package_version", "documentation_version_id", "source_pipeline_run_id", "chunks")
    return sha256_of(dict(zip(keys, (package_name(package), version, documentation_version_id, run_id, sorted(map(list, chunks))), strict=True)))


def run_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, document_id, is_current, chunk_id, content_hash, package_name, package_version) of the documents of all runs.

    A document without chunks has one row with a null chunk. Of several
    revisions of a source in one run (its text went back to what it was) the
    current one counts. Documents whose source belongs to another version than
    their run are left out.
    """
    runs = tables["pipeline_runs"].select(F.col("id").alias("run_id"), F.col("documentation_version_id").alias("r_version"))
    sources = tables["sources"].select(F.col("id").alias("s_id"), F.col("documentation_version_id").alias("s_version"))
    documents = tables["source_documents"].select("id", "source_id", "pipeline_run_id", "is_current")
    documents = documents.join(sources, F.col("source_id") == F.col("s_id")).join(runs, (F.col("pipeline_run_id") == F.col("run_id")) & (F.col("s_version") == F.col("r_version")))
    newest = documents.groupBy("run_id", "source_id").agg(F.max_by(F.struct("id", "is_current"), F.struct("is_current", "id")).alias("d"))
    newest = newest.select("run_id", F.col("d.id").alias("document_id"), F.col("d.is_current").alias("is_current"))
    chunks = tables["chunks"].select(F.col("id").alias("chunk_id"), "content_hash", "source_document_id", "package_name", "package_version")
    return newest.join(chunks, F.col("document_id") == F.col("source_document_id"), "left").drop("source_document_id")


def _identity(embedding: EmbeddingConfig) -> Column:
    return (F.col("provider") == embedding.provider) & (F.col("model_name") == embedding.model) & (F.col("dimension") == embedding.dimension)


def run_report(tables: dict[str, DataFrame], embedding: EmbeddingConfig) -> DataFrame:
    """A row for each run of a Python package: its lineage, its counts and ``problem``, null if it is a usable snapshot.

    Columns: run_id, package, version, version_id, version_status, run_status,
    completed_at, documents, superseded, bare_documents, chunks, foreign_chunks,
    embedded, embedding_known, problem. Chunks are foreign if they name another
    package or version than their run. Without runs the result is empty.
    """
    packages = tables["packages"].where("ecosystem = 'pypi'").select(F.col("id").alias("p_id"), F.col("name").alias("package"))
    versions = tables["documentation_versions"].select(F.col("id").alias("version_id"), "package_id", F.col("package_version").alias("version"), F.col("status").alias("version_status"))
    runs = tables["pipeline_runs"].select(F.col("id").alias("run_id"), F.col("documentation_version_id").alias("v"), F.col("status").alias("run_status"), "completed_at")
    lineage = runs.join(versions, F.col("v") == F.col("version_id")).join(packages, F.col("package_id") == F.col("p_id")).drop("v", "package_id", "p_id")

    known = tables["embedding_versions"].where(_identity(embedding)).select(F.col("id").alias("k"))
    vectors = tables["chunk_embeddings"].join(known, F.col("embedding_version_id") == F.col("k"), "left_semi").select(F.col("chunk_id").alias("e")).distinct()
    rows = run_chunks(tables).join(vectors, F.col("chunk_id") == F.col("e"), "left")
    named = rows.join(lineage.select(F.col("run_id").alias("r"), "package", "version"), F.col("run_id") == F.col("r"))
    foreign = F.col("chunk_id").isNotNull() & ~(F.col("package_name").eqNullSafe(F.col("package")) & F.col("package_version").eqNullSafe(F.col("version")))
    # A document in one row first, so that a run's documents are counted without a distinct count.
    per_document = named.groupBy("r", "document_id", "is_current").agg(F.count("chunk_id").alias("n"), F.count_if(foreign).alias("f"), F.count("e").alias("e"))
    counts = per_document.groupBy("r").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("is_current")).alias("superseded"), F.count_if(F.col("n") == 0).alias("bare_documents"),
        F.sum("n").alias("chunks"), F.sum("f").alias("foreign_chunks"), F.sum("e").alias("embedded"),
    )
    names = [c for c in counts.columns if c != "r"]
    full = lineage.join(counts, F.col("run_id") == F.col("r"), "left").drop("r").na.fill(0, names)
    full = full.join(known.agg((F.count(F.lit(1)) > 0).alias("embedding_known")))
    problem = F.coalesce(*[F.when(F.expr(condition), F.lit(code)) for code, condition in PROBLEMS])
    return full.select("run_id", "package", "version", "version_id", "version_status", "run_status", "completed_at", *names, "embedding_known", problem.alias("problem"))


def resolve_snapshot(tables: dict[str, DataFrame], package: str, version: str, run_id: str, embedding: EmbeddingConfig) -> Snapshot:
    """The snapshot of a run, if it is complete, current and fully embedded; else UnusableSnapshot for the first problem."""
    name = package_name(package)
    if not ID.fullmatch(run_id):
        raise UnusableSnapshot("malformed_run_id", f"{run_id!r} is neither a UUID nor a hex digest")
    one = tables | {"pipeline_runs": tables["pipeline_runs"].where(F.col("id") == run_id), "source_documents": tables["source_documents"].where(F.col("pipeline_run_id") == run_id)}
    found = run_report(one, embedding).where((F.col("package") == name) & (F.col("version") == version)).limit(2).collect()
    if len(found) != 1:
        raise UnusableSnapshot("unknown_run", f"{name} {version} has {len(found)} runs with the id {run_id}")
    row = found[0]
    if row["problem"]:
        counted = ("documents", "superseded", "bare_documents", "chunks", "foreign_chunks", "embedded")
        raise UnusableSnapshot(row["problem"], ", ".join(f"{n} {row[n]}" for n in counted))
    members = run_chunks(one).select(F.col("chunk_id").alias("id"), "content_hash")
    known = tables["embedding_versions"].where(_identity(embedding)).select("id").first()
    digest = snapshot_hash(name, version, row["version_id"], run_id, members)
    return Snapshot(name, version, row["version_id"], run_id, known["id"] if known else embedding_version_id(embedding), members, row["chunks"], digest)
