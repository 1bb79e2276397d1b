"""Schemas of all records and stored tables, and their versions.

The store is a set of Parquet tables. A schema version adds tables, as a
migration would; ``upgrade`` and ``downgrade`` tell what to create and drop.
Spark enforces neither keys nor checks: see ``operators.constraints``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DOCUMENTATION_SOURCE = "source_type STRING, title STRING, url STRING, status STRING, http_status INT, redirect_url STRING, notes STRING"
CHUNK = (
    "id STRING, content STRING, package STRING, version STRING, source_url STRING, page_title STRING, "
    "header_path ARRAY<STRING>, chunk_index INT, content_hash STRING, character_count INT"
)

RECORDS = {
    "documentation_source": DOCUMENTATION_SOURCE,
    "documentation_manifest": f"package STRING, version STRING, sources ARRAY<STRUCT<{DOCUMENTATION_SOURCE}>>, output_directory STRING, selected_sections ARRAY<STRING>",
    "crawl_page": "root_url STRING, position BIGINT, title STRING, url STRING, level INT, parent STRING, status STRING",
    "raw_document": "title STRING, url STRING, html STRING, status_code INT, metadata MAP<STRING,STRING>, framework STRING",
    "clean_document": "title STRING, url STRING, markdown STRING, metadata MAP<STRING,STRING>",
    "markdown_section": "header_path ARRAY<STRING>, content STRING",
    "chunk": CHUNK,
    "page_metadata": "title STRING, url STRING, package STRING, version STRING, section STRING, tags ARRAY<STRING>",
    "retrieval_result": "content STRING, score DOUBLE, source_url STRING, header_path ARRAY<STRING>",
    "generated_section": "title STRING, markdown STRING, sources ARRAY<STRING>",
    "validation_report": "section STRING, passed BOOLEAN, issues ARRAY<STRING>",
    "search_hit": "query_id BIGINT, chunk_id STRING, content STRING, source_url STRING, page_title STRING, header_path ARRAY<STRING>, score DOUBLE",
    "evaluation_case": "query STRING, expected_any ARRAY<STRING>",
    "evaluation_result": "query_count BIGINT, hits_at_k BIGINT, hit_rate_at_k DOUBLE, mean_reciprocal_rank DOUBLE, ranks ARRAY<INT>",
    "extracted_topic": "kind STRING, qualified_name STRING, display_name STRING, canonical_target STRING, definition STRING, source_chunk_id STRING, source_url STRING, origin STRING",
    "deferred_symbol": "kind STRING, qualified_name STRING, display_name STRING, canonical_target STRING, owner_qualified_name STRING, source_chunk_id STRING, source_url STRING",
    "excluded_candidate": "reason STRING, source_chunk_id STRING, source_url STRING, canonical_target STRING, marker STRING",
    "normalized_topic": "kind STRING, qualified_name STRING, display_name STRING, canonical_target STRING, definition STRING, parent_qualified_name STRING, slug STRING, output_path STRING, structural_chunk_ids ARRAY<STRING>, aliases ARRAY<STRING>, derived BOOLEAN, sort_order BIGINT",
    "topic_evidence": "qualified_name STRING, kind STRING, chunk_id STRING, role STRING, rank INT, score DOUBLE",
    "issue": "code STRING, qualified_name STRING, blocking BOOLEAN, detail STRING",
}

#: Allowed values of enumerated columns, by table and column.
ENUMS = {
    ("documentation_source", "source_type"): ("documentation", "api_reference", "examples", "release_notes"),
    ("documentation_source", "status"): ("pending", "verified", "failed"),
    ("crawl_page", "status"): ("pending", "downloaded", "failed", "skipped"),
    ("raw_document", "framework"): ("generic", "mintlify", "docusaurus", "mkdocs", "sphinx"),
    ("documentation_versions", "status"): ("pending", "running", "completed", "failed"),
    ("pipeline_runs", "status"): ("pending", "running", "completed", "failed"),
    ("sources", "confirmation_status"): ("pending", "verified", "failed"),
    ("topic_catalogs", "status"): ("draft", "awaiting_approval", "approved", "superseded", "rejected"),
    ("topics", "kind"): ("module", "class", "function", "concept", "guide"),
    ("topics", "status"): ("proposed", "approved", "rejected"),
    ("topic_evidence", "role"): ("primary", "supporting"),
    ("extracted_topic", "origin"): ("api_reference", "curated_page"),
    ("excluded_candidate", "reason"): ("cross_namespace", "malformed_reference"),
    ("deferred_symbol", "kind"): ("type", "constant"),
}

_LINEAGE = {
    "packages": "id STRING, ecosystem STRING, name STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "documentation_versions": "id STRING, package_id STRING, package_version STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "pipeline_runs": "id STRING, documentation_version_id STRING, config_hash STRING, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP",
    "sources": "id STRING, documentation_version_id STRING, source_type STRING, url STRING, canonical_url STRING, confirmation_status STRING, confirmed_by STRING, confirmed_at TIMESTAMP",
    "source_documents": (
        "id STRING, source_id STRING, pipeline_run_id STRING, url STRING, canonical_url STRING, page_title STRING, http_status INT, framework STRING, "
        "raw_content_hash STRING, normalized_content_hash STRING, normalized_markdown STRING, fetch_metadata MAP<STRING,STRING>, fetched_at TIMESTAMP, "
        "is_current BOOLEAN, valid_to TIMESTAMP, supersedes_id STRING"
    ),
    "chunks": (
        "id STRING, source_document_id STRING, package_name STRING, package_version STRING, source_url STRING, page_title STRING, "
        "header_path ARRAY<STRING>, chunk_index INT, content STRING, content_hash STRING, character_count INT"
    ),
}
_EMBEDDINGS = {
    "embedding_versions": "id STRING, provider STRING, model_name STRING, dimension INT",
    "chunk_embeddings": "chunk_id STRING, embedding_version_id STRING, embedding ARRAY<FLOAT>",
}
_CATALOG = {
    "topic_catalogs": "id STRING, documentation_version_id STRING, config_hash STRING, status STRING, approved_by STRING, approved_at TIMESTAMP",
    "topics": (
        "id STRING, catalog_id STRING, qualified_name STRING, display_name STRING, kind STRING, slug STRING, output_path STRING, parent_topic_id STRING, "
        "aliases ARRAY<STRING>, summary STRING, sort_order INT, status STRING, updated_at TIMESTAMP"
    ),
    "topic_evidence": "topic_id STRING, chunk_id STRING, role STRING, rank INT, score DOUBLE",
}
#: What each schema version adds, in order.
MIGRATIONS = [("0001", _LINEAGE), ("0002", _EMBEDDINGS), ("0003", _CATALOG)]
TABLES: dict[str, str] = {name: ddl for _, tables in MIGRATIONS for name, ddl in tables.items()}


def schema(name: str) -> StructType:
    """The schema of a record or table."""
    return StructType.fromDDL(TABLES.get(name) or RECORDS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A record type or table without rows."""
    return spark.createDataFrame([], schema(name))


def upgrade(spark: SparkSession, tables: dict[str, DataFrame], to: str | None = None) -> dict[str, DataFrame]:
    """Add the tables of all schema versions up to ``to`` (default: the latest); present ones stay."""
    out = dict(tables)
    for version, added in MIGRATIONS:
        if to is not None and version > to:
            break
        for name in added:
            out.setdefault(name, empty(spark, name))
    return out


def downgrade(tables: dict[str, DataFrame], to: str = "") -> dict[str, DataFrame]:
    """Drop the tables of all schema versions after ``to``."""
    gone = {name for version, added in MIGRATIONS if version > to for name in added}
    return {name: table for name, table in tables.items() if name not in gone}


def create_statements(to: str | None = None) -> list[str]:
    """The DDL of an upgrade, for catalogs that create tables from SQL."""
    return [f"CREATE TABLE IF NOT EXISTS {n} ({d}) USING parquet" for v, a in MIGRATIONS if to is None or v <= to for n, d in a.items()]
