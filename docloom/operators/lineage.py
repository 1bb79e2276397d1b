"""Revision lineage: what an import adds to the store, closes and reuses.

``plan_lineage`` is a pure function of the store's tables and the incoming
frames, built from joins; ``SnapshotStore`` writes what the plan adds and then
one manifest, so a reader sees all of it or nothing.

Decisions where plain replaying would break: incoming documents are one for each
canonical URL (the last wins), chunks belong to a document revision, so going
back to an earlier text gets its own chunks, and the chunking configuration is
part of the run's identity.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.config import ChunkingConfig
from docloom.functions.identity import canonical_url, normalize_package_name, sha256, sha256_of, stored_chunk_id
from docloom.operators import constraints
from docloom.plans.digests import set_digest
from docloom.plans.manifest import Manifest
from docloom.plans.shared import Scratch
from docloom.schemas import TABLES, schema

Tables = dict[str, DataFrame]
#: Tables to which an import only adds rows, and the names of these rows in a plan.
ADDED = {"packages": "packages", "sources": "sources", "source_documents": "docs", "chunks": "chunks"}


def _instant(now: datetime) -> Column:
    return F.lit(now.astimezone(UTC).replace(tzinfo=None)).cast("timestamp")


def _id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def incoming_documents(documents: DataFrame) -> DataFrame:
    """Normalized incoming documents, one for each package, version and canonical URL: the last by ``position``."""
    have = set(documents.columns)

    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    rows = documents.select(
        normalize_package_name(F.col("package")).alias("package_name"),
        F.col("version").alias("package_version"),
        F.col("url"),
        canonical_url(F.col("url")).alias("canonical_url"),
        F.coalesce("title", F.lit("")).alias("page_title"),
        "markdown",
        column("html", "string"),
        column("status_code", "int"),
        column("framework", "string"),
        column("metadata", "map<string,string>"),
        column("position", "bigint"),
    ).dropna(subset=["package_name", "package_version", "url", "markdown"])
    key = ["package_name", "package_version", "canonical_url"]
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("position", "url", "markdown")).alias("d"))
    return last.select(*key, *[F.col(f"d.{c}").alias(c) for c in rest]).withColumn("normalized_content_hash", sha256(F.col("markdown")))


def revisions(fetches: DataFrame, id_col: str, at_col: str) -> DataFrame:
    """What imports of all fetches, one after the other, leave as revisions: the fetches that changed a page's text.

    ``fetches``: package, version, url, markdown, an id and a time. Adds
    package_name, canonical_url, normalized_content_hash, ``supersedes`` (the id
    of the revision before), ``valid_to`` (the time of the next one) and
    ``is_current``. Fetches at one time follow their ids. Rows without package,
    url or text are no fetches.
    """
    rows = fetches.dropna(subset=["package", "url", "markdown"]).select(
        F.col(id_col), F.col(at_col), normalize_package_name(F.col("package")).alias("package_name"), F.col("version").alias("package_version"),
        canonical_url(F.col("url")).alias("canonical_url"), sha256(F.col("markdown")).alias("normalized_content_hash"),
    )
    order = Window.partitionBy("package_name", "package_version", "canonical_url").orderBy(at_col, id_col)
    before = F.lag("normalized_content_hash").over(order)
    changed = rows.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col("normalized_content_hash"))).drop("__before")
    return changed.withColumns({"supersedes": F.lag(id_col).over(order), "valid_to": F.lead(at_col).over(order)}).withColumn("is_current", F.col("valid_to").isNull())


def plan_lineage(current: Tables, documents: DataFrame, chunks: DataFrame, now: datetime, config: ChunkingConfig | None = None) -> Tables:
    """Everything an import changes, as DataFrames.

    ``packages_ins``, ``versions_ins``, ``runs_ins``, ``sources_ins``,
    ``docs_ins``, ``chunks_ins``: new rows; ``docs_closed``: ids of superseded
    revisions; ``runs_done``, ``versions_done``: ids whose status becomes
    completed; ``metrics``: one row of counters. The store is not changed. Empty
    frames plan nothing. Several packages and versions may come at once.
    """
    # Each of the steps below is read by several planned tables: written once, not computed again.
    scratch = Scratch(documents.sparkSession, "lineage")
    at = _instant(now)
    setting = F.lit(sha256_of({k: getattr(config or ChunkingConfig(), k) for k in ("max_characters", "overlap_characters", "headers")}))
    docs = scratch.write(incoming_documents(documents), "incoming")
    version_key = ["package_name", "package_version"]
    states = set_digest(docs, version_key, F.concat_ws("\0", "canonical_url", "normalized_content_hash"), "state")
    runs = states.select(
        *version_key,
        _id(F.lit("package"), F.lit("pypi"), F.col("package_name")).alias("package_id"),
        F.sha2(F.concat_ws("\0", "state", setting), 256).alias("config_hash"),
    )
    runs = runs.withColumn("version_id", _id(F.lit("version"), F.col("package_id"), F.col("package_version")))
    runs = scratch.write(runs.withColumn("run_id", _id(F.lit("run"), F.col("version_id"), F.col("config_hash"))), "runs")

    def missing(rows: DataFrame, table: str) -> DataFrame:
        return rows.join(current[table].select("id"), "id", "left_anti")

    packages_ins = missing(runs.select(F.col("package_id").alias("id"), F.lit("pypi").alias("ecosystem"), F.col("package_name").alias("name"), at.alias("created_at"), at.alias("updated_at")).distinct(), "packages")
    versions_ins = missing(runs.select(F.col("version_id").alias("id"), "package_id", "package_version", F.lit("completed").alias("status"), at.alias("created_at"), at.alias("updated_at")), "documentation_versions")
    runs_ins = missing(runs.select(F.col("run_id").alias("id"), F.col("version_id").alias("documentation_version_id"), "config_hash", F.lit("completed").alias("status"), at.alias("started_at"), at.alias("completed_at")), "pipeline_runs")

    docs = docs.join(runs.select(*version_key, "version_id", "run_id"), version_key)
    docs = docs.withColumn("source_id", _id(F.lit("source"), F.col("version_id"), F.col("canonical_url")))
    sources_ins = missing(
        docs.select(
            F.col("source_id").alias("id"), F.col("version_id").alias("documentation_version_id"), F.lit("documentation").alias("source_type"), "url", "canonical_url",
            F.lit("verified").alias("confirmation_status"), F.lit("pipeline").alias("confirmed_by"), at.alias("confirmed_at"),
        ),
        "sources",
    )
    present = current["source_documents"].where("is_current").select(
        F.col("source_id").alias("cs"), F.col("canonical_url").alias("cu"), F.col("id").alias("current_id"), F.col("normalized_content_hash").alias("current_hash")
    )
    compared = docs.join(present, (F.col("source_id") == F.col("cs")) & (F.col("canonical_url") == F.col("cu")), "left")
    same = F.col("current_hash").eqNullSafe(F.col("normalized_content_hash"))
    compared = compared.withColumn("reused", same).withColumn(
        "document_id",
        F.when(same, F.col("current_id")).otherwise(
            _id(F.lit("document"), F.col("source_id"), F.col("normalized_content_hash"), F.coalesce("current_id", F.lit("")))
        ),
    )
    compared = scratch.write(compared, "compared")
    fresh = compared.where(~F.col("reused"))
    default = F.create_map(F.lit("reconstructed"), F.lit("true"))
    docs_ins = fresh.select(
        F.col("document_id").alias("id"), "source_id", F.col("run_id").alias("pipeline_run_id"), "url", "canonical_url", "page_title",
        F.coalesce("status_code", F.lit(200)).alias("http_status"), "framework", sha256(F.coalesce("html", "markdown")).alias("raw_content_hash"),
        "normalized_content_hash", F.col("markdown").alias("normalized_markdown"),
        F.when(F.col("html").isNull() & F.col("metadata").isNull(), default).otherwise(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("fetch_metadata"),
        at.alias("fetched_at"), F.lit(True).alias("is_current"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("current_id").alias("supersedes_id"),
    )
    docs_closed = fresh.where("current_id is not null").select(F.col("current_id").alias("id"))

    owner = compared.select(*[F.col(c).alias(f"d_{c}") for c in (*version_key, "url")], "document_id", "normalized_content_hash")
    rows = chunks.withColumn("package_name", normalize_package_name(F.col("package"))).join(
        owner,
        (F.col("package_name") == F.col("d_package_name")) & (F.col("version") == F.col("d_package_version")) & (F.col("source_url") == F.col("d_url")),
    )
    stored = rows.select(
        stored_chunk_id(F.col("id"), F.col("normalized_content_hash")).alias("id"), F.col("document_id").alias("source_document_id"), "package_name",
        F.col("version").alias("package_version"), "source_url", "page_title", "header_path", "chunk_index", "content", "content_hash", "character_count",
    ).dropDuplicates(["source_document_id", "id"])
    known = current["chunks"].select(F.col("id").alias("kid"), F.col("source_document_id").alias("kdoc"))
    marked = stored.join(known, (F.col("id") == F.col("kid")) & (F.col("source_document_id") == F.col("kdoc")), "left")
    marked = scratch.write(marked, "chunks")
    chunks_ins = marked.where("kid is null").select(*stored.columns)

    # Three aggregates over the tables just written: runs, documents with their sources, chunks.
    def known_of(column: str, table: str) -> DataFrame:
        return current[table].select(F.col("id").alias(column), F.lit(True).alias(f"has_{column}"))

    old = runs
    for column, table in (("package_id", "packages"), ("version_id", "documentation_versions"), ("run_id", "pipeline_runs")):
        old = old.join(known_of(column, table), column, "left")
    by_run = old.agg(
        F.count_distinct(F.when(F.col("has_package_id").isNull(), F.col("package_id"))).alias("packages_inserted"),
        F.count_if(F.col("has_version_id").isNull()).alias("versions_inserted"), F.count_if(F.col("has_run_id").isNull()).alias("runs_inserted"),
    )
    by_document = compared.join(known_of("source_id", "sources"), "source_id", "left").agg(
        F.count_if(F.col("has_source_id").isNull()).alias("sources_inserted"), F.count("has_source_id").alias("sources_reused"),
        F.count_if(~F.col("reused")).alias("documents_inserted"), F.count_if("reused").alias("documents_reused"),
    )
    by_chunk = marked.agg(F.count_if(F.col("kid").isNull()).alias("chunks_inserted"), F.count("kid").alias("chunks_reused"))
    counted = [one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns]))) for one in (by_run, by_document, by_chunk)]
    names = [c for one in (by_run, by_document, by_chunk) for c in one.columns]
    metrics = reduce(DataFrame.unionByName, counted).agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    return {
        "packages_ins": packages_ins, "versions_ins": versions_ins, "runs_ins": runs_ins, "sources_ins": sources_ins, "docs_ins": docs_ins,
        "docs_closed": docs_closed, "chunks_ins": chunks_ins, "runs_done": runs.select(F.col("run_id").alias("id")),
        "versions_done": runs.select(F.col("version_id").alias("id")), "metrics": metrics,
    }


def apply_lineage(current: Tables, plan: Tables, now: datetime) -> Tables:
    """The store's tables after an import."""
    at = _instant(now)

    def touched(table: DataFrame, ids: DataFrame, changes: dict[str, Column]) -> DataFrame:
        marked = table.join(ids.select(F.col("id").alias("__t")).distinct(), F.col("id") == F.col("__t"), "left")
        hit = F.col("__t").isNotNull()
        return marked.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changes.items()}).select(*table.columns)

    out = dict(current)
    out["packages"] = current["packages"].unionByName(plan["packages_ins"])
    out["documentation_versions"] = touched(current["documentation_versions"], plan["versions_done"], {"status": F.lit("completed"), "updated_at": at}).unionByName(plan["versions_ins"])
    out["pipeline_runs"] = touched(current["pipeline_runs"], plan["runs_done"], {"status": F.lit("completed"), "completed_at": at}).unionByName(plan["runs_ins"])
    out["sources"] = current["sources"].unionByName(plan["sources_ins"])
    out["source_documents"] = touched(current["source_documents"], plan["docs_closed"], {"is_current": F.lit(False), "valid_to": at}).unionByName(plan["docs_ins"])
    out["chunks"] = current["chunks"].unionByName(plan["chunks_ins"])
    return out


class SnapshotStore:
    """The tables of ``schemas.TABLES`` as folders of files, and the manifests that say which folders count.

    A commit writes what is new and nothing else: rows added to a table are one
    more folder, superseded document revisions are rows (id, valid_to) of their
    own that a reader applies, and only the tables of versions and runs, one row
    for each import, are replaced. ``compact`` folds all that into one folder a
    table, ``vacuum`` deletes what no recent commit names. Readers are never
    disturbed: see ``plans.manifest``. Large tables are partitioned by package
    and version where they have them.
    """

    CLOSED = "id STRING, valid_to TIMESTAMP"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, root)

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        kind = StructType.fromDDL(self.CLOSED) if name == "closed" else schema(name)
        if not folders:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{f}" for f in folders])
        return rows.select(*kind.names)

    def _write(self, name: str, number: int, df: DataFrame) -> str:
        names = StructType.fromDDL(self.CLOSED).names if name == "closed" else schema(name).names
        by = [c for c in ("package_name", "package_version") if c in names]
        folder = f"{name}/commit={number:09d}-{uuid.uuid4().hex[:8]}"
        writer = df.select(*names).write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{folder}")
        return folder

    def _tables(self, content: dict[str, list[str]]) -> Tables:
        found = {name: self._load(name, content.get(name, [])) for name in TABLES}
        if content.get("closed"):
            documents = found["source_documents"]
            ended = self._load("closed", content["closed"]).groupBy(F.col("id").alias("__id")).agg(F.min("valid_to").alias("__end"))
            joined = documents.join(ended, F.col("id") == F.col("__id"), "left")
            over = F.col("__id").isNotNull()
            changes = {"is_current": F.col("is_current") & ~over, "valid_to": F.coalesce("valid_to", "__end")}
            found["source_documents"] = joined.withColumns(changes).select(*documents.columns)
        return found

    def read(self, number: int | None = None) -> Tables:
        """All tables as of a commit, by default the last; those without rows are empty."""
        return self._tables(self.manifest.read(number)[1])

    def append(self, added: Tables, replaced: Tables | None = None, closed: DataFrame | None = None, verify: bool = True) -> int:
        """Commit new rows, replaced tables and superseded revisions (``CLOSED``); the commit's number.

        With ``verify`` the constraints are checked for what is new before it
        counts; a violation is a ValueError, and the store stays as it was.
        """
        last, content = self.manifest.read()
        number, content = last + 1, {k: list(v) for k, v in content.items()}
        fresh: Tables = {}
        for name, df in {**added, **(replaced or {}), **({"closed": closed} if closed is not None else {})}.items():
            folder = self._write(name, number, df)
            content[name] = [folder] if replaced and name in replaced else [*content.get(name, []), folder]
            fresh[name] = self._load(name, [folder])
        if verify:
            constraints.require(constraints.store_violations(self._tables(content), fresh))
        self.manifest.publish(number, content)
        return number

    def compact(self) -> int:
        """Commit each table as one folder, superseded revisions applied."""
        tables = self.read()
        last, content = self.manifest.read()
        self.manifest.publish(last + 1, {n: [self._write(n, last + 1, tables[n])] for n in TABLES if content.get(n)})
        return last + 1

    def vacuum(self, keep: int = 10) -> None:
        """Delete the files that none of the last ``keep`` commits names."""
        self.manifest.forget(keep, lambda content: [f for folders in content.values() for f in folders])


def import_frames(store: SnapshotStore, documents: DataFrame, chunks: DataFrame, now: datetime | None = None, config: ChunkingConfig | None = None) -> dict[str, int]:
    """Plan, write and commit an import; returns its counters. Without documents or chunks it is an error."""
    if documents.isEmpty() or chunks.isEmpty():
        raise ValueError("an import needs documents and their chunks")
    now = now or datetime.now(UTC)
    current = store.read()
    plan = plan_lineage(current, documents, chunks, now, config)
    counters = plan["metrics"].first().asDict()
    after = apply_lineage(current, plan, now)
    added = {table: plan[f"{short}_ins"] for table, short in ADDED.items()}
    closed = plan["docs_closed"].withColumn("valid_to", _instant(now))
    store.append(added, {n: after[n] for n in ("documentation_versions", "pipeline_runs")}, closed)
    return counters
