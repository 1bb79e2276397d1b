from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.config import DatabaseConfig, EmbeddingConfig
from docloom.operators import chunking, constraints, embedding, lineage, snapshot
from docloom.schemas import downgrade, schema, upgrade
from docloom.sources import readers, writers

NOW = datetime(2024, 5, 1, tzinfo=UTC)
DOCS = "package string, version string, title string, url string, markdown string, position long"


def documents(spark, *rows):
    return spark.createDataFrame([("Demo_Pkg", "1.0", t, u, m, i) for i, (t, u, m) in enumerate(rows)], DOCS)


def load(store, docs, day):
    return lineage.import_frames(store, docs, chunking.chunk_documents(docs, order_col="position"), NOW + timedelta(days=day))


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store = lineage.SnapshotStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    first = documents(spark, ("Guide", "https://e.example/g/#top", "# Guide\n\nFirst"))
    second = documents(spark, ("Guide", "https://e.example/g", "# Guide\n\nSecond"))
    return store, [load(store, first, 0), load(store, first, 1), load(store, second, 2), load(store, first, 3)]


def test_revisions_are_inserted_reused_and_superseded(filled):
    store, counts = filled
    assert [(c["documents_inserted"], c["documents_reused"], c["chunks_inserted"], c["chunks_reused"]) for c in counts] == [
        (1, 0, 1, 0), (0, 1, 0, 1), (1, 0, 1, 0), (1, 0, 1, 0),
    ]
    assert [(c["packages_inserted"], c["sources_inserted"], c["sources_reused"]) for c in counts] == [(1, 1, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1)]
    tables = store.read()
    docs = tables["source_documents"].collect()
    assert len(docs) == 3 and sum(d.is_current for d in docs) == 1
    current = next(d for d in docs if d.is_current)
    # Going back to the first text makes a revision of its own, with its own chunk.
    assert tables["chunks"].where(F.col("source_document_id") == current.id).count() == 1
    assert constraints.store_violations(tables).count() == 0
    with pytest.raises(ValueError, match="needs"):
        lineage.import_frames(store, tables["chunks"].limit(0), tables["chunks"].limit(0))


def test_indexing_embeds_only_what_is_missing(spark, filled):
    tables = filled[0].read()
    config, embedder = EmbeddingConfig("local", "hashing", 32), embedding.HashingEmbedder(32)
    embedding.self_check(embedder)
    new, metrics = embedding.index_chunks(tables["chunks"], tables["source_documents"], tables["chunk_embeddings"], config, embedder, "demo-pkg", "1.0")
    assert (metrics.first().chunks_indexed, metrics.first().chunks_reused) == (1, 0)
    _, again = embedding.index_chunks(tables["chunks"], tables["source_documents"], new, config, embedder)
    assert (again.first().chunks_indexed, again.first().chunks_reused) == (0, 1)
    wrong, _ = embedding.index_chunks(tables["chunks"], tables["source_documents"], tables["chunk_embeddings"], EmbeddingConfig("local", "x", 8), embedder)
    with pytest.raises(Exception, match="expected 8"):
        wrong.collect()


def test_snapshot_errors_come_in_order(spark, filled):
    tables = dict(filled[0].read())
    config = EmbeddingConfig("local", "hashing", 32)
    current = tables["source_documents"].where("is_current").first()
    run = current.pipeline_run_id

    def fails(code, package="demo.pkg", run_id=run, **changes):
        with pytest.raises(snapshot.UnusableSnapshot) as caught:
            snapshot.resolve_snapshot(tables | changes, package, "1.0", run_id, config)
        assert caught.value.code == code

    fails("malformed_run_id", run_id="nonsense")
    fails("unknown_run", package="other")
    fails("version_not_completed", documentation_versions=tables["documentation_versions"].withColumn("status", F.lit("running")))
    fails("run_not_completed", pipeline_runs=tables["pipeline_runs"].withColumn("completed_at", F.lit(None).cast("timestamp")))
    fails("no_documents", source_documents=tables["source_documents"].limit(0))
    fails("superseded_documents", source_documents=tables["source_documents"].withColumn("is_current", F.lit(False)))
    fails("no_chunks", chunks=tables["chunks"].limit(0))
    fails("foreign_chunks", chunks=tables["chunks"].withColumn("package_version", F.lit("2")))
    fails("unknown_embedding")
    version = spark.createDataFrame([("ev", "local", "hashing", 32)], schema("embedding_versions"))
    fails("missing_vectors", embedding_versions=version)
    vectors = tables["chunks"].select(F.col("id").alias("chunk_id"), F.lit("ev").alias("embedding_version_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    good = snapshot.resolve_snapshot(tables | {"embedding_versions": version, "chunk_embeddings": vectors}, "Demo_pkg", "1.0", run, config)
    same = snapshot.snapshot_hash("demo-pkg", "1.0", good.documentation_version_id, run, good.chunks.repartition(3))
    assert good.chunk_count >= 1 and good.digest == same
    assert same != snapshot.snapshot_hash("demo-pkg", "1.1", good.documentation_version_id, run, good.chunks)
    assert snapshot.flat_snapshot_hash("a", "1", "v", "r", [("b", "2"), ("a", "1")]) == snapshot.flat_snapshot_hash("A", "1", "v", "r", [("a", "1"), ("b", "2")])


def test_constraints_report_violations(spark):
    tables = upgrade(spark, {})
    assert set(tables) > set(downgrade(tables, "0001")) and "chunk_embeddings" not in downgrade(tables, "0001")
    assert constraints.store_violations(tables).count() == 0
    df = spark.createDataFrame([(1, "a", 5), (1, "a", None), (None, "a", 1), (2, "b", -1)], "k int, s string, n int")
    unique = constraints.unique(df, "t", "u", F.col("k"), F.col("s")).collect()
    assert [r.violating_key for r in unique] == ["1|a"]
    assert [r.violating_key for r in constraints.check(df, "t", "c", F.col("n") > 0, F.col("k")).collect()] == ["2"]
    assert [r.violating_key for r in constraints.foreign_key(df, "t", "f", F.col("k"), spark.createDataFrame([(1,)], "id int"), "id").collect()] == ["2"]
    with pytest.raises(ValueError, match="t.u: 1"):
        constraints.require(constraints.unique(df, "t", "u", F.col("k"), F.col("s")))
    paths = ["guides/a.md", "/absolute.md", "../escape.md", "guides/../../escape.md", "guides\\bad.md", "a.txt", ".md"]
    safe = spark.createDataFrame([(p,) for p in paths], "p string").select(constraints.safe_path(F.col("p"))).collect()
    assert [r[0] for r in safe] == [True] + [False] * 6


def test_chunks_jsonl_round_trip_and_errors(spark, tmp_path):
    docs = documents(spark, ("Ünï", "https://e.example/a", "# A\n\nText ☃"), ("Ünï", "https://e.example/a", "# A\n\nText ☃"))
    chunks = chunking.chunk_documents(docs, order_col="position")
    assert chunks.count() == 1
    path = f"file://{tmp_path}/chunks.jsonl"
    for _ in range(2):
        writers.write_chunks_jsonl(chunks, path, single_file=True)
    assert readers.read_chunks_jsonl(spark, path).collect() == chunks.collect()
    rebuilt = chunking.rebuild_documents(chunking.require_identity(chunks, "Demo_Pkg", "1.0")).first()
    assert rebuilt.markdown == "# A\n\nText ☃" and rebuilt.metadata == {"reconstructed_from": "chunks_jsonl"}
    with pytest.raises(ValueError, match="must match"):
        chunking.require_identity(chunks, "demo-pkg", "1.0")
    bad = tmp_path / "bad.jsonl"
    bad.write_text("\n" + next(p for p in (tmp_path / "chunks.jsonl").glob("part-*")).read_text() + "{broken\n")
    with pytest.raises(ValueError, match="line 3"):
        readers.read_chunks_jsonl(spark, str(bad))
    assert readers.read_chunks_jsonl(spark, str(bad), strict=False).count() == 1
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="No chunks"):
        readers.read_chunks_jsonl(spark, str(tmp_path / "empty.jsonl"))


def test_markdown_files_last_wins(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "one", 0), ("a\\b", "two", 1), ("c", None, 2), (None, "x", 3)], "title string, markdown string, position long")
    assert writers.save_markdown_files(df, str(tmp_path)) == 2
    assert (tmp_path / "a_b.md").read_text() == "two" and (tmp_path / "c.md").read_text() == ""


def test_all_counters_of_two_imports(spark, tmp_path):
    from docloom.operators.queries_retrieval import QUERIES

    before, after = datetime(2024, 5, 1, tzinfo=UTC), datetime(2025, 5, 1, tzinfo=UTC)
    rows = [
        (1, "A", "https://e.example/a", "# A\n\none", "demo", "1.0", before), (2, "B", "https://e.example/b", "# B\n\ntwo", "demo", "1.0", before),
        (3, "A", "https://e.example/a", "# A\n\nthree", "demo", "1.0", after), (4, "C", "https://e.example/c", "# C\n\nfour", "demo", "2.0", after),
        (5, "B", "https://e.example/b", "# B\n\ntwo", "demo", "1.0", after),
    ]
    kind = "page_id long, title string, url string, markdown string, package_name string, package_version string, fetched_at timestamp"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/clean_documents.parquet")
    assert QUERIES["lineage_imports"](spark, str(tmp_path)).first().asDict() == {
        "packages_inserted": 0, "versions_inserted": 1, "runs_inserted": 2, "sources_inserted": 1, "sources_reused": 2,
        "documents_inserted": 2, "documents_reused": 1, "chunks_inserted": 2, "chunks_reused": 1,
    }


def test_a_commit_leaves_readers_alone_and_writes_only_what_is_new(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    store, other = lineage.SnapshotStore(spark, root), lineage.SnapshotStore(spark, root)
    many = documents(spark, *[(f"P{i}", f"https://e.example/{i}", f"# P{i}\n\n" + f"word{i} " * 400) for i in range(60)])
    load(store, many, 0)
    size = {p: p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet")}
    seen, publish = [], store.manifest.publish

    def looking(number, content):
        seen.append(other.read()["source_documents"].where("is_current").count())
        publish(number, content)
        seen.append(other.read()["source_documents"].where("is_current").count())

    monkeypatch.setattr(store.manifest, "publish", looking)
    load(store, documents(spark, ("P1", "https://e.example/1", "# P1\n\nother"), ("New", "https://e.example/n", "# N\n\nnew")), 1)
    assert seen == [60, 61]
    added = {p: p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet") if p not in size}
    assert all(p.exists() for p in size)
    texts = lambda files: sum(v for p, v in files.items() if p.parent.parent.name == "source_documents" or "source_documents" in str(p))
    assert 0 < texts(added) < texts(size)
    docs = {(d.canonical_url, d.is_current): d for d in other.read()["source_documents"].where("canonical_url like '%/1'").collect()}
    assert docs["https://e.example/1", True].supersedes_id == docs["https://e.example/1", False].id and docs["https://e.example/1", False].valid_to
    before = sorted(map(str, other.read()["source_documents"].collect()))
    with pytest.raises(FileExistsError):
        publish(2, {})
    other.compact()
    other.vacuum(keep=1)
    assert sorted(map(str, store.read()["source_documents"].collect())) == before and not any(p.exists() for p in size)
    bad = store.read()["chunks"].limit(1)
    with pytest.raises(ValueError, match="document_index_unique"):
        store.append({"chunks": bad})
    assert store.read()["chunks"].count() == 62


def test_catalog_tables_have_constraints(spark):
    tables = upgrade(spark, {})
    catalogs = spark.createDataFrame([("c", "v", "h", "approved", None, None), ("d", "v", "h", "draft", None, None)], schema("topic_catalogs"))
    topics = spark.createDataFrame([("t", "c", "a.b", "b", "class", "b", "b.md", "t", [], "", -1, "proposed", None), ("u", "x", "a", "a", "thing", "a", "a.md", None, [], "", 0, "proposed", None)], schema("topics"))
    evidence = spark.createDataFrame([("t", "k", "primary", 1, 2.0), ("t", "k", "first", 1, None)], schema("topic_evidence"))
    got = {r.constraint_name for r in constraints.store_violations(tables | {"topic_catalogs": catalogs, "topics": topics, "topic_evidence": evidence}).collect()}
    assert got == {
        "version_exists", "version_config_unique", "approval_is_whole", "catalog_exists", "not_own_parent", "sort_order_not_negative", "kind_allowed",
        "topic_chunk_unique", "topic_rank_unique", "chunk_exists", "role_allowed", "score_in_range",
    }


def test_stage_log_and_settings_of_a_database():
    said = []
    log = writers.StageLog(said.append)
    log.done("Stage", {"rows_read": 3}, "/tmp/x")
    log.next("More")
    assert "".join(said) == "\n[COMPLETED] Stage\n  Rows read: 3\n  Saved at: /tmp/x\n\n[NEXT] More\n"
    database = DatabaseConfig("h", "d", "u")
    assert database.url == "jdbc:postgresql://h:5432/d" and database.options["user"] == "u"
    with pytest.raises(ValueError, match="port"):
        DatabaseConfig("h", "d", "u", port=0)


def test_package_index_and_fetching(spark):
    class Index:
        """Answers of a package index and of pages, without a network."""

        def get(self, url):
            if url.endswith("/demo/json"):
                return 200, url, '{"info": {"project_urls": {"Documentation": "https://d.example/", "Source": null}, "docs_url": "", "home_page": "https://h.example/"}}'
            if url.endswith("/odd/json"):
                return 200, url, "no json"
            if "missing" in url:
                return 404, url, ""
            if "slow" in url:
                raise TimeoutError("late")
            return 200, url, f"<p>{url}</p>"

        def close(self):
            pass

    packages = spark.createDataFrame([("demo", "1"), ("odd", "2"), ("missing", "3"), ("slow", "4"), (None, "5")], "package string, version string")
    got = {r.package: (r.version, r.project_urls, r.docs_url, r.home_page) for r in readers.discover(packages, readers.PackageIndexMetadata(Index)).collect()}
    assert got["demo"] == ("1", {"Documentation": "https://d.example/"}, "", "https://h.example/")
    assert got["odd"] == ("2", {}, None, None) == ("2", *got["missing"][1:]) == ("2", *got["slow"][1:]) and None not in got
    pages = spark.createDataFrame([("A", "https://a.example/1"), ("B", "https://a.example/slow"), ("C", "https://a.example/2")], "title string, url string")
    captured = spark.createDataFrame([("https://a.example/2", "<main>rendered</main>", 200)], "url string, html string, status_code int")
    rows = {r.title: (r.html, r.status_code, r.error, r.metadata.get("fetcher")) for r in readers.pages_by(pages, captured, Index).collect()}
    assert rows["A"] == ("<p>https://a.example/1</p>", 200, None, "http") and rows["C"] == ("<main>rendered</main>", 200, None, "captured")
    assert rows["B"][2] == "Request timed out: late" and len(readers.pages_by(pages, None, Index).collect()) == 3
