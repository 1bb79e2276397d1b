import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import pipeline
from docloom.config import EmbeddingConfig, load_config
from docloom.operators import catalog, embedding, evaluation, lineage, search
from docloom.operators.index import VectorIndex
from docloom.sources import readers, writers
from docloom.streaming import incremental


def test_top_k_is_exact_and_breaks_ties_by_id(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])]
    corpus = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, [1.0])], "query_id long, vector array<float>")
    got = [(r.query_id, r.id, round(r.similarity, 6), r["rank"]) for r in search.top_k(corpus, queries, 2).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1.0, 1), (10, 3, 1.0, 2), (12, 6, 1.0, 1)]
    assert search.top_k(corpus, queries.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="positive"):
        search.top_k(corpus, queries, 0)


def test_rerank_lifts_exact_names_and_scores_relevance(spark):
    hits = spark.createDataFrame(
        [(0, "ToolRuntime class", "a", 0.81, "generic text", "u", "Tools", ["Other"]), (0, "ToolRuntime class", "b", 0.76, "text", "u", "Tools", ["ToolRuntime"])],
        "query_id long, query string, id string, similarity double, content string, source_url string, page_title string, header_path array<string>",
    )
    chunks = hits.select("id", "content", "source_url", "page_title", "header_path")
    ranked = search.rerank(hits.select("query_id", "query", "id", "similarity"), chunks, 1).collect()
    assert [(r.id, r.position) for r in ranked] == [("b", 1)]
    found = search.rerank(hits, chunks.distinct()).withColumn("content", F.lit("see create\\_agent"))
    cases = spark.createDataFrame([(0, "q", ["create_agent"]), (1, "none", ["x"])], "query_id long, query string, expected_any array<string>")
    ranks = evaluation.relevant_ranks(cases, found)
    row = evaluation.evaluate(ranks).first()
    assert (row.query_count, row.hits_at_k, row.hit_rate_at_k, row.mean_reciprocal_rank, row.ranks) == (2, 1, 0.5, 0.5, [1, None])
    empty = evaluation.evaluate(ranks.limit(0)).first()
    assert (empty.query_count, empty.hit_rate_at_k, empty.ranks) == (0, 0.0, [])
    assert evaluation.compare(ranks, ranks).count() == 2


CHUNKS = "id string, content string, source_url string, header_path array<string>, character_count int"
HOME = "https://ref.example/python/demo"


def demo_chunks(spark):
    rows = [
        ("c1", "make_agent builds](/python/demo/agents/factory/make_agent)[Function", f"{HOME}/agents/factory/make_agent", ["make\\_agent"]),
        ("c2", "make_agent](/python/demo/agents/factory/make_agent)[Function", f"{HOME}/agents", ["agents", "make"]),
        ("c3", "Mid wraps](/python/demo/agents/Mid)[Class and](/python/demo/agents/Kind)[Type", f"{HOME}/agents/Mid", ["Mid", "x"]),
        ("c4", "elsewhere](/python/other/x)[Class", f"{HOME}/x", ["x"]),
        ("c5", "broken](/nothing)[Class", f"{HOME}/y", ["y"]),
        ("c6", "# Demo\n\nAll about *demo*.", HOME, ["Demo"]),
        ("c7", "Run it.", f"{HOME}/", ["Demo", "Quick Install"]),
        ("c8", "Concepts of models, at length and in more than fifty characters.", f"{HOME}/models", ["Models"]),
        ("c9", "outside", "https://ref.example/python/demo-community/models", ["Models"]),
        ("c10", "Foo_Bar](/python/demo/agents/Foo_Bar)[Class then](/python/demo/agents/Foo-Bar)[Class", f"{HOME}/z", ["z", "z"]),
    ]
    return spark.createDataFrame([(*r, len(r[1])) for r in rows], CHUNKS)


def test_catalog_of_a_small_package(spark):
    built = catalog.build_catalog(demo_chunks(spark), "Demo")
    topics = {r.qualified_name: r for r in built.topics.collect()}
    assert sorted((r.sort_order, r.kind, n) for n, r in topics.items()) == [
        (0, "module", "demo.agents"), (1, "module", "demo.agents.factory"), (2, "class", "demo.agents.Foo-Bar"), (3, "class", "demo.agents.Foo_Bar"),
        (4, "class", "demo.agents.Mid"), (5, "function", "demo.agents.factory.make_agent"), (6, "concept", "demo.concepts.models"),
        (7, "guide", "demo.guides.overview"), (8, "guide", "demo.guides.quick_install"),
    ]
    listed = {r.qualified_name: r.structural_chunk_ids for r in catalog.with_chunk_ids(built.topics, built.structural).collect()}
    assert listed["demo.agents.factory.make_agent"] == ["c1", "c2"] == listed["demo.agents.factory"]
    assert topics["demo.agents.factory.make_agent"].output_path == "modules/agents/factory/functions/make-agent.md"
    assert topics["demo.agents.Foo-Bar"].output_path == "modules/agents/classes/foo-bar.md"
    assert topics["demo.agents.Foo_Bar"].output_path.startswith("modules/agents/classes/foo-bar-")
    assert topics["demo.guides.overview"].definition == "All about demo."
    row = built.coverage.first()
    assert (row.input_chunks, row.eligible_input_chunks, row.final_topics, row.duplicate_records_merged, row.deferred_symbols) == (10, 9, 9, 1, 1)
    assert row.exclusions_by_reason == {"cross_namespace": 1, "malformed_reference": 1} and row.blocking_issue_count == 0
    assert {(r.code, r.qualified_name) for r in built.issues.collect()} == {("single_short_chunk", "demo.guides.overview"), ("single_short_chunk", "demo.guides.quick_install")}
    again = catalog.build_catalog(demo_chunks(spark).repartition(5).orderBy(F.desc("id")), "demo")
    assert again.topics.orderBy("sort_order").collect() == built.topics.orderBy("sort_order").collect()


def test_semantic_evidence_follows_structural(spark):
    chunks = demo_chunks(spark)

    def hits(topics):
        one = topics.where("qualified_name = 'demo.agents.Mid'").select("key", "kind")
        found = spark.createDataFrame([("c3", 1.0, 1), ("c9", 0.9, 2), ("c6", 1.0000000002, 3)], "chunk_id string, score double, position int")
        return one.join(found)

    built = catalog.build_catalog(chunks, "demo", hits)
    got = built.evidence.where("qualified_name = 'demo.agents.Mid'").orderBy("rank").collect()
    assert [(r.chunk_id, r.role, r["rank"], r.score) for r in got] == [("c3", "primary", 1, None), ("c6", "supporting", 2, 1.0)]


def test_kind_conflicts_and_orphans_are_reported(spark):
    rows = [("a", "x](/python/demo/m/x)[Class", HOME, []), ("b", "x](/python/demo/m/X)[Function", HOME, []), ("c", "y](/python/demo/y)[Class", HOME, None)]
    built = catalog.build_catalog(spark.createDataFrame([(*r, 60) for r in rows], CHUNKS), "demo")
    assert sorted((r.code, r.qualified_name) for r in built.issues.collect()) == [("kind_conflict", "demo.m.x"), ("unknown_parent", "demo.y")]
    assert catalog.build_catalog(spark.createDataFrame([], CHUNKS), "demo").coverage.first().primary_evidence_rate == 0.0


def test_pipeline_and_stream_end_to_end(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "demo.json").write_text('{"info": {"name": "Demo", "version": "9", "project_urls": {"Documentation": "https://d.example/"}}}')
    packages = spark.createDataFrame([("demo", "1.0")], "package string, version string")
    pages = [("https://d.example/", '<a href="/a">A</a><a href="/b">B</a>', 200), ("https://d.example/a", "<main><h1>A</h1><p>alpha</p></main>", 200), ("https://d.example/b", "<h1>B</h1><p>beta</p>", 200)]
    captured = spark.createDataFrame(pages, "url string, html string, status_code int")
    answers = spark.createDataFrame([("https://d.example/", 200, "https://d.example/", None)], "url string, status_code int, final_url string, error string")
    store, said = lineage.SnapshotStore(spark, f"file://{tmp_path}/store"), io.StringIO()
    config, embedder = EmbeddingConfig("local", "hashing", 64), embedding.HashingEmbedder(64)
    provider = readers.CapturedMetadata(spark, f"file://{tmp_path}/meta")
    frames = pipeline.run_pipeline(packages, provider, answers, captured, store, config, embedder, writers.StageLog(said.write))
    assert frames.import_counts["documents_inserted"] == 2 and frames.index_counts["chunks_indexed"] == 2
    assert "[COMPLETED] Crawl planning\n  Pages planned: 2" in said.getvalue() and "[NEXT]" in said.getvalue()
    tables = store.read()
    queries = search.with_vectors(spark.createDataFrame([(0, "alpha")], "query_id long, query string"), embedder)
    hits = search.search(tables["chunks"], tables["chunk_embeddings"], queries, embedding.embedding_version_id(config), limit=1)
    assert "alpha" in hits.first().content

    landing = tmp_path / "landing"
    spark.createDataFrame([("demo", "1.0", "A", "https://d.example/a", "# A\n\nnew alpha")], "package string, version string, title string, url string, markdown string").withColumn(
        "fetched_at", F.current_timestamp()
    ).write.parquet(str(landing))
    stream = incremental.once_within(incremental.arrivals(spark, str(landing)))
    incremental.import_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination(60)
    docs = store.read()["source_documents"]
    assert docs.count() == 3 and docs.where("is_current").count() == 2


def test_configuration_file(tmp_path):
    (tmp_path / "c.yaml").write_text("embedding: {provider: p, model: m, dimension: 8}\nchunking: {max_characters: 50, overlap_characters: 5}\n")
    config = load_config(tmp_path / "c.yaml")
    assert config.chunking.max_characters == 50 and config.embedding.dimension == 8 and config.crawl.max_pages == 10
    (tmp_path / "bad.yaml").write_text("embedding: {provider: p, model: m, dimension: 0}\n")
    with pytest.raises(ValueError, match="dimension"):
        load_config(tmp_path / "bad.yaml")


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.normal(size=(20, 16)), 30, axis=0) + 0.6 * rng.normal(size=(600, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16), (None, [1.0] * 16)]
    corpus = spark.createDataFrame(rows + bad, "id long, vector array<float>").repartition(3)
    queries = corpus.where("id % 20 = 0 or id >= 900").select(F.col("id").alias("query_id"), "vector")
    VectorIndex.build(corpus, f"file://{tmp_path}/index", 16)
    index = VectorIndex(spark.newSession(), f"file://{tmp_path}/index")

    def pairs(df):
        return {(r.query_id, r.id) for r in df.collect()}

    exact = pairs(search.top_k(corpus, queries, 5))
    assert len(pairs(index.top_k(queries, 5, probes=8)) & exact) / len(exact) >= 0.9
    assert exact == pairs(search.top_k(corpus, queries, 5, few=0))
    # The index holds one dimension; a query of another finds nothing there.
    assert pairs(index.top_k(queries, 5, probes=1000)) == {p for p in exact if p[0] != 902}
    some = pairs(index.top_k(queries, 5, probes=1000, allowed=corpus.where("id % 2 = 1").select("id")))
    assert some == pairs(search.top_k(corpus.where("id % 2 = 1"), queries, 5))
    one = spark.createDataFrame([(5000, rows[40][1])], "id long, vector array<float>")
    index.add(one)
    assert (40, 5000) in pairs(index.top_k(queries, 2))
    assert index.top_k(queries.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        index.top_k(queries, 0)
    empty = VectorIndex.build(corpus.limit(0), f"file://{tmp_path}/empty", 16)
    assert empty.top_k(queries, 3).count() == 0
    chunks = corpus.where("id is not null").select(F.col("id").cast("string").alias("id"), F.lit("text").alias("content"), F.lit("u").alias("source_url"), F.lit("t").alias("page_title"), F.array().cast("array<string>").alias("header_path"))
    named = VectorIndex.build(corpus.select(F.col("id").cast("string").alias("id"), "vector"), f"file://{tmp_path}/named", 16)
    hits = search.search(chunks, None, queries.withColumn("query", F.lit("text")), None, limit=3, index=named)
    assert {r.query_id for r in hits.collect()} == {i for i in range(0, 600, 20)}


def test_many_queries_meet_the_corpus_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))] + [("c000x", [0.0] * 8), ("c001x", [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "id string, vector array<float>")
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "query_id long, vector array<float>")
    few = search.top_k(corpus, queries, 4).select("query_id", "id", "rank").collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 50)
    monkeypatch.setattr(search, "CORPUS_PART", 70)
    assert sorted(search.top_k(corpus, queries, 4, few=10).select("query_id", "id", "rank").collect()) == sorted(few)
    assert len(few) == 300 * 4 + 1


def test_proposals_and_evidence_of_hot_topics(spark):
    topics = [("a.b", None, "x.md"), ("A.B", None, "y.md"), ("p", "q", "X.md"), ("q", "r", "1.md"), ("r", "q", "2.md"), ("s", "s", "3.md"), ("t", "gone", "4.md")]
    df = spark.createDataFrame(topics, "qualified_name string, parent_qualified_name string, output_path string")
    got = sorted((r.code, r.qualified_name) for r in catalog.proposal_issues(df).collect())
    assert got == [("own_parent", "s"), ("parent_cycle", "q"), ("parent_cycle", "r"), ("shared_name", "A.B"), ("shared_path", "X.md"), ("unknown_parent", "t")]
    assert [r.code for r in catalog.proposal_issues(df.limit(0)).collect()] == ["no_topics"]
    # A topic that very many chunks name keeps all of them, and its evidence is the first eight.
    rows = [(f"c{i:04}", f"Hot x{i}](/python/demo/Hot)[Class", f"{HOME}/Hot", ["Hot"], 60) for i in range(500)]
    built = catalog.build_catalog(spark.createDataFrame(rows, CHUNKS), "demo")
    assert built.structural.where("key = 'demo.hot'").count() == 500
    assert [r.chunk_id for r in built.evidence.orderBy("rank").collect()] == [f"c{i:04}" for i in (100, 101, 102, 103, 104, 105, 106, 107)]
