"""Registered queries of the topic catalog, constraints and snapshots, and their SQL.

The chunks of the catalog queries are made from the topics table: each topic row
becomes a chunk whose text ends in a reference to the topic, as API pages have
them. Modules, classes and functions become topics, concepts and guides stand for
types and constants. Two of three catalogs are taken to describe one package; the
names of the others are references elsewhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS
from docloom.operators import catalog, constraints
from docloom.operators.embedding import embed_column
from docloom.operators.queries_hierarchy import ORACLES as HIERARCHY
from docloom.operators.queries_retrieval import _words
from docloom.plans.digests import set_digest
from docloom.plans.shared import Scratch

PACKAGE = "zuvelgraph"
_MARKERS = {"module": "Module", "class": "Class", "function": "Function", "concept": "Type", "guide": "Constant"}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _t(spark, sf_dir, "topics").where("qualified_name is not null")
    name = F.regexp_replace(F.regexp_replace("qualified_name", r"[`\\]", ""), r"^\s+|\s+$", "")
    name = F.when(F.col("catalog_id") % 3 != 0, F.regexp_replace(name, r"^[^.]+", PACKAGE)).otherwise(name)
    last = F.element_at(F.split(name, r"\."), -1)
    kind = F.when(F.col("topic_id") % 11 == 0, "function").otherwise(F.col("kind"))
    marker = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in _MARKERS.items()], F.lit("Type"))
    content = F.concat(last, F.lit(" - "), F.coalesce("summary", F.lit("")), F.lit(" ](/python/"), F.replace(name, F.lit("."), F.lit("/")), F.lit(")["), marker, F.lit("]"))
    home = F.when(F.col("topic_id") % 7 == 0, "other").otherwise(PACKAGE)
    url = F.concat(F.lit("https://ref.example/python/"), home, F.lit("/c"), F.col("catalog_id").cast("string"))
    rows = topics.select(F.col("topic_id").cast("string").alias("id"), content.alias("content"), url.alias("source_url"), F.array(last).alias("header_path"))
    return rows.withColumn("character_count", F.length("content")).withColumn("page_title", F.lit("").cast("string"))


def catalog_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).topics
    return topics.select("kind", "qualified_name", "display_name", "canonical_target", "definition", "source_chunk_id")


def catalog_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    deferred = catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).deferred
    return deferred.select("kind", "qualified_name", "owner_qualified_name", "source_chunk_id")


def catalog_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).exclusions.select("reason", "source_chunk_id", "canonical_target", "marker")


def topic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics, structural, _, _ = catalog.merge_topics(catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).topics, PACKAGE)
    merged = catalog.with_chunk_ids(topics, structural)
    return merged.select(
        "kind", "qualified_name", "display_name", "definition", "parent_qualified_name",
        F.array_join("structural_chunk_ids", ",").alias("chunk_ids"), F.array_join("aliases", ",").alias("aliases"),
    )


def kind_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, issues, _ = catalog.merge_topics(catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).topics, PACKAGE)
    return issues.select("code", "qualified_name", "blocking")


def module_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics, structural, _, _ = catalog.merge_topics(catalog.extract(catalog_chunks(spark, sf_dir), PACKAGE).topics, PACKAGE)
    derived = catalog.with_chunk_ids(*catalog.derive_ancestors(topics, structural, PACKAGE))
    return derived.select("qualified_name", "display_name", "canonical_target", "parent_qualified_name", F.array_join("structural_chunk_ids", ",").alias("chunk_ids"))


def curated_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of hand-written pages, normalized: the topics' rows stand for pages of the package's root, its quick install and concept pages."""
    topics = _t(spark, sf_dir, "topics")
    which = F.col("topic_id") % 9
    page = F.element_at(F.array(*[F.lit(x) for x in ("", "/", "", "/agents", "/middleware/", "/models", "/models/deep", "/tools", "/agents")]), (which + 1).cast("int"))
    path = F.when(which == 2, F.array(F.lit("Intro"), F.lit("Quick Install"))).when(which == 8, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.concat(F.lit("## `T "), "slug", F.lit("`"))))
    chunks = topics.select(
        F.col("topic_id").cast("string").alias("id"), F.concat(F.lit("# Head\n\nAbout *"), "slug", F.lit("*.\nMore.")).alias("content"),
        F.concat(F.lit("https://ref.example/python/"), F.when(F.col("topic_id") % 5 == 0, "zuvel").otherwise(PACKAGE), page).alias("source_url"), path.alias("header_path"),
    )
    merged, structural, _, _ = catalog.merge_topics(catalog.extract(chunks, PACKAGE).topics, PACKAGE)
    counted = structural.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.min_by("chunk_id", "place").alias("first_chunk"))
    return merged.join(counted, ["key", "kind"]).select("kind", "qualified_name", "canonical_target", "definition", "chunks", "first_chunk")


def proposal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps all topics' rows, taken as one catalog, from being a proposal."""
    found = catalog.proposal_issues(_t(spark, sf_dir, "topics"))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


def _catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    return catalog.build_catalog(catalog_chunks(spark, sf_dir), PACKAGE)


def catalog_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).topics.select("kind", "qualified_name", "slug", "output_path", "derived", F.col("sort_order").cast("bigint").alias("sort_order"))


def catalog_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).evidence.select("qualified_name", "kind", "chunk_id", "role", F.col("rank").cast("int").alias("rank"))


class LetterEmbedder:
    """Texts as counts of the letters a to z, an embedding that SQL can express, too."""

    dimension = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        lower = [t.lower() for t in texts]
        return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in lower], dtype=np.float32).reshape(len(texts), 26)


def semantic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with what one search a topic finds behind its structural chunks, by letter counts."""
    chunks = Scratch(spark, "semantic").write(catalog_chunks(spark, sf_dir), "chunks")
    vectors = chunks.select(F.col("id").alias("chunk_id"), F.lit(1).alias("embedding_version_id"), embed_column(LetterEmbedder())("content").alias("embedding"))
    built = catalog.build_catalog(chunks, PACKAGE, semantic=catalog.Semantic(vectors, 1, LetterEmbedder()))
    return built.evidence.select("qualified_name", "kind", "chunk_id", "role", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def catalog_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).issues.groupBy("code", "blocking").agg(F.count(F.lit(1)).alias("issues"))


def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _catalog(spark, sf_dir).coverage
    maps = {c: F.to_json(c) for c in ("topics_by_kind", "exclusions_by_reason")}
    rates = {c: F.round(c, 6) for c in ("primary_evidence_rate", "multiple_evidence_rate")}
    return row.withColumns(maps | rates)


def topic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.topic_violations(_t(spark, sf_dir, "topics"))
    return found.groupBy("constraint_name").agg(F.count(F.lit(1)).alias("violations"))


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.chunk_violations(_t(spark, sf_dir, "chunks"), key="load_seq")
    return found.select("constraint_name", "violating_key")


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, references and checks of the order tables and of chunk embeddings."""
    line, orders, parts = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "part")
    vectors, chunks, versions = _t(spark, sf_dir, "chunk_embeddings"), _t(spark, sf_dir, "chunks"), _t(spark, sf_dir, "embedding_versions")
    found = [
        constraints.unique(line, "lineitem", "order_line_unique", F.col("l_orderkey"), F.col("l_linenumber")),
        constraints.foreign_key(line, "lineitem", "order_exists", F.col("l_orderkey"), orders, "o_orderkey"),
        constraints.foreign_key(line, "lineitem", "part_exists", F.col("l_partkey"), parts, "p_partkey"),
        constraints.check(line, "lineitem", "quantity_range", F.col("l_quantity") <= 45, F.col("l_orderkey")),
        constraints.unique(vectors, "chunk_embeddings", "chunk_version_unique", F.col("chunk_id"), F.col("embedding_version_id")),
        constraints.foreign_key(vectors, "chunk_embeddings", "chunk_exists", F.col("chunk_id"), chunks, "chunk_id"),
        constraints.foreign_key(vectors, "chunk_embeddings", "version_exists", F.col("embedding_version_id"), versions, "embedding_version_id"),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("table_name", "constraint_name").agg(F.count(F.lit(1)).alias("violations"))


def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of each package version's set of chunks, whatever their order and repetition."""
    chunks = _t(spark, sf_dir, "chunks")
    return set_digest(chunks, ["package_name", "package_version"], F.concat_ws("\0", "chunk_id", "content_hash"), "digest")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_extraction, catalog_deferred, catalog_exclusions, topic_merge, kind_conflicts, module_ancestors, curated_topics, proposal_problems, catalog_topics, catalog_evidence, semantic_evidence, catalog_issues,
        catalog_coverage, topic_violations, chunk_violations, key_violations, snapshot_digests,
    )
}

_SRC = r"""
WITH RECURSIVE src AS (
  SELECT topic_id::VARCHAR AS id, CASE WHEN topic_id % 11 = 0 THEN 'function' ELSE kind END AS kind, coalesce(summary, '') AS summary, nm, string_split(nm, '.') AS parts, topic_id % 7 <> 0 AS eligible,
         'https://ref.example/python/' || CASE WHEN topic_id % 7 = 0 THEN 'other' ELSE 'zuvelgraph' END || '/c' || catalog_id AS url
  FROM (SELECT *, CASE WHEN catalog_id % 3 <> 0 THEN regexp_replace(n0, '^[^.]+', 'zuvelgraph') ELSE n0 END AS nm
        FROM (SELECT *, trim(regexp_replace(qualified_name, '[`\\]', '', 'g'), E' \t\r\n') AS n0 FROM topics WHERE qualified_name IS NOT NULL))),
ref AS (
  SELECT *, parts[-1] AS display, '/python/' || replace(nm, '.', '/') AS target,
         CASE kind WHEN 'module' THEN 'Module' WHEN 'class' THEN 'Class' WHEN 'function' THEN 'Function' WHEN 'guide' THEN 'Constant' ELSE 'Type' END AS marker,
         CASE WHEN len(parts) < 2 THEN 'malformed_reference'
              WHEN trim(lower(regexp_replace(parts[1], '[-_.]+', '-', 'g')), '-') <> 'zuvelgraph' THEN 'cross_namespace'
              WHEN kind IN ('module', 'class', 'function') THEN 'topic' ELSE 'deferred' END AS fate,
         length(parts[-1] || ' - ' || summary || ' ](/python/' || replace(nm, '.', '/') || ')[]') + length(CASE kind WHEN 'module' THEN 'Module' WHEN 'class' THEN 'Class' WHEN 'function' THEN 'Function' WHEN 'guide' THEN 'Constant' ELSE 'Type' END) AS chars,
         nullif(trim(trim(regexp_replace(regexp_replace(' - ' || summary || ' ', '[`*]', '', 'g'), '\s+', ' ', 'g'), ' :-')), '') AS definition
  FROM src),
rec AS (SELECT *, lower(nm) AS k, row_number() OVER (PARTITION BY lower(nm), kind ORDER BY -(1 + CASE WHEN eligible AND parts[1] = 'zuvelgraph' THEN 1 ELSE 0 END), -length(coalesce(definition, '')), url, id) AS pos
        FROM ref WHERE fate = 'topic'),
conf AS (SELECT k FROM rec GROUP BY k HAVING count(DISTINCT kind) > 1),
mrg AS (
  SELECT k, kind, max(nm) FILTER (WHERE pos = 1) AS qualified_name, max(display) FILTER (WHERE pos = 1) AS display_name, max(definition) FILTER (WHERE pos = 1) AS definition,
         list(id ORDER BY pos) AS ids, list(display ORDER BY pos) AS names, count(*) - 1 AS extra
  FROM rec WHERE k NOT IN (SELECT k FROM conf) GROUP BY k, kind),
top AS (
  SELECT *, CASE WHEN kind IN ('class', 'function') OR len(string_split(qualified_name, '.')) >= 3 THEN regexp_replace(qualified_name, '\.[^.]*$', '') END AS parent,
         CASE kind WHEN 'module' THEN 1 WHEN 'class' THEN 2 ELSE 3 END AS o FROM mrg),
anc AS (
  SELECT array_to_string(string_split(parent, '.')[1:i], '.') AS name, id, p, o, lower(display_name) AS d, k
  FROM (SELECT *, unnest(range(1, len(string_split(parent, '.')) + 1)) AS i FROM top WHERE parent IS NOT NULL) t, LATERAL (SELECT unnest(t.ids) AS id, unnest(range(1, len(t.ids) + 1)) AS p)),
first_anc AS (SELECT name, id, min((o, d, k, p)) AS pl FROM anc WHERE lower(name) <> 'zuvelgraph' GROUP BY name, id),
der AS (
  SELECT name, list(id ORDER BY pl, id) AS ids FROM first_anc WHERE lower(name) NOT IN (SELECT k FROM top) GROUP BY name),
one AS (SELECT name, ids FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY name) AS r FROM der) WHERE r = 1),
every AS (
  SELECT kind, qualified_name, display_name, ids, parent, false AS derived FROM top
  UNION ALL SELECT 'module', name, string_split(name, '.')[-1], ids, nullif(CASE WHEN lower(regexp_replace(name, '\.[^.]*$', '')) = 'zuvelgraph' THEN '' ELSE regexp_replace(name, '\.[^.]*$', '') END, ''), true FROM one),
slg AS (
  SELECT *, CASE kind WHEN 'module' THEN 1 WHEN 'class' THEN 2 ELSE 3 END AS o,
         coalesce(nullif(trim(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'topic') AS s,
         list_transform(string_split(qualified_name, '.')[CASE WHEN lower(string_split(qualified_name, '.')[1]) = 'zuvelgraph' THEN 2 ELSE 1 END:],
           lambda p: coalesce(nullif(trim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'topic')) AS rel FROM every),
pth AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN kind = 'module' THEN 'modules/' || array_to_string(rel, '/') || '/README.md'
      ELSE 'modules/' || array_to_string(rel[:-2], '/') || CASE WHEN kind = 'class' THEN '/classes/' ELSE '/functions/' END || s || '.md' END
    ORDER BY o, lower(display_name), lower(qualified_name), qualified_name) AS n FROM slg),
fin AS (
  SELECT *, CASE WHEN kind = 'module' THEN 'modules/' || array_to_string(rel, '/') || '/README.md'
      ELSE 'modules/' || array_to_string(rel[:-2], '/') || CASE WHEN kind = 'class' THEN '/classes/' ELSE '/functions/' END || slug || '.md' END AS output_path
  FROM (SELECT *, CASE WHEN n > 1 THEN s || '-' || sha256(qualified_name)[:8] ELSE s END AS slug FROM pth)),
ev AS (
  SELECT * FROM (SELECT f.qualified_name, f.kind, u.id AS chunk_id, row_number() OVER (PARTITION BY f.qualified_name, f.kind ORDER BY u.p)::INT AS rank, r.chars
    FROM fin f, LATERAL (SELECT unnest(f.ids) AS id, unnest(range(1, len(f.ids) + 1)) AS p) u JOIN ref r ON r.id = u.id WHERE r.eligible) WHERE rank <= 8),
per AS (SELECT f.qualified_name, f.kind, count(e.chunk_id) AS n, min(e.chars) AS shortest FROM fin f LEFT JOIN ev e USING (qualified_name, kind) GROUP BY ALL),
coll AS (SELECT count(*) - count(DISTINCT lower(output_path)) AS n FROM fin)"""

_LETTERS = "list_transform(range(97, 123), lambda x: (length(lower({0})) - length(replace(lower({0}), chr(x::INT), '')))::DOUBLE)"

ORACLES = {
    "catalog_extraction": _SRC + "\nSELECT kind, nm AS qualified_name, display AS display_name, target AS canonical_target, definition, id AS source_chunk_id FROM ref WHERE fate = 'topic'",
    "catalog_deferred": _SRC
    + "\nSELECT lower(marker) AS kind, nm AS qualified_name, array_to_string(parts[:-2], '.') AS owner_qualified_name, id AS source_chunk_id FROM ref WHERE fate = 'deferred'",
    "catalog_exclusions": _SRC + "\nSELECT fate AS reason, id AS source_chunk_id, target AS canonical_target, marker FROM ref WHERE fate IN ('malformed_reference', 'cross_namespace')",
    "topic_merge": _SRC
    + """
SELECT kind, qualified_name, display_name, definition, parent AS parent_qualified_name, array_to_string(ids, ',') AS chunk_ids,
       array_to_string(list_filter(names, lambda x, i: lower(x) <> lower(display_name) AND NOT list_contains(list_transform(names[1:i - 1], lambda y: lower(y)), lower(x))), ',') AS aliases FROM top""",
    "kind_conflicts": _SRC + "\nSELECT 'kind_conflict' AS code, k AS qualified_name, true AS blocking FROM conf",
    "module_ancestors": _SRC
    + """
SELECT name AS qualified_name, string_split(name, '.')[-1] AS display_name, '/python/' || replace(name, '.', '/') AS canonical_target,
       CASE WHEN lower(regexp_replace(name, '\\.[^.]*$', '')) <> 'zuvelgraph' THEN regexp_replace(name, '\\.[^.]*$', '') END AS parent_qualified_name, array_to_string(ids, ',') AS chunk_ids FROM one""",
    "catalog_topics": _SRC
    + "\nSELECT kind, qualified_name, slug, output_path, derived, row_number() OVER (ORDER BY o, lower(display_name), lower(qualified_name), qualified_name) - 1 AS sort_order FROM fin",
    "catalog_evidence": _SRC + "\nSELECT qualified_name, kind, chunk_id, CASE WHEN rank = 1 THEN 'primary' ELSE 'supporting' END AS role, rank FROM ev",
    "semantic_evidence": _SRC
    + f"""
, chk AS (SELECT *, parts[-1] || ' - ' || summary || ' ](/python/' || replace(nm, '.', '/') || ')[' || marker || ']' AS content FROM ref),
cv AS (SELECT id, url, eligible, {_LETTERS.format("content")} AS v, string_split({_words("parts[-1]")}, ' ') AS h, {_words("parts[-1]")} AS hs, string_split({_words("content")}, ' ') AS c, {_words("content")} AS cs,
         string_split({_words("url")}, ' ') AS u FROM chk),
fq AS (SELECT f.qualified_name, f.kind, f.qualified_name || ' ' || f.display_name || ' ' || f.kind || coalesce(' ' || t.definition, '') AS q FROM fin f LEFT JOIN top t ON t.kind = f.kind AND t.qualified_name = f.qualified_name),
qv AS (SELECT *, {_LETTERS.format("q")} AS v, list_filter(string_split({_words("q")}, ' '), lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS terms FROM fq),
sim AS (SELECT q.qualified_name, q.kind, q.terms, c.*, least(1.0, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 12)) AS s FROM qv q, cv c),
near AS (SELECT *, row_number() OVER (PARTITION BY qualified_name, kind ORDER BY s DESC, id) AS r FROM sim QUALIFY r <= 128),
lex AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0 ELSE least(1.0::DOUBLE, list_sum(list_transform(terms, lambda t: CASE WHEN list_contains(h, t) THEN 1.0::DOUBLE WHEN list_contains(c, t) THEN 0.55::DOUBLE WHEN list_contains(u, t) THEN 0.35::DOUBLE ELSE 0::DOUBLE END)) / len(terms)
   + CASE WHEN len(terms) < 2 THEN 0 WHEN contains(hs, array_to_string(terms, ' ')) THEN 0.25::DOUBLE WHEN contains(cs, array_to_string(terms, ' ')) THEN 0.15::DOUBLE ELSE 0 END) END AS l FROM near),
hit AS (SELECT *, 0.85::DOUBLE * s + 0.15::DOUBLE * l AS score, row_number() OVER (PARTITION BY qualified_name, kind ORDER BY 0.85::DOUBLE * s + 0.15::DOUBLE * l DESC, s DESC, id) AS pos FROM lex QUALIFY pos <= 16),
two AS (SELECT qualified_name, kind, chunk_id, 0 AS o, rank AS pl, NULL::DOUBLE AS score FROM ev
  UNION ALL SELECT qualified_name, kind, id, 1, pos, score FROM hit h WHERE eligible AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.qualified_name = h.qualified_name AND e.kind = h.kind AND e.chunk_id = h.id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qualified_name, kind ORDER BY o, pl)::INT AS rank FROM two)
SELECT qualified_name, kind, chunk_id, CASE WHEN rank = 1 AND o = 0 THEN 'primary' ELSE 'supporting' END AS role, rank, CASE WHEN score IS NOT NULL THEN round(greatest(-1.0, least(1.0, score)), 6) END AS score FROM ranked WHERE rank <= 8""",
    "curated_topics": r"""
WITH c AS (SELECT topic_id::VARCHAR AS id, topic_id % 9 AS w, slug, 'https://ref.example/python/zuvelgraph' || ['', '/', '', '/agents', '/middleware/', '/models', '/models/deep', '/tools', '/agents'][(topic_id % 9 + 1)::INT] AS url FROM topics WHERE topic_id % 5 <> 0),
k AS (SELECT *, CASE WHEN w IN (0, 1, 2) THEN 'guide' ELSE 'concept' END AS kind, CASE w WHEN 0 THEN 'guides.overview' WHEN 1 THEN 'guides.overview' WHEN 2 THEN 'guides.quick_install' WHEN 3 THEN 'concepts.agents' WHEN 4 THEN 'concepts.middleware' WHEN 5 THEN 'concepts.models' END AS name,
        '/python/zuvelgraph' || CASE w WHEN 2 THEN '#quick-install' WHEN 3 THEN '/agents' WHEN 4 THEN '/middleware' WHEN 5 THEN '/models' ELSE '' END AS target, 'About ' || slug || '.' AS definition FROM c WHERE w <= 5 AND (slug IS NOT NULL OR w = 2)),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(coalesce(definition, '')) DESC, url, id) AS n FROM k)
SELECT kind, 'zuvelgraph.' || name AS qualified_name, max(target) AS canonical_target, max(definition) FILTER (WHERE n = 1) AS definition, count(*)::BIGINT AS chunks, max(id) FILTER (WHERE n = 1) AS first_chunk FROM o GROUP BY 1, 2""",
    "proposal_problems": r"""
WITH RECURSIVE t AS (SELECT lower(qualified_name) AS k, lower(parent_qualified_name) AS p, lower(output_path) AS o FROM topics),
e AS (SELECT k, arg_max(p, sha256(p)) AS p FROM t WHERE p IS NOT NULL AND k IS NOT NULL GROUP BY k),
w AS (SELECT k AS origin, p AS place FROM e UNION SELECT w.origin, e.p FROM w JOIN e ON e.k = w.place),
v AS (SELECT 'shared_name' AS code FROM t WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'shared_path' FROM t WHERE o IS NOT NULL GROUP BY o HAVING count(*) > 1
  UNION ALL SELECT 'unknown_parent' FROM t WHERE p IS NOT NULL AND p NOT IN (SELECT k FROM t WHERE k IS NOT NULL)
  UNION ALL SELECT 'own_parent' FROM t WHERE p = k
  UNION ALL SELECT 'parent_cycle' FROM t WHERE p <> k AND k IN (SELECT origin FROM w WHERE origin = place))
SELECT code, count(*)::BIGINT AS issues FROM v GROUP BY 1""",
    "catalog_issues": _SRC
    + """
SELECT code, blocking, count(*)::BIGINT AS issues FROM (
  SELECT 'kind_conflict' AS code, true AS blocking FROM conf
  UNION ALL SELECT 'path_collision', true FROM (SELECT unnest(range(n)) FROM coll)
  UNION ALL SELECT 'missing_primary_evidence', true FROM per WHERE n = 0
  UNION ALL SELECT 'single_short_chunk', false FROM per WHERE n = 1 AND shortest < 50
  UNION ALL SELECT 'unknown_parent', true FROM fin WHERE parent IS NOT NULL AND lower(parent) NOT IN (SELECT lower(qualified_name) FROM fin)
  UNION ALL SELECT 'own_parent', true FROM fin WHERE lower(parent) = lower(qualified_name)) GROUP BY ALL""",
    "catalog_coverage": _SRC
    + """,
t AS (SELECT count(*) AS n FROM fin), b AS (SELECT (SELECT count(*) FROM conf) + (SELECT n FROM coll) + (SELECT count(*) FROM per WHERE n = 0) AS n)
SELECT (SELECT count(DISTINCT id) FROM ref)::BIGINT AS input_chunks, (SELECT count(DISTINCT id) FROM ref WHERE eligible)::BIGINT AS eligible_input_chunks,
  (SELECT count(*) FROM rec)::BIGINT AS raw_topic_records, t.n::BIGINT AS final_topics, (SELECT coalesce(sum(extra), 0) FROM mrg)::BIGINT AS duplicate_records_merged,
  (SELECT count(*) FROM ref WHERE fate = 'deferred')::BIGINT AS deferred_symbols, (SELECT count(*) FROM per WHERE n > 0)::BIGINT AS topics_with_primary_evidence,
  (SELECT count(*) FROM per WHERE n >= 2)::BIGINT AS topics_with_multiple_evidence, (SELECT count(DISTINCT chunk_id) FROM ev)::BIGINT AS evidence_chunk_coverage,
  ((SELECT count(DISTINCT id) FROM ref WHERE eligible) - (SELECT count(DISTINCT chunk_id) FROM ev))::BIGINT AS unused_input_chunks,
  b.n::BIGINT AS blocking_issue_count, (SELECT count(*) FROM per WHERE n = 1 AND shortest < 50)::BIGINT AS warning_count,
  (SELECT coalesce('{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}', '{}') FROM (SELECT kind, count(*) AS n FROM fin GROUP BY 1)) AS topics_by_kind,
  (SELECT coalesce('{' || string_agg('"' || fate || '":' || n, ',' ORDER BY fate) || '}', '{}') FROM (SELECT fate, count(*) AS n FROM ref WHERE fate IN ('malformed_reference', 'cross_namespace') GROUP BY 1)) AS exclusions_by_reason,
  round(CASE WHEN t.n > 0 THEN (SELECT count(*) FROM per WHERE n > 0) / t.n ELSE 0 END, 6) AS primary_evidence_rate,
  round(CASE WHEN t.n > 0 THEN (SELECT count(*) FROM per WHERE n >= 2) / t.n ELSE 0 END, 6) AS multiple_evidence_rate
FROM t, b""",
    "topic_violations": rf"""
WITH f AS (SELECT *, list_transform(coalesce(aliases, []), lambda a: lower(trim(a))) AS al, nullif(trim(parent_qualified_name), '') AS par FROM topics), v AS (
  SELECT 'output_path_safe' AS c FROM f WHERE NOT (NOT contains(output_path, '\') AND NOT starts_with(output_path, '/') AND NOT regexp_matches(output_path, '(^|/)\.\.(/|$)') AND regexp_matches(output_path, '[^/]\.md$'))
  UNION ALL SELECT 'slug_form' FROM f WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
  UNION ALL SELECT 'not_own_parent' FROM f WHERE par = qualified_name
  UNION ALL SELECT 'sort_order_not_negative' FROM f WHERE sort_order < 0
  UNION ALL SELECT 'aliases_not_blank' FROM f WHERE list_contains(al, '')
  UNION ALL SELECT 'aliases_unique' FROM f WHERE len(list_distinct(al)) <> len(al)
  UNION ALL SELECT 'kind_allowed' FROM f WHERE kind NOT IN ('module', 'class', 'function', 'concept', 'guide')
  UNION ALL SELECT 'status_allowed' FROM f WHERE status NOT IN ('proposed', 'approved', 'rejected')
  UNION ALL SELECT 'qualified_name_unique' FROM (SELECT 1 FROM f WHERE catalog_id IS NOT NULL AND qualified_name IS NOT NULL GROUP BY catalog_id, lower(qualified_name) HAVING count(*) > 1)
  UNION ALL SELECT 'output_path_unique' FROM (SELECT 1 FROM f WHERE catalog_id IS NOT NULL AND output_path IS NOT NULL GROUP BY catalog_id, lower(output_path) HAVING count(*) > 1)
  UNION ALL SELECT 'parent_exists' FROM f WHERE par IS NOT NULL AND NOT EXISTS (SELECT 1 FROM topics g WHERE g.catalog_id IS NOT DISTINCT FROM f.catalog_id AND lower(g.qualified_name) = lower(f.par))
  UNION ALL SELECT 'parents_acyclic' FROM ({HIERARCHY["p1_found"]}) WHERE depth < 0)
SELECT c AS constraint_name, count(*)::BIGINT AS violations FROM v GROUP BY 1""",
    "chunk_violations": r"""
SELECT 'content_not_blank' AS constraint_name, load_seq::VARCHAR AS violating_key FROM chunks WHERE NOT regexp_matches(coalesce(content, ''), '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
UNION ALL SELECT 'character_count_is_length', load_seq::VARCHAR FROM chunks WHERE character_count <> length(content)""",
    "snapshot_digests": r"""
WITH i AS (SELECT DISTINCT package_name, package_version, sha256(concat_ws(chr(0), chunk_id, content_hash)) AS h FROM chunks),
a AS (SELECT package_name, package_version, h[:4] || sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM i GROUP BY package_name, package_version, h[:4]),
b AS (SELECT package_name, package_version, h[:2] || sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM a GROUP BY package_name, package_version, h[:2])
SELECT package_name, package_version, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM b GROUP BY 1, 2""",
    "key_violations": """
WITH v AS (
  SELECT 'lineitem' AS t, 'order_line_unique' AS c FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'lineitem', 'order_exists' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'lineitem', 'part_exists' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'lineitem', 'quantity_range' FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT 'chunk_embeddings', 'chunk_version_unique' FROM (SELECT 1 FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND embedding_version_id IS NOT NULL GROUP BY chunk_id, embedding_version_id HAVING count(*) > 1)
  UNION ALL SELECT 'chunk_embeddings', 'chunk_exists' FROM (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL))
  UNION ALL SELECT 'chunk_embeddings', 'version_exists' FROM (SELECT DISTINCT embedding_version_id FROM chunk_embeddings WHERE embedding_version_id NOT IN (SELECT embedding_version_id FROM embedding_versions)))
SELECT t AS table_name, c AS constraint_name, count(*)::BIGINT AS violations FROM v GROUP BY 1, 2""",
}
