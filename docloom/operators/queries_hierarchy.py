"""Registered queries of the hierarchy operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.hierarchy import ancestors, build_hierarchy, descendants


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"))
    return nodes.select(
        F.col("node_id").alias("topic_id"), F.col("root_id").alias("root_topic_id"), F.col("depth").cast("int").alias("depth")
    )


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"), with_path=True)
    return nodes.where("range_start is not null").select(
        F.col("group_id").alias("catalog_id"),
        F.col("node_id").alias("topic_id"),
        F.array_join("path", " > ").alias("full_path"),
        F.col("depth").cast("int").alias("depth"),
        F.col("root_id").alias("root_topic_id"),
        (F.col("range_end") - F.col("range_start") - 1).alias("descendant_count"),
    )


def p1_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every topic."""
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"))
    pairs = descendants(nodes, nodes.select("node_id"))
    return pairs.select(F.col("node_id").alias("topic_id"), F.col("descendant_id").alias("descendant_topic_id"), "distance")


def p1_all_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every topic."""
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"))
    pairs = ancestors(nodes, nodes.select("node_id"))
    return pairs.select(F.col("node_id").alias("topic_id"), F.col("ancestor_id").alias("ancestor_topic_id"), "distance")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for some topics only, those whose id is divisible by 20; ``p1_all_descendants`` has all."""
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"))
    pairs = descendants(nodes, nodes.where("node_id % 20 = 0").select("node_id"))
    return pairs.select(F.col("node_id").alias("topic_id"), F.col("descendant_id").alias("descendant_topic_id"), "distance")


def p1_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for some topics only, those whose id is divisible by 20; ``p1_all_ancestors`` has all."""
    nodes = build_hierarchy(spark.read.parquet(f"{sf_dir}/topics.parquet"))
    pairs = ancestors(nodes, nodes.where("node_id % 20 = 0").select("node_id"))
    return pairs.select(F.col("node_id").alias("topic_id"), F.col("ancestor_id").alias("ancestor_topic_id"), "distance")


QUERIES = {
    "p1_found": p1_found, "p1_paths": p1_paths, "p1_all_descendants": p1_all_descendants, "p1_all_ancestors": p1_all_ancestors,
    "p1_descendants": p1_descendants, "p1_ancestors": p1_ancestors,
}

_NAMES = r"""
WITH RECURSIVE named AS (
  SELECT catalog_id, topic_id, updated_at,
         trim(regexp_replace(qualified_name, '[`\\]', '', 'g')) AS name,
         nullif(lower(trim(regexp_replace(qualified_name, '[`\\]', '', 'g'), E' \t\r\n')), '') AS k,
         nullif(lower(trim(regexp_replace(parent_qualified_name, '[`\\]', '', 'g'), E' \t\r\n')), '') AS pk
  FROM topics),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id, k ORDER BY updated_at DESC NULLS LAST, topic_id DESC) AS rn
                 FROM named WHERE k IS NOT NULL) WHERE rn = 1),
linked AS (
  SELECT c.catalog_id, c.topic_id, c.name, p.topic_id AS parent_id
  FROM latest c LEFT JOIN latest p ON c.catalog_id IS NOT DISTINCT FROM p.catalog_id AND c.pk = p.k),
down AS (
  SELECT topic_id, topic_id AS root_topic_id, 0 AS depth, name AS full_path, catalog_id FROM linked WHERE parent_id IS NULL
  UNION ALL
  SELECT l.topic_id, d.root_topic_id, d.depth + 1, d.full_path || ' > ' || l.name, l.catalog_id
  FROM linked l JOIN down d ON l.parent_id = d.topic_id)"""

_PAIRS = """,
up AS (
  SELECT l.topic_id, l.parent_id AS ancestor_id, 1 AS distance FROM linked l JOIN down d ON d.topic_id = l.topic_id WHERE l.parent_id IS NOT NULL
  UNION ALL
  SELECT u.topic_id, l.parent_id, u.distance + 1 FROM up u JOIN linked l ON l.topic_id = u.ancestor_id WHERE l.parent_id IS NOT NULL)"""

ORACLES = {
    "p1_found": _NAMES
    + """,
lost AS (SELECT topic_id, parent_id FROM linked WHERE topic_id NOT IN (SELECT topic_id FROM down)),
walk AS (
  SELECT topic_id AS origin, parent_id AS place FROM lost
  UNION
  SELECT w.origin, l.parent_id FROM walk w JOIN lost l ON l.topic_id = w.place)
SELECT topic_id, root_topic_id, depth::INT AS depth FROM down
UNION ALL
SELECT topic_id, -1::BIGINT, CASE WHEN topic_id IN (SELECT origin FROM walk WHERE origin = place) THEN -1 ELSE -2 END::INT FROM lost""",
    "p1_paths": _NAMES
    + _PAIRS
    + """
SELECT d.catalog_id, d.topic_id, d.full_path, d.depth::INT AS depth, d.root_topic_id, count(u.topic_id)::BIGINT AS descendant_count
FROM down d LEFT JOIN up u ON u.ancestor_id = d.topic_id GROUP BY ALL""",
    "p1_all_descendants": _NAMES
    + _PAIRS
    + """
SELECT ancestor_id AS topic_id, topic_id AS descendant_topic_id, distance::INT AS distance FROM up""",
    "p1_all_ancestors": _NAMES
    + _PAIRS
    + """
SELECT topic_id, ancestor_id AS ancestor_topic_id, distance::INT AS distance FROM up""",
    "p1_descendants": _NAMES
    + _PAIRS
    + """
SELECT ancestor_id AS topic_id, topic_id AS descendant_topic_id, distance::INT AS distance FROM up WHERE ancestor_id % 20 = 0""",
    "p1_ancestors": _NAMES
    + _PAIRS
    + """
SELECT topic_id, ancestor_id AS ancestor_topic_id, distance::INT AS distance FROM up WHERE topic_id % 20 = 0""",
}
