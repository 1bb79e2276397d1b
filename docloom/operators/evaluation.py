"""Scoring of retrieval: hit rate, mean reciprocal rank, and comparison of two settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import words


def hit_text(title: Column, header_path: Column, url: Column, content: Column) -> Column:
    """All texts of a hit as lower-case words."""
    parts = F.concat(F.array(title), F.coalesce(header_path, F.array().cast("array<string>")), F.array(url, content))
    return words(F.array_join(parts, " "))


def is_relevant(text: Column, expected: Column) -> Column:
    """Whether a hit's text holds one of the expected phrases; an empty phrase is in every text."""
    return F.exists(expected, lambda e: F.contains(text, words(F.replace(e, F.lit("_"), F.lit(" ")))))


def relevant_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query, rank) for each case (query_id, query, expected_any): its first relevant hit, or null."""
    marked = hits.join(cases.select(F.col("query_id").alias("c"), "expected_any"), F.col("query_id") == F.col("c"))
    text = hit_text(F.col("page_title"), F.col("header_path"), F.col("source_url"), F.col("content"))
    found = marked.where(is_relevant(text, F.col("expected_any"))).groupBy(F.col("c").alias("q")).agg(F.min("position").alias("rank"))
    return cases.join(found, F.col("query_id") == F.col("q"), "left").select("query_id", "query", "rank")


def evaluate(ranks: DataFrame, with_ranks: bool = True) -> DataFrame:
    """One row: query_count, hits_at_k, hit_rate_at_k, mean_reciprocal_rank, ranks in the order of query_id.

    Without queries both rates are 0. ``ranks`` lists every case in one row; for
    more cases than a report should list, leave it out by ``with_ranks``.
    """
    n = F.count(F.lit(1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "rank"))), lambda r: r["rank"].cast("int"))
    total = F.coalesce(F.sum(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), F.lit(0.0))
    return ranks.agg(
        n.alias("query_count"),
        F.count("rank").alias("hits_at_k"),
        F.when(n > 0, F.count("rank") / n).otherwise(F.lit(0.0)).alias("hit_rate_at_k"),
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("mean_reciprocal_rank"),
        *([listed.alias("ranks")] if with_ranks else []),
    )


def compare(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """(query_id, query, baseline_rank, tuned_rank) of two runs over the same cases."""
    a = baseline.select("query_id", "query", F.col("rank").alias("baseline_rank"))
    b = tuned.select(F.col("query_id").alias("q"), F.col("query").alias("other"), F.col("rank").alias("tuned_rank"))
    joined = a.join(b, F.col("query_id") == F.col("q"), "full_outer")
    return joined.select(F.coalesce("query_id", "q").alias("query_id"), F.coalesce("query", "other").alias("query"), "baseline_rank", "tuned_rank")
