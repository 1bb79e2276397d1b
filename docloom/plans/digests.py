"""One hash for a set of rows of any size.

A hash of the concatenated rows would put a group into one task. Here rows are
spread over 65,536 leaves by their own hash, each leaf hashes its sorted rows,
256 nodes hash their leaves and the root hashes the nodes. The result depends on
the set of rows alone: not on order, partitioning or repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(df: DataFrame, group: list[str], depth: int) -> DataFrame:
    prefix = [F.substring("__h", 1, depth).alias("__p")] if depth else []
    joined = F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("__h"))), "\n"), 256).alias("__d")
    out = df.groupBy(*group, *prefix).agg(joined)
    # A node keeps its place in the next level by its prefix.
    return out.select(*group, (F.concat("__p", "__d") if depth else F.col("__d")).alias("__h"))


def set_digest(df: DataFrame, group: list[str], item: Column, out: str) -> DataFrame:
    """(group.., out): a SHA-256 over the set of ``item`` strings of each group; null items are left out."""
    leaves = df.select(*group, F.sha2(item, 256).alias("__h")).where("__h is not null")
    for depth in (4, 2, 0):
        leaves = _level(leaves, group, depth)
    return leaves.withColumnRenamed("__h", out)
