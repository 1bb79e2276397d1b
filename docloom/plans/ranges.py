"""Exact join of points with half-open integer ranges, without a theta join.

Every range ``[start, end)`` is a union of at most ``2 * bits`` dyadic
intervals, and a point lies in exactly one dyadic interval of each level. So an
equality join on (group, level, index) returns exactly the contained pairs: no
filter follows, and no key carries more rows than the output has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cover(start, end, bits: int):
    """Array of (level, index) that covers [start, end)."""
    # At level l the still uncovered part is [lo, hi) in units of 2**l: an odd
    # lo and an odd hi each give off one interval, the rest moves a level up.
    def lo(level: int):
        return F.shiftright(start + F.lit((1 << level) - 1), level)

    def hi(level: int):
        return F.shiftright(end, level)

    parts = []
    for level in range(bits + 1):
        left, right = lo(level), hi(level)
        for bound, index in ((left, left), (right, right - 1)):
            odd = (left < right) & (bound % 2 == 1)
            parts.append(F.when(odd, F.struct(F.lit(level).alias("level"), index.alias("index"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def points_in_ranges(
    points: DataFrame, ranges: DataFrame, group: str, point: str, start: str, end: str, bits: int = 34
) -> DataFrame:
    """All pairs of a point and a range of the same group with start <= point < end.

    Columns of the two sides must have different names but for ``group``.
    Points and bounds must be not negative and below ``2**bits``. A point is
    sent once for each level that the cover of the ranges has, at most
    ``bits + 1`` and for short ranges few; these levels are asked for first.
    Null groups match each other. An empty side gives an empty result.
    """
    right = ranges.withColumnRenamed(group, "__group").withColumn(
        "__c", F.explode(_cover(F.col(start).cast("bigint"), F.col(end).cast("bigint"), bits))
    )
    right = right.withColumn("__rl", F.col("__c.level")).withColumn("__ri", F.col("__c.index")).drop("__c")
    levels = sorted(r[0] for r in right.select("__rl").distinct().collect())
    left = points.withColumn("__level", F.explode(F.lit(levels).cast("array<int>")))
    left = left.withColumn("__index", F.expr(f"shiftright(cast(`{point}` as bigint), __level)"))
    match = F.col(group).eqNullSafe(F.col("__group"))
    match = match & (F.col("__level") == F.col("__rl")) & (F.col("__index") == F.col("__ri"))
    return left.join(right, match, "inner").drop("__level", "__index", "__rl", "__ri", "__group")
