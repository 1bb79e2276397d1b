"""Ranks and prefix sums within groups of any size.

A window over a whole group puts the group into one task. Here the integer by
which a group is ordered is cut into digits of ``BLOCK_BITS`` bits: the lowest
window sums up rows that differ in the last digit only, the next one the totals
of those, and so on. So no window sees more than ``2**BLOCK_BITS`` rows, however
the integers lie: dense, spread over many groups, or hashes.

``positions`` numbers the rows of a whole table in any order: rows are sorted by
ranges, each range counts its own, and only one number a range is summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.shared import Scratch

BLOCK_BITS = 16


def _below(group: list[str], order: str, block: str) -> Window:
    return Window.partitionBy(*group, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(
    df: DataFrame, group: list[str], order: str, value: Column, out: str, bits: int = 63, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the group, by the integer ``order``.

    ``order`` must be unique within a group, not null, and in size below
    ``2**bits``; fewer bits save rounds. Null group keys form one group each, as
    in GROUP BY. ``value`` must not be null.
    """
    rows = df.withColumn("__order", F.col(order).cast("bigint")).withColumn("__value", value.cast("bigint"))
    keys = [f"__g{i}" for i in range(len(group))]
    rows = rows.withColumns({k: F.col(g) for k, g in zip(keys, group, strict=True)})
    return _sums(rows, keys, bits, block_bits).withColumn(out, F.col("__before")).select(*df.columns, out)


def _sums(rows: DataFrame, keys: list[str], bits: int, block_bits: int) -> DataFrame:
    """Add ``__before`` to rows with ``keys``, ``__order`` and ``__value``."""
    if bits <= block_bits:
        top = Window.partitionBy(*keys).orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__before", F.coalesce(F.sum("__value").over(top), F.lit(0)))
    rows = rows.withColumn("__block", F.shiftright("__order", block_bits))
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__value")).withColumnRenamed("__block", "__order")
    bases = _sums(totals, keys, bits - block_bits, block_bits)
    bases = bases.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col("__order").alias("__b"), F.col("__before").alias("__base"))
    inner = rows.withColumn("__in", F.coalesce(F.sum("__value").over(_below(keys, "__order", "__block")), F.lit(0)))
    match = F.col("__block") == F.col("__b")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}b"))
    joined = inner.join(bases, match, "inner").withColumn("__before", F.col("__base") + F.col("__in"))
    return joined.select(*rows.columns, "__before")


def ranks(df: DataFrame, group: list[str], order: str, out: str, bits: int = 63, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``out``: the 0-based rank of a row in its group by the integer ``order``."""
    return prefix_sums(df, group, order, F.lit(1), out, bits, block_bits)


def positions(df: DataFrame, order: list[Column], out: str, scratch: Scratch, name: str) -> DataFrame:
    """Add ``out``: the 0-based place of a row in the whole table by ``order``, which should leave no ties.

    The sorted table is written to ``scratch`` as ``name`` and read again, so
    that the ranges stay what they were when their rows were counted.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = scratch.write(ranged, name)
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # As many rows as ranges, that is, as shuffle partitions.
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = written.withColumn("__p", part).join(F.broadcast(bases), F.col("__p") == F.col("__part"))
    return joined.withColumn(out, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*df.columns, out)
