"""Filling containers of fixed capacity with items that are not split.

Method: optimal length buckets. A global histogram of item sizes (at most
``capacity`` numbers, whatever the number of items) goes to the driver, where
dynamic programming chooses the bucket boundaries that minimise padding, which
is what is lost if each item counts as its bucket's upper bound. Padding of a
bucket follows from prefix sums, and the best start of a bucket never moves back
as its end moves on, so each round halves its way through ranges that add up to
the number of sizes: buckets x sizes x log(sizes) steps, and no matrix. Token-budget
batches then form inside each bucket, the largest bucket first: a batch takes as
many items of the bucket as its budget of ``capacity`` allows.

Batches of one bucket alone waste what their budget leaves over (nearly half
of it for items just above half the capacity). So what a bucket's batches leave
is open to the items of smaller buckets, best fit first; a bucket opens new
batches only for items that no open batch can take.

All of this happens on counts: the plan says which ranks of a bucket go to which
containers. Items then get their rank in their bucket (``plans.ranks``, no group
in one task) and look their container up; no item ever travels to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.tokens import VOCABULARY, token_ids
from docloom.plans.ranks import prefix_sums, ranks
from docloom.plans.shared import Scratch

CAPACITY, BUCKETS = 2048, 512


def _round(best: np.ndarray, items: np.ndarray, mass: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the least best[i] + padding(i, j) over starts i < j, and the first i that gives it.

    Ends are taken in the order of a binary tree: the starts of one level's ends
    lie between those already found for the ends beside them.
    """
    n = len(best)
    least, start = np.full(n, np.inf), np.zeros(n, dtype=np.int32)
    least[0] = 0.0
    step = 1 << max(0, (n - 1).bit_length() - 1)
    known = np.zeros(n, dtype=bool)
    while step:
        ends = np.arange(step, n, step)
        ends = ends[~known[ends]]
        before, behind = ends - step, ends + step
        low = np.where(known[before], start[before], 0)
        inside = behind < n
        high = ends - 1
        high[inside] = np.where(known[behind[inside]], np.minimum(start[behind[inside]], high[inside]), high[inside])
        width = high - low + 1
        first = np.concatenate(([0], np.cumsum(width)[:-1]))
        i = np.repeat(low - first, width) + np.arange(width.sum())
        j = np.repeat(ends, width)
        value = best[i] + upper[j] * (items[j] - items[i]) - (mass[j] - mass[i])
        least[ends] = np.minimum.reduceat(value, first)
        hits = np.flatnonzero(value == np.repeat(least[ends], width))
        start[ends] = i[hits[np.searchsorted(hits, first)]]
        known[ends] = True
        step >>= 1
    return least, start


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the total padding, by dynamic programming."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    if len(sizes) <= buckets:
        return sizes.tolist()
    counts = np.array([histogram[s] for s in sizes.tolist()], dtype=np.float64)
    items = np.concatenate(([0.0], np.cumsum(counts)))
    mass = np.concatenate(([0.0], np.cumsum(counts * sizes)))
    upper = np.concatenate(([0.0], sizes.astype(np.float64)))
    best = upper * items - mass
    starts = []
    for _ in range(buckets - 1):
        best, start = _round(best, items, mass, upper)
        starts.append(start)
    at, bounds = len(sizes), []
    while at:
        bounds.append(int(sizes[at - 1]))
        at = int(starts.pop()[at]) if starts else 0
    return sorted(bounds)


def container_plan(bounds: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (bucket, first rank, number of items, first container, items for each container).

    Container numbers start at 0 and have no gaps. Within a row the item of rank
    r goes to container ``first + (r - first rank) // each``.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> runs (first container, number)
    opened = 0
    for bucket in range(len(bounds) - 1, -1, -1):
        size, left, rank = bounds[bucket], counts[bucket], 0
        while left:
            fits = [r for r in room if r >= size]
            if fits:
                rest = min(fits)
                first, number = room[rest].pop()
                if not room[rest]:
                    del room[rest]
            else:
                rest, first, number = capacity, opened, -(-left // (capacity // size))
                opened += number
            each = min(rest // size, -(-left // number))
            full = min(number, left // each)
            if full == 0:
                each, full = left, 1
            plan.append((bucket, rank, full * each, first, each))
            room.setdefault(rest - each * size, []).append((first, full))
            if full < number:
                room.setdefault(rest, []).append((first + full, number - full))
            rank += full * each
            left -= full * each
    return plan


def _with_pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """Numbered rows (row_no, doc_id, n, full, rest): whole containers an item fills and what remains."""
    return sizes.select(
        F.monotonically_increasing_id().alias("row_no"),
        "doc_id",
        F.col("n").cast("bigint").alias("n"),
        F.floor(F.col("n") / capacity).cast("bigint").alias("full"),
        (F.col("n") % capacity).cast("int").alias("rest"),
    ).where("n > 0")


def _planned(items: DataFrame, capacity: int, buckets: int) -> tuple[list[int], list[int], list[tuple[int, int, int, int, int]]]:
    histogram = {r["rest"]: r["n"] for r in items.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = bucket_bounds(histogram, buckets)
    places = np.searchsorted(bounds, list(histogram), side="left")
    counts = np.bincount(places, weights=list(histogram.values()), minlength=len(bounds)).astype(np.int64).tolist()
    return bounds, counts, container_plan(bounds, counts, capacity)


def padding(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, upper_bound, items, tokens, padding) of the buckets that the dynamic programming chooses for items (doc_id, n)."""
    scratch = Scratch(sizes.sparkSession, "packing")
    items = scratch.write(_with_pieces(sizes, capacity), "items")
    histogram = {r["rest"]: r["n"] for r in items.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    scratch.keep()
    rows, at = [], 0
    known = sorted(histogram)
    for number, bound in enumerate(bucket_bounds(histogram, buckets)):
        own = []
        while at < len(known) and known[at] <= bound:
            own.append(known[at])
            at += 1
        number_of, mass = sum(histogram[s] for s in own), sum(s * histogram[s] for s in own)
        rows.append((number, bound, number_of, mass, bound * number_of - mass))
    return sizes.sparkSession.createDataFrame(rows, "bucket int, upper_bound int, items bigint, tokens bigint, padding bigint")


def pack(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(container_id, doc_id, piece_no, token_start, token_end) of items (doc_id, n).

    An item is split only if it alone exceeds the capacity: into full pieces and
    one rest that is packed like any item. Items of size null, 0 or less take no
    room and are left out. Repeated ids are separate items. ``token_end`` is
    exclusive. An empty table gives an empty result.
    """
    scratch = Scratch(sizes.sparkSession, "packing")
    items = scratch.write(_with_pieces(sizes, capacity), "items")
    bounds, _, plan = _planned(items, capacity, buckets)
    whole = int(items.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("s")).first()["s"])
    by_bucket: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for bucket in range(len(bounds)):
        rows = sorted(p[1:] for p in plan if p[0] == bucket)
        by_bucket[bucket] = tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 2, 3))

    @F.pandas_udf(T.IntegerType())
    def bucket_of(rest: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, rest.to_numpy(), side="left").astype(np.int32))

    @F.pandas_udf(T.LongType())
    def container_of(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(bucket), dtype=np.int64)
        which, place = bucket.to_numpy(), rank.to_numpy()
        for b in np.unique(which):
            firsts, containers, each = by_bucket[int(b)]
            mine = which == b
            row = np.searchsorted(firsts, place[mine], side="right") - 1
            out[mine] = containers[row] + (place[mine] - firsts[row]) // each[row]
        return pd.Series(out)

    rests = ranks(items.where("rest > 0").withColumn("bucket", bucket_of("rest")), ["bucket"], "row_no", "rank")
    rests = rests.select(
        (F.lit(whole) + container_of("bucket", "rank")).alias("container_id"),
        "doc_id",
        F.col("full").cast("int").alias("piece_no"),
        (F.col("n") - F.col("rest")).alias("token_start"),
        F.col("n").alias("token_end"),
    )
    split = prefix_sums(items.where("full > 0").withColumn("g", F.lit(0)), ["g"], "row_no", F.col("full"), "base")
    split = split.select("doc_id", "base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece")).select(
        (F.col("base") + F.col("piece")).alias("container_id"),
        "doc_id",
        F.col("piece").cast("int").alias("piece_no"),
        (F.col("piece") * capacity).alias("token_start"),
        ((F.col("piece") + 1) * capacity).alias("token_end"),
    )
    return scratch.result(rests.unionByName(split))


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n): the number of tokens of each text."""
    return token_ids(documents, id_col, text_col, path).select("doc_id", F.size("ids").alias("n"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets that the dynamic programming chose: upper bound, items, their tokens, tokens of padding."""
    return padding(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p8_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: no container overfull, no gap in their numbers, no document split without need, none lost."""
    packed = p8_pack(spark, sf_dir)
    by_container = packed.groupBy("container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    by_container = by_container.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), (F.coalesce(F.max("container_id") + 1, F.lit(0)) - F.count(F.lit(1))).alias("gaps"))
    by_document = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("token_end").alias("n"), F.sum(F.col("token_end") - F.col("token_start")).alias("placed"))
    needless = (F.col("pieces") > F.ceil(F.col("n") / CAPACITY)) | (F.col("placed") != F.col("n"))
    by_document = by_document.agg(F.count(F.lit(1)).alias("documents"), F.count_if(needless).alias("split_or_cut"))
    return by_container.join(by_document)


QUERIES = {"p8_pack": p8_pack, "p8_buckets": p8_buckets, "p8_properties": p8_properties}
ORACLES = {"p8_properties": "SELECT 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS split_or_cut, count(*)::BIGINT AS documents FROM documents WHERE text <> ''"}
