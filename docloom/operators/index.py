"""A stored approximate index of vectors for cosine search, built once and searched many times.

Inverted lists: centres are fitted on a bounded sample, every vector lies in the
list of its most similar centre, and the lists are partitions of the stored
table. A search compares a query exactly with the lists whose centres are most
similar to it, and reads no other partition. What it finds is exact within these
lists; with more ``probes`` it finds more, with all of them everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plans.manifest import Manifest

#: Vectors that centres are fitted on, at most, and how many of them each centre has at least.
SAMPLE, PER_CENTRE = 16384, 8
ROUNDS, PROBES = 8, 16
#: Rows of a list, and queries that probe it, which meet in one task.
PART, CHUNK = 16384, 4096


def centres_of(data: np.ndarray, number: int, seed: int = 11) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means; a centre that loses all its vectors starts again at one."""
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), size=number, replace=False)].copy()
    for _ in range(ROUNDS):
        own = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        empty = np.bincount(own, minlength=number) == 0
        sums[empty] = data[rng.choice(len(data), size=int(empty.sum()))]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, norms, out=centres, where=norms > 0)
    return centres


class VectorIndex:
    """An index in a folder; ``build`` makes one, ``VectorIndex(spark, root)`` opens it in any later session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, root)

    @classmethod
    def build(cls, corpus: DataFrame, root: str, dimension: int, lists: int | None = None) -> VectorIndex:
        """Index the vectors (id, vector) of a dimension that are finite and not all zero; ids are unique.

        The sample are the vectors of the smallest id hashes. By default there
        are about as many lists as the square root of the number of vectors, as
        far as the sample has ``PER_CENTRE`` vectors for each.
        """
        index = cls(corpus.sparkSession, root)
        usable = corpus.where(F.col("id").isNotNull() & (F.size("vector") == dimension))
        hashes = usable.select(F.xxhash64("id").alias("h"))
        n = hashes.count()
        last = hashes.orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first()["h"]
        chosen = usable.where(F.xxhash64("id") <= F.lit(last)).select(F.col("vector").cast("array<float>").alias("v")).toArrow()
        _, data = search.unit_rows(chosen.column(0), dimension)
        wanted = lists or 1 << max(0, round(np.log2(max(1, n)) / 2))
        number = max(1, min(wanted, len(data) // PER_CENTRE))
        centres = centres_of(data, number) if len(data) else np.eye(1, dimension)
        index.manifest.publish(index.manifest.read()[0] + 1, {"dimension": dimension, "centres": centres.astype(np.float32).tolist(), "kind": dict(corpus.dtypes)["id"], "folders": []})
        index.add(corpus)
        return index

    def add(self, corpus: DataFrame) -> None:
        """Add vectors (id, vector) to their lists; those that are in already are not looked for."""
        number, state = self.manifest.read()
        folder = f"lists/{number + 1:09d}-{uuid.uuid4().hex[:8]}"
        placed = self._placed(corpus, state)
        # Large lists are cut into several files by the planner, small ones put into one.
        placed.hint("rebalance", "list").write.partitionBy("list").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        self.manifest.publish(number + 1, state | {"folders": [*state["folders"], folder]})

    def _placed(self, corpus: DataFrame, state: dict) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(np.array(state["centres"], dtype=np.float32))
        dimension = state["dimension"]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, data = search.unit_rows(batch.column(1), dimension)
                own = (data @ shared.value.T).argmax(axis=1).astype(np.int32)
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(own)], ["id", "vector", "list"])

        slim = corpus.select("id", F.col("vector").cast("array<float>").alias("vector")).where("id is not null and vector is not null")
        return slim.mapInArrow(work, f"id {state['kind']}, vector array<float>, list int")

    def _stored(self, state: dict) -> DataFrame | None:
        out = None
        for folder in state["folders"]:
            one = self.spark.read.schema(f"id {state['kind']}, vector array<float>, list int").parquet(f"{self.root}/{folder}")
            out = one if out is None else out.unionByName(one)
        return out

    def top_k(self, queries: DataFrame, k: int, probes: int = PROBES, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, similarity, rank) of the ``k`` nearest vectors of each query (query_id, vector) in the lists it probes.

        With ``allowed`` (id) only these are found. Ties go to the smaller id;
        queries that are null, not finite, all zero or of another dimension find nothing.
        """
        if k <= 0 or probes <= 0:
            raise ValueError("limit and probes must be positive")
        _, state = self.manifest.read()
        stored, centres, dimension = self._stored(state), np.array(state["centres"], dtype=np.float32), state["dimension"]
        shared = self.spark.sparkContext.broadcast(centres)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, data = search.unit_rows(batch.column(1), dimension)
                nearest = np.argsort(-(data @ shared.value.T), axis=1, kind="stable")[:, :probes]
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(nearest.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "vector", "lists"])

        slim = queries.select(F.col("query_id").cast("bigint"), F.col("vector").cast("array<float>").alias("vector")).where("query_id is not null and vector is not null")
        asked = slim.mapInArrow(ask, "query_id bigint, vector array<float>, lists array<int>")
        # No more than there are lists; only these partitions are read.
        wanted = [r[0] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]
        rows = stored.where(F.col("list").isin(wanted)) if wanted else stored.limit(0)
        if allowed is not None:
            rows = rows.join(allowed.select(F.col("id").alias("__a")), F.col("id") == F.col("__a"), "left_semi")
        kind = "bigint" if state["kind"] in ("bigint", "int", "smallint", "tinyint") else "string"
        left = rows.select("list", F.col("id").cast(kind).alias("id"), "vector")
        right = asked.select(F.explode("lists").alias("list"), F.col("query_id").alias("id"), "vector")
        sizes = left.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(
            right.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "list"
        )

        def spread(side: DataFrame, own: str, other: str) -> DataFrame:
            place, every = F.pmod(F.xxhash64("id"), own).cast("int").alias(own[:-1]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1])
            return side.join(F.broadcast(sizes), "list").select("list", place, every, "id", "vector")

        def meet(theirs: pa.Table, mine: pa.Table) -> pa.Table:
            query_rows, matrix = search.unit_rows(mine.column("vector"), dimension)
            own_rows, data = search.unit_rows(theirs.column("vector"), dimension)
            asked_ids, ids, values = search.scored(search.ids_of(theirs.column("id"), own_rows), data, search.ids_of(mine.column("id"), query_rows).astype(np.int64), matrix, k)
            return pa.table({"query_id": pa.array(asked_ids, pa.int64()), "id": pa.array(ids.tolist(), pa.int64() if kind == "bigint" else pa.string()), "similarity": pa.array(values, pa.float64())})

        group = ["list", "part", "chunk"]
        pairs = spread(left, "parts", "chunks").groupBy(*group).cogroup(spread(right, "chunks", "parts").groupBy(*group))
        hits = pairs.applyInArrow(meet, f"query_id bigint, id {kind}, similarity double")
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
