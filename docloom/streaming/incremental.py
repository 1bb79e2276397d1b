"""Documents that arrive in a landing folder, imported as micro-batches.

The batch operators do the work: each micro-batch is planned against the store
and committed as a snapshot. Replayed batches change nothing, since unchanged
documents and chunks are reused.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import ChunkingConfig
from docloom.functions.identity import sha256
from docloom.operators.chunking import chunk_documents
from docloom.operators.lineage import SnapshotStore, import_frames

ARRIVAL = "package STRING, version STRING, title STRING, url STRING, markdown STRING, fetched_at TIMESTAMP"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of documents (``ARRIVAL``) in Parquet files that land in a folder."""
    return spark.readStream.schema(ARRIVAL).parquet(folder)


def once_within(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream without documents of the same url and content that come again within ``delay``."""
    keyed = stream.withColumn("content_hash", sha256(F.col("markdown")))
    return keyed.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url", "content_hash"]).drop("content_hash")


def arrivals_per_window(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, package, documents) of the stream in tumbling windows; rows later than ``delay`` are dropped."""
    counted = stream.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window).alias("w"), "package").agg(F.count(F.lit(1)).alias("documents"))
    return counted.select(F.col("w.start").alias("window_start"), "package", "documents")


def import_stream(stream: DataFrame, store: SnapshotStore, checkpoint: str, config: ChunkingConfig | None = None, once: bool = True) -> StreamingQuery:
    """Import each micro-batch of documents into the store; with ``once`` all that is there, then stop."""

    def load(batch: DataFrame, batch_id: int) -> None:
        documents = batch.withColumn("position", F.unix_micros("fetched_at"))
        chunks = chunk_documents(documents, config, "position")
        if not documents.isEmpty() and not chunks.isEmpty():
            import_frames(store, documents, chunks, datetime.now(UTC), config)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
