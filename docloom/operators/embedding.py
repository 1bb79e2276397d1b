"""Embedding chunks that have no vector yet."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import EmbeddingConfig

TOKEN = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    """Turns texts into vectors of ``dimension``; must be picklable, since it runs in Python workers."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic vectors without a model: signed hashed words and word pairs, damped counts, unit length.

    A text without words gives the zero vector.
    """

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            words = TOKEN.findall(text.lower())
            counts: dict[str, int] = {}
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                counts[feature] = counts.get(feature, 0) + 1
            for feature, n in counts.items():
                digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
                place = int.from_bytes(digest[:7], "big") % self.dimension
                out[row, place] += (1.0 if digest[7] & 1 else -1.0) * (1.0 + math.log(n))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def self_check(embedder: Embedder) -> None:
    """ValueError if the embedder does not return vectors of its dimension."""
    got = embedder.embed(["readiness check"]).shape
    if got != (1, embedder.dimension):
        raise ValueError(f"model returned {got[-1]} dimensions; expected {embedder.dimension}")


def embed_column(embedder: Embedder, batch_size: int = 16):
    """An Arrow function from a text column to vectors; the embedder reaches each worker once. Null texts give null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[np.ndarray | None] = [None] * len(batch)
            have = [i for i, t in enumerate(batch) if t is not None]
            for start in range(0, len(have), batch_size):
                some = have[start : start + batch_size]
                for i, vector in zip(some, embedder.embed([batch.iloc[j] for j in some]), strict=True):
                    out[i] = vector
            yield pd.Series(out)

    return vectors


def current_chunks(chunks: DataFrame, documents: DataFrame, package: str | None = None, version: str | None = None) -> DataFrame:
    """Chunks of current document revisions, of one package and version if named (normalized form)."""
    rows = chunks
    if package is not None:
        rows = rows.where(F.col("package_name") == package)
    if version is not None:
        rows = rows.where(F.col("package_version") == version)
    current = documents.where("is_current").select(F.col("id").alias("__doc"))
    return rows.join(current, F.col("source_document_id") == F.col("__doc"), "left_semi")


def embedding_version_id(config: EmbeddingConfig) -> str:
    """The deterministic id of an embedding identity."""
    return hashlib.sha256(f"embedding\0{config.provider}\0{config.model}\0{config.dimension}".encode()).hexdigest()


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, version_id) -> DataFrame:
    """Chunks without a vector of the embedding version: an anti join on the chunk id."""
    have = embeddings.where(F.col("embedding_version_id") == version_id).select(F.col("chunk_id").alias("__c"))
    return chunks.join(have, F.col("id") == F.col("__c"), "left_anti")


def index_chunks(
    chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, config: EmbeddingConfig, embedder: Embedder,
    package: str | None = None, version: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new embeddings, metrics): vectors for current chunks that lack one.

    ``metrics`` is one row: embedding_version_id, model, dimension,
    chunks_indexed, chunks_reused. Reading the new rows fails if a vector has
    another length than configured.
    """
    version_id = embedding_version_id(config)
    eligible = current_chunks(chunks, documents, package, version)
    absent = missing_embeddings(eligible, embeddings, version_id)
    vectors = absent.select(F.col("id").alias("chunk_id"), embed_column(embedder, config.batch_size)("content").alias("embedding"))
    wrong = F.concat(F.lit("model returned "), F.size("embedding").cast("string"), F.lit(f" dimensions; expected {config.dimension}"))
    checked = F.when(F.size("embedding") == config.dimension, F.col("embedding")).otherwise(F.raise_error(wrong).cast("array<float>"))
    new = vectors.select("chunk_id", F.lit(version_id).alias("embedding_version_id"), checked.alias("embedding"))
    total = eligible.select(F.lit(1).alias("all"), F.lit(0).alias("new")).unionByName(absent.select(F.lit(0).alias("all"), F.lit(1).alias("new")))
    indexed = F.coalesce(F.sum("new"), F.lit(0))
    metrics = total.agg(
        F.lit(version_id).alias("embedding_version_id"), F.lit(config.model).alias("model"), F.lit(config.dimension).alias("dimension"),
        indexed.alias("chunks_indexed"), (F.coalesce(F.sum("all"), F.lit(0)) - indexed).alias("chunks_reused"),
    )
    return new, metrics
