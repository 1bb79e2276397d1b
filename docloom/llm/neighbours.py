"""The most similar vectors of every vector, by cosine, within each embedding version.

Method: additive quantisation (see ``additive``). Codebooks are fitted on a
bounded sample of each version; every vector is encoded by beam search and stored
with its codes, the norm of its approximation and the norm of what that leaves
out. The first code names the vector's list; a list with more than ``LIST_MOST``
vectors is split into cells by the second code, so cells multiply with the data
though the sample does not grow. A query is scored against the cells it probes by
lookup tables and stored norms; the exact cosines of the best give a floor, and
every other vector of these cells that can still reach it is compared exactly
too, however many there are.

What can reach the floor is decided by a proven bound: q.x <= q.x' + |x - x'|
for a vector x, its approximation x' and a query q of unit length. So within the
probed cells the result is exact; only the choice of cells is approximate. A
query probes the lists nearest to it, at least ``PROBES`` and as many as hold
``FEWEST`` vectors (far vectors lie in small lists of their own), and, without a
cap, all that are at least ``RATIO`` as similar to it as the nearest: those share
a dense group with it. In the same way it chooses among the cells of split lists.

Vectors that are copies of each other are one vector to all of this: copies are
put in, by id, when the neighbours of distinct vectors are known, and no more of
them than a result can hold.

Queries travel to the cells they probe. Where a cell is asked by many, or holds
many, its queries come in chunks of about ``QUERY_BLOCK`` and its vectors in
parts of about ``CODE_BLOCK``, each chunk against each part, so no group grows
with the data, and each meeting passes on no more than ``k`` for a query. The
work on a dense group of distinct vectors is quadratic in it.

A vector travels several times, so the meetings are held in rounds that each send
about as many vectors as there are; the shuffle files of a round go before the
next. Vectors are kept and sent as they were given, as 16-bit numbers where these
hold them exactly (see ``packed``), and scaled to unit length where they are used.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.additive import Codebooks, encode, train
from docloom.plans.shared import Scratch, shuffles_dropped
from docloom.plans.topk import best, reaching

SAMPLE = 8192
#: Books, words of each book but the first, and how many vectors of the sample the first book has at least for each of its words.
BOOKS, CODEWORDS, PER_WORD = 8, 64, 4
LIST_MOST = 16384
PROBES, FEWEST, RATIO = 3, 512, 0.7
QUERY_BLOCK, CODE_BLOCK, SLICE = 2048, 4096, 256
#: A round of meetings sends as many vectors as there are, or so many if there are fewer.
ROUND = 1 << 17
#: Cells are numbered list * CELLS, plus one and the second code where the list is split.
CELLS = 1 << 16

VECTOR = "vec_id bigint, version int, vector binary, digest binary"


def packed(data: np.ndarray) -> list[bytes]:
    """The rows of a matrix of single-precision values as bytes that ``unit_rows`` reads, none without a nonzero value.

    Where all values of a row are 16-bit multiples of one power of two, those
    multiples and a byte of padding; else the values themselves.
    """
    data = data.astype(np.float64)
    whole = np.ldexp(data, 15 - np.frexp(np.abs(data).max(axis=1))[1][:, None])
    short = whole.astype("<i2")
    return [s.tobytes() + b"\0" if fits else d.astype("<f4").tobytes() for s, d, fits in zip(short, data, (short == whole).all(axis=1), strict=True)]


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of packed vectors of one dimension as a matrix, scaled to unit length; that does not depend on the power of two."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros((0, 0), dtype=np.float32)
    lengths = pc.binary_length(column).to_numpy()
    out = None
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        raw = binary_rows(column if len(rows) == len(column) else column.take(pa.array(rows)), "u1")
        data = (np.ascontiguousarray(raw[:, :-1]).view("<i2") if length % 2 else raw.view("<f4")).astype(np.float64)
        out = np.empty((len(column), data.shape[1]), dtype=np.float32) if out is None else out
        out[rows] = data / np.linalg.norm(data, axis=1)[:, None]
    return out


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        out_ids, out_versions, out, digests = [], [], [], []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            flat = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            data = flat.astype(np.float64).reshape(len(rows), int(dim))
            norms = np.linalg.norm(data, axis=1)
            good = np.isfinite(norms) & (norms > 0)
            unit = (data[good] / norms[good, None]).astype(np.float32)
            out_ids.extend(ids[rows[good]].tolist())
            out_versions.extend(versions[rows[good]].tolist())
            if len(unit):
                out.extend(packed(data[good]))
            digests.extend(hashlib.md5(row.tobytes()).digest() for row in unit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_ids, pa.int64()), pa.array(out_versions, pa.int32()), pa.array(out, pa.binary()), pa.array(digests, pa.binary())],
            ["vec_id", "version", "vector", "digest"],
        )


def usable_vectors(embeddings: DataFrame, versions: DataFrame) -> DataFrame:
    """(vec_id, version, vector, digest): usable vectors, packed, with the MD5 of what they are at unit length.

    Unusable are vectors that are null, of another length than their version's
    dimension, of an unknown version, with a null, NaN or infinite value, or all
    zero, and rows with a null id.
    """
    dims = versions.select(F.col("embedding_version_id").alias("v"), F.col("dimension").alias("dim"))
    rows = embeddings.where("vec_id is not null and embedding is not null").join(
        dims, F.col("embedding_version_id") == F.col("v")
    )
    rows = rows.where((F.size("embedding") == F.col("dim")) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    slim = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("int").alias("version"), F.col("embedding").cast("array<float>").alias("embedding"), "dim")
    return slim.mapInArrow(_packed_rows, VECTOR)


def binary_rows(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of binaries of one length as a matrix, without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype=kind)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _train(group: pa.Table) -> pa.Table:
    """The pickled codebooks of a version's sample (version, n, vector)."""
    data = unit_rows(group.column("vector"))
    # A list for about every second root of the vectors; the sample must know each of them.
    lists = 1 << max(0, round(np.log2(max(1.0, np.sqrt(group.column("n")[0].as_py()) / 2))))
    model = train(data, max(1, min(lists, len(data) // PER_WORD)), max(1, min(CODEWORDS, len(data) // PER_WORD)), BOOKS)
    return pa.table({"version": group.column("version").slice(0, 1), "model": pa.array([pickle.dumps(model)], pa.binary())})


def fit(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, Codebooks]:
    """Codebooks of each version from at most ``sample`` vectors, those of the smallest id hashes.

    A version is trained in a task of its own; only the finished codebooks come to the driver.
    """
    hashed = vectors.select("version", F.xxhash64("vec_id").alias("h"))
    first = Window.partitionBy("version").orderBy("h")
    # The sample-th smallest hash, from hashes alone; the vectors themselves are only filtered.
    last = hashed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample).groupBy("version").agg(F.max("h").alias("last"))
    bounds = last.join(hashed.groupBy("version").agg(F.count(F.lit(1)).alias("n")), "version")
    chosen = vectors.join(F.broadcast(bounds), "version").where(F.xxhash64("vec_id") <= F.col("last")).select("version", "n", "vector")
    trained = chosen.groupBy("version").applyInArrow(_train, "version int, model binary")
    return {r["version"]: pickle.loads(r["model"]) for r in trained.collect()}


ENCODED = "vec_id bigint, version int, list int, code binary, norm float, loss float, vector binary"


def encoded(vectors: DataFrame, models: dict[int, Codebooks]) -> DataFrame:
    """``ENCODED``: each vector with its list, its codes, the norm of their sum and the norm of what it leaves out."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = batch.column(1).to_numpy()
            for version in np.unique(versions):
                part = batch.filter(pa.array(versions == version))
                model = shared.value[int(version)]
                for start in range(0, part.num_rows, 1024):
                    piece = part.slice(start, 1024)
                    data = unit_rows(piece.column(2))
                    codes = encode(data, model)
                    near = model.decode(codes)
                    columns = [
                        piece.column(0), piece.column(1), pa.array(codes[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary()),
                        pa.array(np.maximum(np.linalg.norm(near, axis=1), 1e-6).astype(np.float32)), pa.array((np.linalg.norm(data - near, axis=1) + 1e-5).astype(np.float32)), piece.column(2),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "version", "list", "code", "norm", "loss", "vector"])

    return vectors.select("vec_id", "version", "vector").mapInArrow(work, ENCODED)


def _probed(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the lists or cells (``sizes``: how many vectors each has) a query probes, by their cosines with it."""
    order = np.argsort(-scores, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    near = (before < FEWEST) | (np.arange(scores.shape[1]) < PROBES)
    out = scores >= RATIO * np.maximum(scores.max(axis=1, keepdims=True), 0.0)
    np.put_along_axis(out, order, near | np.take_along_axis(out, order, axis=1), axis=1)
    return out & np.isfinite(scores) & (sizes > 0)


def probes(data: np.ndarray, model: Codebooks, own: np.ndarray, sizes: np.ndarray, list_most: int = LIST_MOST) -> list[list[int]]:
    """The cells that each query probes; ``own`` is the list of each, ``sizes`` how many vectors each list has."""
    tables = model.tables(data)
    lists = _probed(tables[0] / np.maximum(np.linalg.norm(model.words[0], axis=1), 1e-6), sizes)
    lists[np.arange(len(data)), own] = True
    split = sizes > list_most
    out = [(np.flatnonzero(row & ~split) * CELLS).tolist() for row in lists]
    parts = np.flatnonzero(split)
    if len(parts) and model.books > 1 and lists[:, parts].any():
        words = len(model.words[1])
        cells = model.words[0][parts][:, None, :] + model.words[1][None, :, :]
        scores = (tables[0][:, parts, None] + tables[1][:, None, :]) / np.maximum(np.linalg.norm(cells, axis=2), 1e-6)
        scores = np.where(lists[:, parts][:, :, None], scores, -np.inf).reshape(len(data), -1)
        numbers = (parts[:, None] * CELLS + 1 + np.arange(words)[None, :]).ravel()
        # About how many vectors a cell has: those of its list, in equal shares.
        for row, chosen in zip(out, _probed(scores, np.repeat(sizes[parts] / words, words)), strict=True):
            row.extend(numbers[chosen].tolist())
    return out


def cell_of(split: DataFrame) -> Column:
    """The cell of an encoded row that was joined with ``split`` (version, list, cut)."""
    second = F.conv(F.hex(F.concat(F.substring("code", 4, 1), F.substring("code", 3, 1))), 16, 10).cast("int")
    return F.col("list") * CELLS + F.when(F.col("cut"), second + 1).otherwise(0)


def compared(table: DataFrame, queries: DataFrame, models: dict[int, Codebooks], k: int, least: float | None, list_most: int = LIST_MOST, scratch: Scratch | None = None) -> DataFrame:
    """(version, query_id, vec_id, similarity): the ``k`` vectors of greatest exact cosine in the probed cells, ties by id.

    Cosines are rounded to nine digits. Where the whole table asks, the copy of it with
    its cells takes its place, and "encoded" is dropped from ``scratch``.
    """
    scratch = scratch or Scratch(table.sparkSession, "neighbours")
    context = table.sparkSession.sparkContext
    # As many rows as the codebooks have lists.
    sizes_of = {v: np.zeros(m.lists, dtype=np.int64) for v, m in models.items()}
    for row in table.groupBy("version", "list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes_of[row["version"]][row["list"]] = row["n"]
    cuts = [(v, int(i), True) for v, sizes in sizes_of.items() for i in np.flatnonzero(sizes > list_most) if models[v].books > 1]
    large = table.sparkSession.createDataFrame(cuts, "version int, list int, cut boolean")
    shared = context.broadcast((models, sizes_of))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = shared.value
        for batch in batches:
            versions = batch.column(1).to_numpy()
            for version in np.unique(versions):
                part = batch.filter(pa.array(versions == version))
                for start in range(0, part.num_rows, 1024):
                    piece = part.slice(start, 1024)
                    cells = probes(unit_rows(piece.column(6)), known[int(version)], piece.column(2).to_numpy(), held[int(version)], list_most)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cells, pa.list_(pa.int32()))], [*piece.schema.names, "cells"])

    key = ["version", "cell"]
    asked = scratch.write(queries.mapInArrow(ask, f"{ENCODED}, cells array<int>"), "asked")
    if queries is table:
        table = asked
        scratch.drop("encoded")
    left = asked.select("version", F.explode("cells").alias("cell"), F.col("vec_id").alias("query_id"), "vector")
    right = table.join(F.broadcast(large), ["version", "list"], "left").withColumn("cell", cell_of(large))
    asking = left.groupBy(*key).agg(F.count(F.lit(1)).alias("asks"), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("chunks"))
    holding = right.groupBy(*key).agg(F.count(F.lit(1)).alias("holds"), F.ceil(F.count(F.lit(1)) / CODE_BLOCK).alias("parts"))
    # A row for each cell: at most lists x words of the second book, for each version.
    sizes = scratch.write(asking.join(holding, key), "cells")
    sent = sizes.agg(F.sum(F.col("asks") * F.col("parts") + F.col("holds") * F.col("chunks"))).first()[0] or 0
    rounds = max(1, math.ceil(sent / max(ROUND, sum(int(n.sum()) for n in sizes_of.values()))))
    sizes = F.broadcast(sizes.drop("asks", "holds"))

    def place(id_: str, count: str) -> Column:
        return F.pmod(F.xxhash64(id_), count).alias(count[:-1])

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)).alias(count[:-1])

    turn = F.pmod(F.xxhash64(*key, "chunk"), F.lit(rounds))
    left = left.join(sizes, key).select(*key, place("query_id", "chunks"), "parts", "query_id", "vector")
    right = right.join(sizes, key).select(*key, each("chunks"), place("vec_id", "parts"), "vec_id", "code", "norm", "loss", "vector")
    empty = {"version": pa.array([], pa.int32()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}

    def exact(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table(empty)
        version = mine.column("version")[0].as_py()
        model = shared.value[0][version]
        ids, asked = theirs.column("vec_id").to_numpy(), mine.column("query_id").to_numpy()
        code = binary_rows(theirs.column("code"), "<u2").T
        norm, loss = theirs.column("norm").to_numpy(), theirs.column("loss").to_numpy()
        data, every = unit_rows(theirs.column("theirs")), unit_rows(mine.column("vector"))
        found: list[tuple] = []
        for start in range(0, len(asked), SLICE):
            query, own = every[start : start + SLICE], asked[start : start + SLICE, None] == ids
            tables = model.tables(query)
            dots = reduce(np.add, (np.take(table_, code[b], axis=1) for b, table_ in enumerate(tables)))
            floor = np.full(len(query), -1.0 if least is None else least, dtype=np.float32)
            if len(ids) > k:
                first = np.argpartition(np.where(own, np.inf, -dots / norm), k - 1, axis=1)[:, :k]
                floor = np.maximum(floor, np.einsum("qd,qkd->qk", query, data[first], optimize=True).min(axis=1))
            reach = (dots + loss >= floor[:, None] - 2e-6) & ~own
            open_ = np.flatnonzero(reach.any(axis=0))
            if not len(open_):
                continue
            some = data if len(open_) == len(ids) else data[open_]
            near = np.where(reach[:, open_], query @ some.T, -np.inf)
            near[near < floor[:, None] - 2e-6] = -np.inf
            # Single precision leaves all that may be among the best; they are compared in double.
            rows, columns = reaching(near, k, 4e-6)
            sims = np.einsum("pd,pd->p", query[rows].astype(np.float64), data[open_[columns]].astype(np.float64))
            sims = np.round(np.clip(sims, -1.0, 1.0), 9)
            if least is not None:
                rows, columns, sims = rows[sims >= least], columns[sims >= least], sims[sims >= least]
            kept = best(rows, sims, ids[open_[columns]], k)
            found.append((asked[start + rows[kept]], ids[open_[columns[kept]]], sims[kept]))
        if not found:
            return pa.table(empty)
        asked, ids, sims = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table({"version": pa.array(np.full(len(ids), version), pa.int32()), "query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    group = [*key, "chunk", "part"]

    def met(number: int) -> DataFrame:
        mine = left.where(turn == number).select(*key, "chunk", each("parts"), "query_id", "vector")
        theirs = right.where(turn == number).select(*[F.col(c).alias(f"right_{c}") for c in group], "vec_id", "code", "norm", "loss", F.col("vector").alias("theirs"))
        pairs = mine.groupBy(*group).cogroup(theirs.groupBy(*[f"right_{c}" for c in group]))
        return pairs.applyInArrow(exact, "version int, query_id bigint, vec_id bigint, similarity double")

    hits = reduce(DataFrame.unionByName, [scratch.write(met(i), f"hits-{i}") for i in range(rounds)])
    order = Window.partitionBy("version", "query_id").orderBy(F.desc("similarity"), "vec_id")
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _with_copies(hits: DataFrame, twins: DataFrame, k: int, only: str | None) -> DataFrame:
    """Hits of distinct vectors, with the copies (``twins``: version, rep, vec_id) put in on both sides."""
    first = Window.partitionBy("version", "rep").orderBy("vec_id")
    # A result holds no more than k copies of a vector, besides the query itself.
    members = twins.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("rep").alias("m_rep"), F.col("vec_id").alias("member"))
    own = twins.select("version", F.col("rep").alias("query_id"), F.col("rep").alias("vec_id"), F.lit(1.0).alias("similarity")).distinct()
    every = hits.unionByName(own).join(members, F.col("vec_id") == F.col("m_rep"), "left")
    every = every.select("version", "query_id", F.coalesce("member", "vec_id").alias("vec_id"), "similarity")
    order = Window.partitionBy("version", "query_id").orderBy(F.desc("similarity"), "vec_id")
    top = every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    askers = twins.select(F.col("rep").alias("a_rep"), F.col("vec_id").alias("asker"))
    asked = top.join(askers, F.col("query_id") == F.col("a_rep"), "left").select("version", F.coalesce("asker", "query_id").alias("query_id"), "vec_id", "similarity").where("query_id <> vec_id")
    if only:
        asked = asked.withColumnRenamed("vec_id", "found").withColumnRenamed("query_id", "vec_id").where(only).withColumnRenamed("vec_id", "query_id").withColumnRenamed("found", "vec_id")
    return asked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def nearest(embeddings: DataFrame, versions: DataFrame, k: int = 5, least: float | None = None, only: str | None = None) -> DataFrame:
    """(version, query_id, vec_id, similarity): for each query its ``k`` most similar vectors of the same version.

    All usable vectors are queries, or those for which the SQL condition ``only``
    on vec_id holds; all usable vectors are searched. A vector is not its own
    neighbour; copies of it are, and of equally similar ones the smaller ids come
    first. With ``least``, less similar ones are left out. Which vectors are
    usable is said at ``usable_vectors``; ids are unique. No usable vector gives
    an empty result.
    """
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    with shuffles_dropped(embeddings.sparkSession):
        vectors = scratch.write(usable_vectors(embeddings, versions), "vectors")
        same = scratch.write(vectors.groupBy("version", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep")).where("n > 1").drop("n"), "same")
        copies = not same.isEmpty()
        distinct = vectors.drop("digest")
        if copies:
            twins = scratch.write(vectors.select("version", "digest", "vec_id").join(same, ["version", "digest"]).select("version", "rep", "vec_id"), "twins")
            distinct = vectors.join(same, ["version", "digest"], "left").where("rep is null or rep = vec_id").select("vec_id", "version", "vector")
        models = fit(distinct)
        table = scratch.write(encoded(distinct, models), "encoded")
        scratch.drop("vectors")
        queries = table.where(only) if only else table
        if copies and only:
            asked = twins.where(only).select(F.col("rep").alias("vec_id")).union(table.where(only).select("vec_id")).distinct()
            queries = table.join(asked, "vec_id", "left_semi")
        hits = compared(table, queries, models, k, least, scratch=scratch)
        return scratch.result(_with_copies(hits, twins, k, only) if copies else hits)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/chunk_embeddings.parquet"), spark.read.parquet(f"{sf_dir}/embedding_versions.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(*_tables(spark, sf_dir), k=5, least=0.8)
    return near.select(F.least("query_id", "vec_id").alias("vec_id_a"), F.greatest("query_id", "vec_id").alias("vec_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every vector whose id is divisible by 20, against all vectors."""
    near = nearest(*_tables(spark, sf_dir), k=5, only="vec_id % 20 = 0")
    return near.select(F.col("version").alias("embedding_version_id"), "query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
_PAIRS = """
WITH u AS (SELECT e.vec_id, e.embedding_version_id AS ver, list_transform(e.embedding, lambda x: x::DOUBLE) AS v FROM chunk_embeddings e JOIN embedding_versions w ON e.embedding_version_id = w.embedding_version_id AND len(e.embedding) = w.dimension
  WHERE len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, ver, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT a.ver, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 9) AS sim FROM n a JOIN n b ON a.ver = b.ver AND a.vec_id <> b.vec_id{}),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s)"""
ORACLES = {
    "p3_found": _PAIRS.format("") + "\nSELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE r <= 5 AND sim >= 0.8",
    "p3_neighbours": _PAIRS.format(" AND a.vec_id % 20 = 0") + "\nSELECT ver AS embedding_version_id, a AS query_id, b AS vec_id, round(sim, 4) AS similarity FROM r WHERE r <= 5",
}
