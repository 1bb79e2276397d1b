"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: content-defined chunk reuse. A rolling hash over the text chooses where
chunks end, so equal stretches of different documents give equal chunks; equal
chunks are brought together and encoded once; then each document's chunks are
joined and the joints are repaired by re-encoding until they agree exactly with
the encoding of the whole text.

When do joints agree? No token of this family spans from a character that is
not white space to a blank or line feed, and what follows such a place is
tokenized without regard to what stands before. So at a *clean* place, between
a visible character and a blank or line feed, encodings simply add up. The
rolling hash chooses among clean places. Where a text has none for long (words
of thousands of letters, scripts without blanks) it is cut anywhere; around
such a *rough* joint everything from the last clean place before to the first
clean place behind is encoded again, over as many chunks as that takes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern by which this tokenizer family splits text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
#: One clean place in so many ends a chunk, and a chunk has at least LEAST and at most MOST characters.
ONE_IN, LEAST, MOST = 32, 128, 2048
#: A task sends a chunk's text again after so many of its occurrences, under another key, so that no key grows without bound.
REPEATS = 1000
TASKS_PER_KEY = 256
SEEN = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: White space above the blank in Unicode.
WIDE_SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if max(ranks.values()) > 0xFFFF:
        raise ValueError("token ids must fit into 16 bits")
    return tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """The number of bytes of each token id."""
    encoding = tokenizer(path)
    sizes = np.zeros(encoding.max_token_value + 1, dtype=np.int64)
    for token in encoding.token_byte_values():
        sizes[encoding.encode_single_token(token)] = len(token)
    return sizes


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, BASE, dtype=np.uint64))
        return up, np.cumprod(np.full(size, inverse, dtype=np.uint64))


def clean_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with a visible character before and a blank or line feed behind; and the character codes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    left, right = codes[:-1], codes[1:]
    clean = ((right == 32) | (right == 10)) & (left > 32)
    places = np.flatnonzero(clean) + 1
    if len(places) and codes.max() >= 0x85:
        places = places[~np.isin(codes[places - 1], WIDE_SPACES)]
    return places, codes


def chunk_ends(text: str) -> list[tuple[int, bool]]:
    """(end, clean) of each chunk of a text; the last chunk ends, cleanly, at its end."""
    size = len(text)
    if size <= LEAST:
        return [(size, True)] if size else []
    places, codes = clean_places(text)
    up, down = _powers(1 << max(16, size.bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[:size], dtype=np.uint64)))
        starts = np.maximum(places - WINDOW, 0)
        windows = (sums[places] - sums[starts]) * down[np.maximum(places - 1, 0)]
        chosen = places[(windows >> np.uint64(40)) % np.uint64(ONE_IN) == 0]
    ends: list[tuple[int, bool]] = []
    at = 0
    while size - at > MOST or len(chosen):
        i = int(np.searchsorted(chosen, at + LEAST))
        if i < len(chosen) and chosen[i] <= at + MOST:
            at = int(chosen[i])
            ends.append((at, True))
            continue
        if size - at <= MOST:
            break
        # No chosen place within reach: the last clean one, else anywhere.
        j = int(np.searchsorted(places, at + MOST, side="right")) - 1
        clean = j >= 0 and places[j] >= at + LEAST
        at = int(places[j]) if clean else at + MOST
        ends.append((at, bool(clean)))
    if at < size:
        ends.append((size, True))
    return ends


CHUNKS = "key binary, salt int, owner bigint, doc_id bigint, seq int, rough int, text string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of (id, text) rows; a chunk's text is sent once for many occurrences in a task."""
    task = TaskContext.get().partitionId()
    owner, seen = task << 40, {}
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            owner += 1
            start, rough_left = 0, False
            for seq, (end, clean) in enumerate(chunk_ends(text)):
                piece = text[start:end]
                key = xxhash.xxh3_128_digest(piece.encode("utf-8", "surrogatepass"))
                times = seen.get(key, 0)
                if not times and len(seen) > SEEN:
                    seen.clear()
                seen[key] = times + 1
                salt = (task // TASKS_PER_KEY) * 4096 + times // REPEATS
                rough = rough_left + 2 * (not clean)
                for col, value in zip(cols, (key, salt, owner, id_, seq, rough, piece if times % REPEATS == 0 else None), strict=True):
                    col.append(value)
                start, rough_left = end, not clean
        types = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "salt", "owner", "doc_id", "seq", "rough", "text"]
        )


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Encode each run of equal (key, salt) once; rows are sorted, texts first."""
    encode = tokenizer(path).encode_ordinary
    current, packed, text = None, b"", ""
    for batch in batches:
        keys, salts, rough, texts = (batch.column(i).to_pylist() for i in (0, 1, 5, 6))
        ids, kept = [], []
        for key, salt, edge, sent in zip(keys, salts, rough, texts, strict=True):
            if (key, salt) != current:
                current, text = (key, salt), sent
                packed = np.array(encode(text), dtype="<u2").tobytes()
            ids.append(packed)
            kept.append(text if edge else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(3), batch.column(4), batch.column(5), pa.array(ids, pa.binary()), pa.array(kept, pa.string())],
            ["owner", "doc_id", "seq", "rough", "ids", "text"],
        )


def join_rough(parts: list[tuple[np.ndarray, str]], path: str = VOCABULARY) -> np.ndarray:
    """The ids of chunks that meet at rough joints, given each chunk's own ids and text."""
    encoding, sizes = tokenizer(path), token_bytes(path)
    text = "".join(t for _, t in parts)
    places = clean_places(text)[0] if len(text) > 1 else np.zeros(0, np.int64)
    ends = np.cumsum([len(t) for _, t in parts])
    windows: list[list[int]] = []
    for joint in ends[:-1]:
        i, j = int(np.searchsorted(places, joint, side="right")) - 1, int(np.searchsorted(places, joint, side="left"))
        low, high = int(places[i]) if i >= 0 else 0, int(places[j]) if j < len(places) else len(text)
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    out, at = [], 0
    for low, high in [*windows, [len(text), len(text)]]:
        if at < low:
            # Between two windows lies one stretch of one chunk, from one clean place to another.
            k = int(np.searchsorted(ends, at, side="right"))
            begin = int(ends[k - 1]) if k else 0
            ids, own = parts[k]
            sums = np.concatenate(([0], np.cumsum(sizes[ids])))
            a, b = len(own[: at - begin].encode()), len(own[: low - begin].encode())
            out.append(ids[np.searchsorted(sums, a) : np.searchsorted(sums, b)])
        out.append(np.array(encoding.encode_ordinary(text[low:high]), dtype=np.int64))
        at = high
    return np.concatenate(out)


def _assemble(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Join the chunks of each owner; rows are sorted by owner and seq."""
    held: list[tuple] = []

    def finish(rows: list[tuple]) -> np.ndarray:
        parts = [(np.frombuffer(ids, dtype="<u2"), text) for _, _, _, _, ids, text in rows]
        if not any(r[3] for r in rows):
            return np.concatenate([p for p, _ in parts])
        out, group = [], []
        for row, part in zip(rows, parts, strict=True):
            group.append(part)
            if not row[3] & 2:
                out.append(group[0][0] if len(group) == 1 else join_rough([(p.astype(np.int64), t) for p, t in group], path))
                group = []
        return np.concatenate(out)

    def flush(done: list[list[tuple]]) -> pa.RecordBatch:
        arrays = [finish(rows) for rows in done]
        offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
        values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([rows[0][1] for rows in done], pa.int64()), lists], ["doc_id", "ids"])

    for batch in batches:
        rows = held + list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        runs = [list(g) for _, g in groupby(rows, key=lambda r: r[0])]
        held = runs.pop() if runs else []
        if runs:
            yield flush(runs)
    if held:
        yield flush([held])


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, without special tokens.

    One row for each input row, also for repeated ids and null ids; a null or
    empty text gives an empty list. Strings of special tokens are ordinary text.
    """
    slim = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    empty = slim.where("text is null or text = ''").select("doc_id", F.expr("cast(array() as array<int>)").alias("ids"))
    chunks = slim.where("text <> ''").mapInArrow(_chunks, CHUNKS)
    together = chunks.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("text").isNull())
    encoded = together.mapInArrow(lambda b: _encode(b, path), "owner bigint, doc_id bigint, seq int, rough int, ids binary, text string")
    joined = encoded.repartition("owner").sortWithinPartitions("owner", "seq")
    return joined.mapInArrow(lambda b: _assemble(b, path), "doc_id bigint, ids array<int>").unionByName(empty)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
