"""Duplicates hidden by formatting differences.

Method: an incremental ledger. The ledger is a stored, bucketed table of canonical
keys with the number of copies and the earliest representative. A batch of records
is aggregated to its own keys, full-outer-joined with the ledger's matching
buckets, counts are added and the earliest representative is kept. Buckets that
a batch does not touch are neither read nor written; their number doubles as the
ledger grows. Any later session opens the ledger by its folder, and a batch that
it has by name is not added again.

Canonical form: letters and digits in lower case (case folding), all else
removed. A content that consists only of ``key: value`` lines (maybe as list
items) or is one JSON object is a set of fields: its fields in canonical form
are sorted, each value staying with its key; so are those of an object within it. A content of fields and one of
plain text are never copies of each other; fields as lines and the same fields
as JSON are. Contents that are null or hold neither letter nor digit have no key.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.manifest import Manifest
from docloom.plans.shared import Scratch

NOT_ALNUM = re.compile(r"[\W_]+")
FIELD = re.compile(r"\s*(?:(?:[-*+•]|\d+[.)])\s+)?([^:]*[^\W_][^:]*?)\s*:(?:[\s\u200b\ufeff]+(.*?))?\s*$", re.S)
#: Buckets of a new ledger (as a power of two), and about how many keys a bucket may have before their number doubles.
LEAST_BITS, BUCKET_KEYS = 4, 1_000_000
#: A key with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def bare(text: str) -> str:
    """Letters and digits only, case folded."""
    return NOT_ALNUM.sub("", text.casefold())


def _plain(value: object) -> str:
    """A JSON value in canonical form; objects come as lists of (key, value) tuples."""
    if isinstance(value, str):
        return bare(value)
    if isinstance(value, _Fields):
        return "{" + ",".join(sorted(f"{bare(k)}={_plain(v)}" for k, v in value)) + "}"
    if isinstance(value, list):
        return "".join(map(_plain, value))
    return bare(json.dumps(value))


class _Fields(list):
    """The fields of a JSON object in their order."""


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """The fields of a content that is nothing but fields, keys and values in canonical form, else None."""
    stripped = text.strip().strip("\u200b\ufeff")
    if stripped[:1] == "{" and stripped[-1:] == "}":
        try:
            pairs = json.loads(stripped, object_pairs_hook=_Fields)
            return [(bare(k), _plain(v)) for k, v in pairs] if isinstance(pairs, _Fields) else None
        except (ValueError, RecursionError):
            return None
    if ":" not in stripped:
        return None
    out = []
    for line in stripped.splitlines():
        if not line.strip():
            continue
        found = FIELD.match(line)
        if found is None:
            return None
        out.append((bare(found[1]), bare(found[2] or "")))
    return out if len(out) > 1 else None  # a single field has no order to ignore


def canonical(text: str) -> str:
    """The canonical form of a content; '' if it holds neither letter nor digit."""
    fields = fields_of(text)
    if fields is None:
        return bare(text)
    return "\n".join(p for p in sorted(f"{k}={v}" for k, v in fields) if p != "=")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            form = canonical(text)
            keys.append(hashlib.md5(form.encode("utf-8", "surrogatepass")).digest() if form else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["id", "key"])


def content_keys(rows: DataFrame, id_col: str = "load_seq", text_col: str = "content") -> DataFrame:
    """(id, key) of each row whose content has a canonical form; key is 16 bytes.

    Rows with a null id or content, or a content without letter or digit, are
    left out; other columns are not read.
    """
    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    slim = slim.where("id is not null and text is not null")
    return slim.mapInArrow(_keys, "id bigint, key binary").where("key is not null")


class Ledger:
    """A stored table (key, copies, first_id) in buckets, under a folder; it grows by batches.

    Each commit is a folder with the buckets that it wrote, and a manifest says
    in which folder each bucket is, how many keys it has and which batches are in
    (``plans.manifest``). There are ``2**bits`` buckets, so many that a bucket
    has at most about ``bucket_keys`` keys; when their number doubles, that one
    batch rewrites all of them.
    """

    SCHEMA = "key binary, copies bigint, first_id bigint, bucket int"

    def __init__(self, spark: SparkSession, root: str, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.root, self.bucket_keys = spark, root.rstrip("/"), bucket_keys
        self.manifest = Manifest(spark, root)

    def state(self) -> dict:
        """``bits``, ``places`` (bucket: folder), ``keys`` (bucket: number of keys), ``batches``."""
        return self.manifest.read()[1] or {"bits": LEAST_BITS, "places": {}, "keys": {}, "batches": []}

    def current(self, buckets: set[int] | None = None, state: dict | None = None) -> DataFrame:
        """The ledger, or only some buckets of it; reads no other bucket's files."""
        parts, by_folder = [], {}
        for bucket, folder in (state or self.state())["places"].items():
            if buckets is None or int(bucket) in buckets:
                by_folder.setdefault(folder, []).append(int(bucket))
        for folder, wanted in sorted(by_folder.items()):
            rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{folder}")
            parts.append(rows.where(F.col("bucket").isin(sorted(wanted))))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, keys: DataFrame, batch: str) -> bool:
        """Add a batch of (id, key) under a name; False if the ledger has that batch already."""
        number, state = self.manifest.read()[0] + 1, self.state()
        if batch in state["batches"]:
            return False
        scratch = Scratch(self.spark, "ledger-batch")
        new = scratch.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "batch")
        most = sum(state["keys"].values()) + new.count()
        bits = max(state["bits"], (-(-most // self.bucket_keys) - 1).bit_length() if most else 0)

        def bucket(key: str) -> Column:
            return F.xxhash64(key).bitwiseAND((1 << bits) - 1).cast("int")

        new = new.select(bucket("key").alias("b"), F.col("key").alias("k"), "n", "low")
        grows = bits != state["bits"]
        touched = {r["b"] for r in new.select("b").distinct().collect()} if not grows else None
        if touched is None or touched:
            old = self.current(touched, state).withColumn("bucket", bucket("key"))
            both = old.join(new, (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")), "full_outer")
            merged = both.select(
                F.coalesce("key", "k").alias("key"),
                (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"),
                F.least("first_id", "low").alias("first_id"),
                F.coalesce("bucket", "b").alias("bucket"),
            )
            folder = f"data/{number:09d}-{uuid.uuid4().hex[:8]}"
            # One file a bucket, whatever the number of tasks.
            merged.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            sizes = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            counts = {str(r["bucket"]): r["n"] for r in sizes.collect()}
            kept = {} if grows else state
            state["places"] = kept.get("places", {}) | dict.fromkeys(counts, folder)
            state["keys"] = kept.get("keys", {}) | counts
        self.manifest.publish(number, state | {"bits": bits, "batches": [*state["batches"], batch]})
        scratch.keep()
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Delete the files that none of the last ``keep`` commits names."""
        self.manifest.forget(keep, lambda state: set(state.get("places", {}).values()))


def ledger_of(keys: DataFrame, root: str, batches: int = 2, bucket_keys: int = BUCKET_KEYS) -> Ledger:
    """Feed (id, key) rows to the ledger at ``root`` in ``batches`` batches of equal id ranges, earliest first."""
    ledger = Ledger(keys.sparkSession, root, bucket_keys)
    bounds = keys.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    if bounds["a"] is None:
        return ledger
    width = (bounds["b"] - bounds["a"]) // batches + 1
    for i in range(batches):
        low = bounds["a"] + i * width
        ledger.add(keys.where((F.col("id") >= low) & (F.col("id") < low + width)), f"ids {low}..{low + width - 1}")
    return ledger


def copies(keys: DataFrame, ledger: Ledger) -> DataFrame:
    """(keep_id, copy_id): every row of a group but its earliest, with that earliest.

    The few hot keys (fewer than ``HOT_SHARE`` by definition) are broadcast, so
    a group that holds a third of all rows is never gathered in one task.
    """
    groups = ledger.current().where("copies > 1").select(F.col("key").alias("g"), "copies", "first_id")
    limit = keys.count() / HOT_SHARE
    hot = groups.where(F.col("copies") > limit).select("g", "first_id")
    cold = groups.where(F.col("copies") <= limit).select("g", "first_id")
    on = F.col("key") == F.col("g")
    rest = keys.join(F.broadcast(hot), on, "left_anti").join(cold, on)
    large = keys.join(F.broadcast(hot), on)
    every = large.select("first_id", "id").unionByName(rest.select("first_id", "id"))
    return every.where("id <> first_id").select(F.col("first_id").alias("keep_id"), F.col("id").alias("copy_id"))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Ledger, Scratch]:
    scratch = Scratch(spark, "dedup")
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    keys = scratch.write(content_keys(chunks), "keys")
    scratch.names.add("ledger")
    return keys, ledger_of(keys, f"{scratch.root}/ledger"), scratch


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, ledger, scratch = _prepared(spark, sf_dir)
    return scratch.result(copies(keys, ledger).select(F.col("keep_id").alias("load_seq_keep"), F.col("copy_id").alias("load_seq_copy")))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each content: its earliest row, with its content and its number of copies."""
    _, ledger, scratch = _prepared(spark, sf_dir)
    kept = scratch.result(ledger.current().select("first_id", "copies"))
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("load_seq", "chunk_id", "page_id", "content")
    return chunks.join(kept, F.col("load_seq") == F.col("first_id")).select("load_seq", "chunk_id", "page_id", "content", "copies")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}

_BARE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEYS = rf"""
WITH c AS (SELECT load_seq, chunk_id, page_id, content, regexp_replace(content, '^[\s\x{{200b}}\x{{feff}}]+|[\s\x{{200b}}\x{{feff}}]+$', '', 'g') AS s FROM chunks WHERE content IS NOT NULL),
l AS (SELECT *, CASE WHEN s LIKE '{{%}}' THEN json_valid(s) AND coalesce(json_type(CASE WHEN json_valid(s) THEN s END) = 'OBJECT', false) ELSE false END AS is_json,
        list_filter(string_split(regexp_replace(s, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM c),
f AS (SELECT load_seq, chunk_id, page_id, content,
        CASE WHEN is_json THEN list_transform(json_keys(CASE WHEN is_json THEN s END), lambda k: {_BARE.format("k")} || '=' || {_BARE.format("json_extract_string(s, '$.\"' || k || '\"')")})
             WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^[^:]*[\p{{L}}\p{{N}}][^:]*:([\s\x{{200b}}\x{{feff}}]|$)'))) = 0
             THEN list_transform(lines, lambda x: {_BARE.format(r"regexp_replace(split_part(x, ':', 1), '^\s*([-*+•]|\d+[.)])\s+', '')")} || '=' || {_BARE.format("substr(x, strpos(x, ':') + 1)")}) END AS fields FROM l),
k AS (SELECT load_seq, chunk_id, page_id, content, CASE WHEN len(fields) > 0 THEN 'F' || array_to_string(list_sort(list_filter(fields, lambda x: x <> '=')), chr(10)) ELSE {_BARE.format("content")} END AS key FROM f)"""

ORACLES = {
    "p2_found": _KEYS
    + """
SELECT load_seq_keep, load_seq AS load_seq_copy FROM (SELECT load_seq, min(load_seq) OVER (PARTITION BY key) AS load_seq_keep FROM k WHERE key NOT IN ('', 'F')) WHERE load_seq <> load_seq_keep""",
    "p2_records": _KEYS
    + """
SELECT min(load_seq) AS load_seq, arg_min(chunk_id, load_seq) AS chunk_id, arg_min(page_id, load_seq) AS page_id, arg_min(content, load_seq) AS content, count(*)::BIGINT AS copies FROM k WHERE key NOT IN ('', 'F') GROUP BY key""",
}
