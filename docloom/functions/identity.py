"""Names, URLs and content-addressed identities as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_package_name(name: Column) -> Column:
    """Runs of ``-``, ``_`` and ``.`` as one hyphen, lower case, no outer hyphens.

    A name of which nothing is left is null, so that a bad row can be filtered
    or asserted on; the Python form ``package_name`` raises instead.
    """
    hyphened = F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
    return F.nullif(F.regexp_replace(hyphened, r"^-+|-+$", ""), F.lit(""))


def package_name(name: str) -> str:
    """``normalize_package_name`` of one name, for arguments; ValueError if nothing is left."""
    words = [w for w in name.replace("_", "-").replace(".", "-").lower().split("-") if w]
    if not words:
        raise ValueError("package name must contain letters or numbers")
    return "-".join(words)


def canonical_url(url: Column) -> Column:
    """Without outer blanks, fragment and trailing slashes; what would become empty stays as it was."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"#[\s\S]*$", "")
    stripped = F.regexp_replace(bare, r"/+$", "")
    return F.when(stripped == "", bare).otherwise(stripped)


def sha256(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def canonical_json(value: object) -> str:
    """JSON with sorted keys, without blanks, non-ASCII characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_of(value: object) -> str:
    """Hex SHA-256 of the canonical JSON of a value."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def chunk_id(package: Column, version: Column, url: Column, header_path: Column, index: Column, content_hash: Column) -> Column:
    """SHA-256 of the chunk's place and content, parts joined by NUL. No part may be null."""
    return F.sha2(
        F.concat_ws("\0", package, version, url, F.array_join(header_path, "/"), index.cast("string"), content_hash), 256
    )


def stored_chunk_id(chunk: Column, document_hash: Column) -> Column:
    """A chunk's id in the store: its own id and 16 digits of its document's hash."""
    return F.concat(chunk, F.lit(":"), F.substring(document_hash, 1, 16))
