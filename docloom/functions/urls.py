"""Parts of URLs as columns, also for spellings that a strict parser rejects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def authority(url: Column) -> Column:
    """What stands between ``//`` and the path: user, host and port as written; '' if absent."""
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)", 1)


def host(url: Column) -> Column:
    """The lower-case host without user and port; null for null urls and urls without a host."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def path(url: Column) -> Column:
    """The path of a URL (RFC 3986, appendix B), '' if it has none."""
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
