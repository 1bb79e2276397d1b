"""Sources: package metadata, pages, chunk artifacts, evaluation cases and stored tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DatabaseConfig
from docloom.schemas import RECORDS, TABLES, schema

METADATA = "package STRING, version STRING, project_urls MAP<STRING,STRING>, docs_url STRING, home_page STRING"
_INFO = "info STRUCT<name: STRING, version: STRING, project_urls: MAP<STRING,STRING>, docs_url: STRING, home_page: STRING>"


class DiscoveryProvider(Protocol):
    """Gives the metadata (``METADATA``) of packages (package, version)."""

    def discover(self, packages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class CapturedMetadata:
    """Provider over captured package-index answers: one JSON document for each package, in files under ``path``.

    The index answers with its latest release whatever version is asked for, so
    the asked version is kept and the answer's ignored.
    """

    spark: SparkSession
    path: str

    def discover(self, packages: DataFrame) -> DataFrame:
        answers = self.spark.read.schema(_INFO).option("multiLine", True).json(self.path).select(F.lower("info.name").alias("n"), "info.*")
        answers = answers.select("n", "project_urls", "docs_url", "home_page")
        joined = packages.select("package", "version").join(answers, F.lower("package") == F.col("n"), "left")
        return joined.select("package", "version", "project_urls", "docs_url", "home_page")


@dataclass(frozen=True)
class ManualMetadata:
    """Provider that knows nothing: packages without any url."""

    spark: SparkSession

    def discover(self, packages: DataFrame) -> DataFrame:
        none = F.lit(None)
        return packages.select(
            "package", "version", none.cast("map<string,string>").alias("project_urls"), none.cast("string").alias("docs_url"), none.cast("string").alias("home_page")
        )


def discover(packages: DataFrame, provider: DiscoveryProvider) -> DataFrame:
    """Metadata of packages by the given provider."""
    return provider.discover(packages)


Fetch = Callable[[str], tuple[int, str, str]]
FETCHED = "title string, url string, html string, status_code int, final_url string, error string, metadata map<string,string>"


class HttpClient:
    """A client with redirects, a timeout and a name, on the standard library; one for each task."""

    def __init__(self, timeout: float = 30.0, agent: str = "docloom"):
        self.timeout, self.agent = timeout, agent

    def _open(self, url: str, method: str) -> tuple[int, str, str]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": self.agent}, method=method), timeout=self.timeout) as answer:
                return answer.status, answer.url, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except HTTPError as answer:
            return answer.code, answer.url or url, answer.read().decode("utf-8", "replace")

    def get(self, url: str) -> tuple[int, str, str]:
        """(status, final url, text) of a page."""
        return self._open(url, "GET")

    def head(self, url: str) -> tuple[int, str, str]:
        return self._open(url, "HEAD")

    def close(self) -> None:
        """Nothing is held open between requests."""


def fetch_pages(pages: DataFrame, make_client: Callable[[], HttpClient] = HttpClient) -> DataFrame:
    """Fetch (title, url) rows: ``FETCHED``; a failed request has an error and no status.

    One client for each task. The number of partitions of ``pages`` bounds how
    many requests run at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        try:
            for batch in batches:
                rows = []
                for title, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        status, final, text = client.get(url)
                        rows.append((title, url, text, status, final, None, [("fetcher", "http")]))
                    except TimeoutError as error:
                        rows.append((title, url, None, None, None, f"Request timed out: {error}", []))
                    except (OSError, ValueError) as error:
                        rows.append((title, url, None, None, None, f"Request failed: {error}", []))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["title", "url", "html", "status_code", "final_url", "error", "metadata"])
        finally:
            client.close()

    return pages.select("title", "url").where("url is not null").mapInArrow(work, FETCHED)


@dataclass(frozen=True)
class PackageIndexMetadata:
    """Provider that asks a package index for each package, one client for each task.

    ``address`` has ``{package}`` in place of the name. A package that the index
    does not know, or whose answer cannot be read, has no urls. The asked version
    is kept, whatever release the index answers with.
    """

    make_client: Callable[[], HttpClient] = HttpClient
    address: str = "https://pypi.org/pypi/{package}/json"

    def discover(self, packages: DataFrame) -> DataFrame:
        make_client, address = self.make_client, self.address

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = make_client()
            try:
                for batch in batches:
                    found = []
                    for package in batch.column(0).to_pylist():
                        try:
                            status, _, text = client.get(address.format(package=package))
                            info = json.loads(text)["info"] if status == 200 else {}
                        except (OSError, ValueError, KeyError, TypeError):
                            info = {}
                        urls = info.get("project_urls") or {}
                        found.append(([(k, v) for k, v in urls.items() if v is not None], info.get("docs_url"), info.get("home_page")))
                    kinds = (pa.map_(pa.string(), pa.string()), pa.string(), pa.string())
                    columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["package", "version", "project_urls", "docs_url", "home_page"])
            finally:
                client.close()

        return packages.select("package", "version").where("package is not null").mapInArrow(work, METADATA)


def pages_by(pages: DataFrame, captured: DataFrame | None = None, make_client: Callable[[], HttpClient] = HttpClient) -> DataFrame:
    """``FETCHED`` of (title, url) rows: from captured pages where there are any (rendered ones, too), the others over HTTP."""
    if captured is None:
        return fetch_pages(pages, make_client)
    have = captured.select(F.col("url").alias("__h")).distinct()
    there = captured_pages(pages.join(have, F.col("url") == F.col("__h"), "left_semi"), captured)
    return there.unionByName(fetch_pages(pages.join(have, F.col("url") == F.col("__h"), "left_anti"), make_client))


def captured_pages(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """``FETCHED`` from pages captured before (url, html, status_code), also those rendered by a browser."""
    have = captured.select(F.col("url").alias("__u"), "html", "status_code")
    joined = pages.select("title", "url").join(have, F.col("url") == F.col("__u"), "left")
    error = F.when(F.col("__u").isNull(), F.lit("Request failed: not captured"))
    fetched = F.create_map(F.lit("fetcher"), F.lit("captured"))
    return joined.select("title", "url", "html", "status_code", F.col("url").alias("final_url"), error.alias("error"), fetched.alias("metadata"))


def read_chunks_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chunks of a JSON lines artifact, blank lines skipped.

    Strict: a line that is no valid chunk (not JSON, a field missing, blank
    content, a count that is not the content's length) is an error that names its
    number in its file, and so is an artifact without chunks. Otherwise bad lines
    are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    kind = schema("chunk")
    parsed = lines.where(F.rlike("value", F.lit(r"\S"))).withColumn("c", F.from_json("value", kind, {"mode": "PERMISSIVE"}))
    needed = [f"c.{n}" for n in kind.names]
    complete = F.col("c").isNotNull()
    for name in needed:
        complete = complete & F.col(name).isNotNull()
    good = complete & F.rlike("c.content", F.lit(r"(?U)\S")) & (F.col("c.character_count") == F.length("c.content")) & (F.col("c.chunk_index") >= 0)
    good = F.coalesce(good, F.lit(False))
    if strict:
        bad = parsed.where(~good).orderBy("file", "at").select("file", "at", "value").limit(1).collect()
        if bad:
            before = lines.where((F.col("file") == bad[0]["file"]) & (F.col("at") <= bad[0]["at"])).count()
            raise ValueError(f"Invalid chunk record at line {before}")
        if parsed.limit(1).count() == 0:
            raise ValueError(f"No chunks found in {path}")
    return parsed.where(good).select(*needed)


def read_evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected_any) of a JSON array of cases, numbered from 0 in the file's order."""
    rows = spark.read.schema(RECORDS["evaluation_case"]).option("multiLine", True).json(path)
    return rows.withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "query", "expected_any")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table by name, with its schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_jdbc_table(spark: SparkSession, database: DatabaseConfig, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a relational database; ``partition`` is (column, lower, upper, number of reads at once)."""
    reader = spark.read.format("jdbc").options(url=database.url, dbtable=name, **database.options, **options)
    if partition:
        column, low, high, number = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(number))
    return reader.load()
