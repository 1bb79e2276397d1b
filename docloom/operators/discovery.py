"""Discovery and crawl planning: from package metadata and pages to a plan of pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.urls import authority


def manifest_sources(metadata: DataFrame) -> DataFrame:
    """Documentation and repository sources of package metadata.

    ``metadata``: package, version, project_urls MAP<STRING,STRING>, docs_url,
    home_page. The documentation is the first non-empty of the project url
    ``Documentation``, docs_url and home_page; the repository the project url
    ``Source`` or else ``Repository``. Zero to two rows for each package, as
    (package, version, source_type, title, url, status 'pending').
    """

    def given(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    urls = F.col("project_urls")
    docs = F.coalesce(given(F.try_element_at(urls, F.lit("Documentation"))), given(F.col("docs_url")), given(F.col("home_page")))
    repo = F.coalesce(given(F.try_element_at(urls, F.lit("Source"))), given(F.try_element_at(urls, F.lit("Repository"))))

    def source(kind: str, title: str, url: Column) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), F.lit(title).alias("title"), url.alias("url"), F.lit("pending").alias("status"))

    both = F.array(source("documentation", "Official Documentation", docs), source("examples", "Repository", repo))
    return metadata.select("package", "version", F.inline(F.filter(both, lambda s: s["url"].isNotNull())))


def source_status(http_status: Column, error: Column | None = None) -> tuple[Column, Column]:
    """(status, notes) of a source from the answer it gave; ``error`` names a failed request, null if none.

    Verified is status 200 alone. Without answer and error a source failed, without note.
    """
    error = F.lit(None).cast("string") if error is None else error
    ok = (http_status == 200) & error.isNull()
    status = F.when(ok, "verified").otherwise("failed")
    notes = F.when(error.isNotNull(), error).when(ok, "").when(http_status.isNotNull(), F.concat(F.lit("HTTP "), http_status.cast("string"))).otherwise("")
    return status, notes


def validate_sources(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Sources with status, http_status, redirect_url and notes from ``answers`` (url, status_code, final_url, error)."""
    found = answers.select(F.col("url").alias("__u"), "status_code", "final_url", "error")
    joined = sources.drop("status", "http_status", "redirect_url", "notes").join(found, F.col("url") == F.col("__u"), "left")
    status, notes = source_status(F.col("status_code"), F.col("error"))
    return joined.select(
        *[c for c in sources.columns if c not in ("status", "http_status", "redirect_url", "notes")],
        status.alias("status"),
        F.col("status_code").alias("http_status"),
        F.col("final_url").alias("redirect_url"),
        notes.alias("notes"),
    )


def should_include(url: Column, root: Column, strict: bool = False) -> Column:
    """Whether a link belongs to the site of ``root``: same host and port, or no absolute URL at all.

    Hosts are compared with their letter case. ``strict`` also drops mail and
    script links and bare fragments, which have no host and pass otherwise.
    """
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    place = authority(url)
    same = F.when((scheme != "") & (place != ""), place == authority(root)).otherwise(F.lit(True))
    return same & ~F.rlike(url, F.lit(r"(?i)^\s*(mailto:|javascript:|#)")) if strict else same


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[tuple[str | None, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.open.append((dict(attrs).get("href"), []))

    def handle_data(self, data: str) -> None:
        for _, parts in self.open:
            parts.append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            href, parts = self.open.pop()
            if href is not None and (title := "".join(parts)):
                self.found.append((title, href))


def links_of(page: str) -> list[tuple[str, str]]:
    """(title, href) of all links of a page with a text, in order; each text part without outer white space."""
    reader = _Links()
    reader.feed(page)
    reader.close()
    while reader.open:
        reader.handle_endtag("a")
    return reader.found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, positions, titles, hrefs, full = [], [], [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, (title, href) in enumerate(links_of(page)):
                try:
                    joined = urljoin(url, href)
                except ValueError:
                    joined = href
                for column, value in zip((urls, positions, titles, hrefs, full), (url, i, title, href, joined), strict=True):
                    column.append(value)
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        arrays = [pa.array(c, t) for c, t in zip((urls, positions, titles, hrefs, full), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["root_url", "position", "title", "href", "url"])


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(root_url, position, title, href, url) of each link of each page; ``url`` is absolute.

    Pages with a null url or html have none. One Arrow pass, no shuffle.
    """
    slim = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where("u is not null and h is not null")
    return slim.mapInArrow(_links, "root_url string, position bigint, title string, href string, url string")


def crawl_plan(pages: DataFrame, url_col: str = "url", html_col: str = "html", strict: bool = False) -> DataFrame:
    """(root_url, position, title, url, level, parent, status) of the pages to crawl from each root page.

    Links of other sites are dropped; of several links to one URL the first
    stays. URLs that differ in the fragment are different. Positions keep the
    page's order but may have gaps.
    """
    links = page_links(pages, url_col, html_col).where(should_include(F.col("url"), F.col("root_url"), strict))
    first = links.groupBy("root_url", "url").agg(F.min_by("title", "position").alias("title"), F.min("position").alias("position"))
    return first.select(
        "root_url", "position", "title", "url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit("pending").alias("status")
    )


def select_pages(plan: DataFrame, max_pages: int = 50) -> DataFrame:
    """The first pages of each root's plan."""
    order = Window.partitionBy("root_url").orderBy("position")
    return plan.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max_pages).drop("__r")


def url_join(base: Column, href: Column) -> Column:
    """RFC 3986 resolution of a reference; null if either is null."""

    @F.pandas_udf(T.StringType())
    def join(bases: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(bases, refs, strict=True)], dtype=object)

    return join(base, href)
