"""Registered queries of identities, text forms, discovery and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text, urls
from docloom.functions.identity import canonical_url, chunk_id, normalize_package_name, sha256, stored_chunk_id
from docloom.operators import chunking, discovery, ingest
from docloom.operators.catalog import in_namespace


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "clean_documents").select("page_id", canonical_url(F.col("url")).alias("canonical_url"), urls.host(F.col("url")).alias("site"))


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "chunks").select(normalize_package_name(F.col("package_name")).alias("package"))
    return rows.groupBy("package").agg(F.count(F.lit(1)).alias("chunks"))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.search_text(F.col("text")).alias("search_text"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "clean_documents").select("page_id", text.clean_markdown(F.col("markdown")).alias("markdown"))


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "chunks")
    return chunks.select(
        "load_seq",
        text.plain_markdown(F.col("content")).alias("plain"),
        text.first_plain_line(F.col("content")).alias("first_line"),
        text.definition_after_name(F.col("content"), F.col("page_title")).alias("definition"),
    )


def chunk_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "chunks").where("content is not null and header_path is not null")
    digest = sha256(F.col("content"))
    own = chunk_id(F.col("package_name"), F.col("package_version"), F.col("source_url"), F.col("header_path"), F.col("chunk_index"), digest)
    return chunks.select("load_seq", digest.alias("content_hash"), own.alias("chunk_id"), stored_chunk_id(own, digest).alias("stored_id"))


def unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of each chunk id."""
    return chunking.first_of_each(_t(spark, sf_dir, "chunks"), "chunk_id", "load_seq").select("chunk_id", "load_seq", "page_id", "chunk_index")


def framework_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "raw_documents").select(ingest.detect_framework(F.col("html")).alias("framework"))
    return pages.groupBy("framework").agg(F.count(F.lit(1)).alias("pages"))


def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "raw_documents")
    status, notes = discovery.source_status(F.col("status_code"))
    counted = pages.select(status.alias("status"), notes.alias("notes")).groupBy("status", "notes")
    return counted.agg(F.count(F.lit(1)).alias("sources"))


def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of metadata made from packages: some without documentation url, some with an empty one."""
    packages = _t(spark, sf_dir, "packages")
    site = F.concat(F.lit("https://docs.example/"), "package_name")
    urls_ = F.create_map(
        F.lit("Documentation"), F.when(F.col("package_id") % 3 == 0, F.lit("")).otherwise(site),
        F.lit("Source"), F.when(F.col("package_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://code.example/"), "package_name")),
        F.lit("Repository"), F.lit("https://repo.example/"),
    )
    metadata = packages.select(
        F.col("package_name").alias("package"), F.lit("1.0").alias("version"), urls_.alias("project_urls"), F.lit("").alias("docs_url"),
        F.when(F.col("package_id") % 2 == 0, F.concat(site, F.lit("/home"))).alias("home_page"),
    )
    return discovery.manifest_sources(metadata)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.page_links(_t(spark, sf_dir, "raw_documents").where("html <> ''").select("url", "html").distinct())


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that stay on the site, as a root-relative crawl would take them."""
    pages = _t(spark, sf_dir, "raw_documents").where("url is not null and html <> '' and status_code = 200")
    latest = pages.groupBy("url").agg(F.max_by("html", F.struct("fetched_at", "raw_id")).alias("html"))
    return discovery.crawl_plan(latest).select("root_url", "position", "title", "url")


def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunk sources belong to the site of the first page."""
    chunks = _t(spark, sf_dir, "chunks").select("source_url").distinct()
    root = F.lit("https://docs.bepulazuhu.example/zuvelgraph")
    return chunks.select("source_url", discovery.should_include(F.col("source_url"), root).alias("included"))


def namespace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks below ``/python/zuvelgraph``, with the package's pages taken to lie there."""
    chunks = _t(spark, sf_dir, "chunks")
    moved = F.regexp_replace("source_url", r"^(https?://[^/]+)/", "$1/python/")
    return chunks.where(in_namespace(moved, "Zuvelgraph")).select("load_seq", moved.alias("source_url"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "raw_documents").where("html is not null")
    return pages.select("raw_id", ingest.main_text(F.col("html")).alias("main_text"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(_t(spark, sf_dir, "raw_documents").drop("framework")).select("raw_id", "framework", "markdown")


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "topics").select("topic_id", text.slugify(F.col("display_name")).alias("slug"), text.fold(F.col("qualified_name")).alias("name_key"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean documents cut into chunks."""
    pages = _t(spark, sf_dir, "clean_documents").withColumnRenamed("package_name", "package").withColumnRenamed("package_version", "version")
    return chunking.chunk_documents(pages, order_col="page_id")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all clean documents, with their header paths, before any cutting by size."""
    pages = _t(spark, sf_dir, "clean_documents").where("markdown is not null").select("page_id", "markdown")
    return chunking.document_sections(pages, "page_id", "markdown").select("page_id", "section_no", F.array_join("header_path", " > ").alias("header_path"), "content")


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 pages of each root page's plan."""
    pages = _t(spark, sf_dir, "raw_documents").where("url is not null and html <> '' and status_code = 200")
    latest = pages.groupBy("url").agg(F.max_by("html", F.struct("fetched_at", "raw_id")).alias("html"))
    return discovery.select_pages(discovery.crawl_plan(latest), 10).select("root_url", "position", "url")


def rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "chunks").where("content is not null").withColumnRenamed("package_name", "package").withColumnRenamed("package_version", "version")
    return chunking.rebuild_documents(chunks).select("package", "version", "url", "title", "markdown")


QUERIES = {
    f.__name__: f
    for f in (
        canonical_urls, package_names, search_texts, clean_texts, plain_texts, chunk_identities, unique_chunks, framework_counts, source_status, manifest_sources,
        page_links, crawl_plan, link_filter, namespace_chunks, main_text, page_markdown, slugs, document_chunks, markdown_sections, page_selection, rebuilt_documents,
    )
}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _plain(x: str) -> str:
    bare = _strip(f"replace({x}, '\\_', '_')")
    bare = f"regexp_replace({bare}, '^#{{1,6}}{_SPACE}*', '')"
    bare = f"regexp_replace({bare}, '[`*]', '', 'g')"
    return _strip(f"regexp_replace({bare}, '{_SPACE}+', ' ', 'g')")


#: The links of pages (p: k, u, h; k is unique): anchors with an href and a text. Their hrefs are paths from the root, or relative.
_LINKS = r"""
a AS (SELECT k, u, unnest(regexp_extract_all(h, '<a\s[^>]*>.*?</a>', 0, 's')) AS tag, unnest(range(len(regexp_extract_all(h, '<a\s[^>]*>.*?</a>', 0, 's')))) AS i FROM p),
t AS (SELECT k, u, i, coalesce(nullif(regexp_extract(tag, 'href\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, 'href\s*=\s*''([^'']*)''', 1), ''), regexp_extract(tag, 'href\s*=\s*([^\s"''>]+)', 1)) AS href,
        regexp_matches(tag, '^<a\s[^>]*href') AS has,
        array_to_string(list_transform(regexp_split_to_array(regexp_replace(tag, '^<a\s[^>]*>|</a>$', '', 'g'), '<[^>]*>'), lambda x: trim(x, E' \t\r\n')), '') AS title FROM a),
e AS (SELECT k, u, i, replace(replace(href, '&quot;', '"'), '&amp;', '&') AS href, replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS title FROM t WHERE has),
l AS (SELECT u AS root_url, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS position, title, href,
        CASE WHEN href LIKE '/%' THEN lower(regexp_extract(u, '^[^:]*')) || regexp_extract(u, '^[^:]*(://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(u, '[?#].*$', ''), '[^/]*$', '') || href END AS url FROM e WHERE title <> '')"""
_LATEST = "p AS (SELECT row_number() OVER () AS k, url AS u, arg_max(html, (fetched_at, raw_id)) AS h FROM raw_documents WHERE url IS NOT NULL AND html <> '' AND status_code = 200 GROUP BY url),"
_PLAN = f"WITH {_LATEST} {_LINKS}, plan AS (SELECT root_url, min(position) AS position, arg_min(title, position) AS title, url FROM l GROUP BY root_url, url)"
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SECTIONS = r"""
WITH RECURSIVE src AS (SELECT page_id AS id, regexp_replace(markdown, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS text FROM clean_documents WHERE markdown IS NOT NULL),
marks AS (SELECT id, no, l, regexp_extract(l, '^[ \t]*(`{3,}|~{3,})', 1) AS m FROM (SELECT id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM src)),
fences AS (SELECT id, no, m, row_number() OVER (PARTITION BY id ORDER BY no) AS k FROM marks WHERE m <> ''),
walk AS (SELECT id, 1::BIGINT AS k, m AS open FROM fences WHERE k = 1
  UNION ALL SELECT f.id, f.k, CASE WHEN w.open = '' THEN f.m WHEN f.m[1] = w.open[1] AND length(f.m) >= length(w.open) THEN '' ELSE w.open END FROM walk w JOIN fences f ON f.id = w.id AND f.k = w.k + 1),
state AS (SELECT f.id, f.no, w.open FROM fences f JOIN walk w USING (id, k)),
lines AS (SELECT m.id, m.no, m.l, m.m <> '' OR coalesce(s.open, '') <> '' AS code FROM marks m ASOF LEFT JOIN state s ON m.id = s.id AND m.no >= s.no),
heads AS (SELECT *, CASE WHEN NOT code AND regexp_full_match(l, '#{1,4}[ \t]+.+?[ \t]*#*[ \t]*') THEN length(regexp_extract(l, '^#+')) END AS lv FROM lines),
secs AS (SELECT *, count(lv) OVER (PARTITION BY id ORDER BY no) AS n FROM heads),
ttl AS (SELECT id, n, no, lv, trim(regexp_extract(l, '^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1)) AS t FROM secs WHERE lv IS NOT NULL),
pth AS (SELECT s.id, s.n, string_agg(a.t, ' > ' ORDER BY a.lv) AS path FROM ttl s JOIN ttl a ON a.id = s.id AND a.n <= s.n AND (a.n = s.n OR a.lv < s.lv)
        WHERE NOT EXISTS (SELECT 1 FROM ttl b WHERE b.id = a.id AND b.n > a.n AND b.n <= s.n AND b.lv <= a.lv) GROUP BY 1, 2),
txt AS (SELECT id, n, string_agg(regexp_replace(l, 'SPACES$', ''), chr(10) ORDER BY no) AS c FROM secs GROUP BY 1, 2),
cut AS (SELECT id, n, regexp_replace(c, '^SPACES|SPACES$', '', 'g') AS c FROM txt)
SELECT cut.id AS page_id, (row_number() OVER (PARTITION BY cut.id ORDER BY n) - 1)::INT AS section_no, coalesce(path, '') AS header_path, c AS content FROM cut LEFT JOIN pth USING (id, n) WHERE c <> ''""".replace("SPACES", _SPACES)

ORACLES = {
    "markdown_sections": _SECTIONS,
    "page_links": f"WITH p AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT url AS u, html AS h FROM raw_documents WHERE html <> '' AND url IS NOT NULL)), {_LINKS} SELECT root_url, position, title, href, url FROM l",
    "crawl_plan": f"{_PLAN} SELECT root_url, position, title, url FROM plan",
    "page_selection": f"{_PLAN} SELECT root_url, position, url FROM (SELECT *, row_number() OVER (PARTITION BY root_url ORDER BY position) AS n FROM plan) WHERE n <= 10",
    "canonical_urls": r"""
SELECT page_id, CASE WHEN regexp_replace(bare, '/+$', '') = '' THEN bare ELSE regexp_replace(bare, '/+$', '') END AS canonical_url,
       nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)', 1), '^.*@', ''), ':\d*$', '')), '') AS site
FROM (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS bare FROM clean_documents)""",
    "package_names": r"""
SELECT nullif(trim(lower(regexp_replace(package_name, '[-_.]+', '-', 'g')), '-'), '') AS package, count(*)::BIGINT AS chunks FROM chunks GROUP BY 1""",
    "search_texts": r"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(replace(text, '\_', '_'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS search_text FROM documents""",
    "clean_texts": rf"""
SELECT page_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(markdown, '{_LINE}', chr(10), 'g'), chr(10)),
       lambda l: regexp_replace(l, '{_SPACE}+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS markdown FROM clean_documents""",
    "plain_texts": rf"""
SELECT load_seq, plain,
  list_filter(list_transform(list_filter(list_transform(string_split(regexp_replace(content, '{_LINE}', chr(10), 'g'), chr(10)), lambda l: {_strip("l")}),
    lambda l: length(l) > 0 AND NOT regexp_matches(l, '^#{{1,6}}{_SPACE}')), lambda l: {_plain("l")}), lambda l: length(l) > 0)[1] AS first_line,
  nullif({_strip("split_part(CASE WHEN name <> '' AND starts_with(lower(plain), lower(name)) THEN trim(substr(plain, length(name) + 1), ' :-') ELSE plain END, '](/python/', 1)")}, '') AS definition
FROM (SELECT load_seq, content, {_plain("content")} AS plain, {_plain("page_title")} AS name FROM chunks)""",
    "chunk_identities": """
SELECT load_seq, content_hash, chunk_id, chunk_id || ':' || content_hash[:16] AS stored_id FROM (
  SELECT load_seq, sha256(content) AS content_hash,
         sha256(concat_ws(chr(0), package_name, package_version, source_url, array_to_string(header_path, '/'), chunk_index::VARCHAR, sha256(content))) AS chunk_id
  FROM chunks WHERE content IS NOT NULL AND header_path IS NOT NULL)""",
    "unique_chunks": "SELECT chunk_id, load_seq, page_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY load_seq) AS n FROM chunks) WHERE n = 1",
    "slugs": r"""
SELECT topic_id, CASE WHEN display_name IS NULL THEN NULL ELSE coalesce(nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(display_name), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'topic') END AS slug,
       replace(lower(qualified_name), 'ß', 'ss') AS name_key FROM topics""",
    "framework_counts": """
SELECT CASE WHEN html IS NULL THEN NULL WHEN contains(lower(html), 'mintlify') THEN 'mintlify' WHEN contains(lower(html), 'docusaurus') THEN 'docusaurus'
            WHEN contains(lower(html), 'mkdocs') THEN 'mkdocs' WHEN contains(lower(html), 'sphinx') THEN 'sphinx' ELSE 'generic' END AS framework, count(*)::BIGINT AS pages
FROM raw_documents GROUP BY 1""",
    "source_status": """
SELECT CASE WHEN status_code = 200 THEN 'verified' ELSE 'failed' END AS status,
       CASE WHEN status_code = 200 OR status_code IS NULL THEN '' ELSE 'HTTP ' || status_code END AS notes, count(*)::BIGINT AS sources
FROM raw_documents GROUP BY 1, 2""",
    "manifest_sources": """
WITH m AS (SELECT package_name AS package, 'https://docs.example/' || package_name AS site, package_id,
  nullif(CASE WHEN package_id % 3 = 0 THEN '' ELSE 'https://docs.example/' || package_name END, '') AS d,
  CASE WHEN package_id % 2 = 0 THEN 'https://docs.example/' || package_name || '/home' END AS h,
  CASE WHEN package_id % 4 = 0 THEN 'https://repo.example/' ELSE 'https://code.example/' || package_name END AS r FROM packages)
SELECT package, '1.0' AS version, 'documentation' AS source_type, 'Official Documentation' AS title, coalesce(d, h) AS url, 'pending' AS status FROM m WHERE coalesce(d, h) IS NOT NULL
UNION ALL SELECT package, '1.0', 'examples', 'Repository', r, 'pending' FROM m""",
    "link_filter": r"""
SELECT DISTINCT source_url, CASE WHEN regexp_matches(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]') THEN regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)', 1) = 'docs.bepulazuhu.example' ELSE true END AS included
FROM chunks""",
    "namespace_chunks": r"""
SELECT load_seq, moved AS source_url FROM (SELECT load_seq, regexp_replace(source_url, '^(https?://[^/]+)/', '\1/python/') AS moved FROM chunks)
WHERE regexp_matches(moved, '^(?:[^:/?#]+:)?(?://[^/?#]*)?/python/zuvelgraph(/[^?#]*)?([?#]|$)')""",
    "rebuilt_documents": """
SELECT package_name AS package, package_version AS version, source_url AS url, arg_min(page_title, (chunk_index, content, page_title)) AS title,
       string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, content, page_title) AS markdown
FROM chunks WHERE content IS NOT NULL GROUP BY 1, 2, 3""",
}
