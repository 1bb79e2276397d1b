"""Lines repeated across one site's documents.

Method: the documents of each line are stored as compressed bitmaps per site;
the bitmaps of a line's variants (same letters, other case, digits or
punctuation) are united, exact cardinalities are held against the thresholds,
and lines are deleted by looking documents up in the bitmaps.

A site's documents are numbered without gaps first, whatever their ids, so a
bitmap is as dense as its line is frequent. Bitmaps are cut into buckets of
32,768 documents, a row of 4 KB at most each, and written compressed; a line that
stands on a third of all pages is spread over as many rows as it has buckets.
Building, uniting, counting and looking up are functions of the JVM; Python only
reads the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.markdown import FenceState, is_heading
from docloom.functions.urls import host
from docloom.llm.splitting import FENCED_LINES
from docloom.plans.ranks import ranks
from docloom.plans.shared import Scratch

NOT_LETTER = re.compile(r"[\W\d_]+")
MIN_LETTERS, MIN_PAGES, MIN_PERCENT = 12, 5, 15


def letters(line: str) -> str:
    """The letters of a line, case folded."""
    return NOT_LETTER.sub("", line.casefold())


def has_place(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap (binary, lowest bit first) is set; places count from 0."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("bigint"), place.bitwiseAND(7).cast("int")) == 1


def _counted_lines(batches: Iterator[pa.RecordBatch], min_letters: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, site, number, key, variant = [], [], [], [], []
        for id_, site_, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            state = FenceState()
            for i, line in enumerate(text.split("\n"), 1):
                if state.step(line) or len(line) < min_letters or (line[0] == "#" and is_heading(line)):
                    continue
                form = letters(line)
                if len(form) < min_letters:
                    continue
                page.append(id_)
                site.append(site_)
                number.append(i)
                key.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
                variant.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(page, pa.int64()),
                pa.array(site, pa.string()),
                pa.array(number, pa.int32()),
                pa.array(key, pa.binary()),
                pa.array(variant, pa.int64()),
            ],
            ["page_id", "site", "line_no", "key", "variant"],
        )


def line_occurrences(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(page_id, site, line_no, key, variant) of each line that counts.

    Lines are split at LF and numbered from 1. Lines in fenced code, headings
    and lines with fewer than ``min_letters`` letters do not count. Pages with a
    null id, a null text or a url without host have none.
    """
    slim = pages.select(F.col(id_col).cast("bigint").alias("id"), host(F.col(url_col)).alias("site"), F.col(text_col).alias("text"))
    slim = slim.where("id is not null and site is not null and text is not null")
    return slim.mapInArrow(
        lambda batches: _counted_lines(batches, min_letters),
        "page_id bigint, site string, line_no int, key binary, variant bigint",
    )


def numbered_pages(occurrences: DataFrame) -> DataFrame:
    """(site, page_id, number): the pages of each site numbered from 0 without gaps, by id."""
    pages = occurrences.select("site", "page_id").distinct()
    return ranks(pages, ["site"], "page_id", "number")


def repeated_lines(occurrences: DataFrame, site_rows: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(bitmaps, places): lines on at least ``min_pages`` pages and ``min_percent`` percent of the site's rows.

    ``site_rows``: site, rows. ``bitmaps``: site, key, bucket, bitmap, of lines
    that repeat. ``places``: page_id, line_no, site, key, bucket, place, of all
    occurrences that may belong to such lines.
    """
    # A line stands on no more pages than it has occurrences: a plain count leaves only
    # lines that can reach the thresholds, before any bitmap is built.
    often = occurrences.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = often.join(site_rows, "site").where(F.col("n") * 100 >= F.col("rows") * min_percent)
    able = scratch.write(occurrences.join(often.select("site", "key"), ["site", "key"], "left_semi"), "able")
    number = F.col("number") + 1
    places = able.join(numbered_pages(able), ["site", "page_id"]).select(
        "page_id", "line_no", "site", "key", "variant", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("place")
    )
    places = scratch.write(places, "places")
    stored = scratch.write(places.groupBy("site", "key", "variant", "bucket").agg(F.bitmap_construct_agg("place").alias("bitmap")), "variants")
    united = stored.groupBy("site", "key", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    united = scratch.write(united.withColumn("pages", F.bitmap_count("bitmap")), "united")
    totals = united.groupBy("site", "key").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages)
    found = totals.join(site_rows, "site").where(F.col("pages") * 100 >= F.col("rows") * min_percent)
    return united.join(found.select("site", "key"), ["site", "key"], "left_semi").select("site", "key", "bucket", "bitmap"), places


def repeated_occurrences(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "markdown",
    min_pages: int = MIN_PAGES,
    min_percent: int = MIN_PERCENT,
) -> DataFrame:
    """(page_id, line_no) of each occurrence of a line repeated across its site.

    Ids name pages: repeated rows of one id count as one page, but as several
    rows of the site. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "site-lines")
    lines = scratch.write(line_occurrences(pages, id_col, url_col, text_col), "lines")
    rows = pages.groupBy(host(F.col(url_col)).alias("site")).agg(F.count(F.lit(1)).alias("rows")).where("site is not null")
    bitmaps, places = repeated_lines(lines, rows, scratch, min_pages, min_percent)
    looked = places.join(bitmaps, ["site", "key", "bucket"]).where(has_place(F.col("bitmap"), F.col("place")))
    return scratch.result(looked.select("page_id", "line_no").distinct())


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for text, gone in zip(texts, numbers, strict=True):
        if text is None or gone is None:
            out.append(text)
            continue
        drop = set(gone.tolist() if hasattr(gone, "tolist") else gone)
        out.append("\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in drop))
    return pd.Series(out, dtype=object)


def remove_repeated_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "markdown") -> DataFrame:
    """The pages with their repeated lines removed from ``text_col``; null texts stay null."""
    gone = repeated_occurrences(pages, id_col, url_col, text_col)
    gone = gone.groupBy(F.col("page_id").alias("__id")).agg(F.collect_list("line_no").alias("__gone"))
    joined = pages.join(gone, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, _without(text_col, "__gone")).select(*pages.columns)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_occurrences(spark.read.parquet(f"{sf_dir}/clean_documents.parquet"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page without the lines repeated across its site."""
    pages = spark.read.parquet(f"{sf_dir}/clean_documents.parquet").select("page_id", "url", "markdown")
    return remove_repeated_lines(pages).select("page_id", "markdown")


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean}

_FOUND = (
    "WITH RECURSIVE "
    + FENCED_LINES.format("SELECT page_id AS id, markdown AS text FROM clean_documents WHERE markdown IS NOT NULL")
    + r""",
site AS (SELECT page_id, nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)', 1), '^.*@', ''), ':\d*$', '')), '') AS site FROM clean_documents),
size AS (SELECT site, count(*) AS rows FROM site GROUP BY 1),
ln AS (SELECT f.id AS page_id, f.no AS line_no, s.site, regexp_replace(replace(lower(f.l), 'ß', 'ss'), '[^\p{L}]', '', 'g') AS k FROM fenced_lines f JOIN site s ON s.page_id = f.id
       WHERE NOT f.code AND s.site IS NOT NULL AND NOT regexp_matches(f.l, '^#{1,4}[ \t]')),
rep AS (SELECT site, k FROM ln JOIN size USING (site) WHERE length(k) >= 12 GROUP BY site, k, rows HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) * 100 >= rows * 15),
found AS (SELECT page_id, line_no FROM ln JOIN rep USING (site, k))"""
)
ORACLES = {
    "p4_found": _FOUND + "\nSELECT page_id, line_no::INT AS line_no FROM found",
    "p4_clean": _FOUND
    + """
SELECT page_id, CASE WHEN markdown IS NULL THEN NULL ELSE coalesce((SELECT string_agg(l, chr(10) ORDER BY no) FROM fenced_lines f WHERE f.id = d.page_id AND NOT EXISTS (SELECT 1 FROM found x WHERE x.page_id = f.id AND x.line_no = f.no)), '') END AS markdown
FROM clean_documents d""",
}
