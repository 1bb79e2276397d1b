import random

from docloom.llm import site_lines as s

SCHEMA = "page_id long, url string, markdown string, site string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_lines_of_a_site_that_repeat(spark):
    note = ["Share this page by mail!", "share THIS page 12 by mail", "> Share this page by mail."]
    rows = [(i, "HTTPS://Docs.X.example:443/p" if i % 2 else "https://docs.x.example/p", f"# Title of it\n{note[i % 3]}\nown text number {'abcdefghij'[i]} here") for i in range(6)]
    rows += [(6, "https://docs.x.example/q", "~~~\nShare this page by mail\n# Share this page by mail\n~~~~\n# Share this page by mail\nshort line"), (7, "https://docs.x.example/r", None)]
    rows += [(8, None, note[0]), (9, "https://other.example", note[0]), (10, "no host here", note[0]), (11, "https://docs.x.example/", "")]
    df = pages(spark, rows)
    got = sorted((r.page_id, r.line_no) for r in s.repeated_occurrences(df).collect())
    assert got == [(i, 2) for i in range(6)]
    clean = {r.page_id: r.markdown for r in s.remove_repeated_lines(df).collect()}
    assert clean[0] == "# Title of it\nown text number a here" and clean[7] is None and clean[9] == note[0] and len(clean) == len(rows)


def test_thresholds_are_exact(spark):
    # 5 of 33 rows are more than 15 %, 5 of 34 are less; a line twice on a page counts once.
    for total, found in ((33, 6), (34, 0)):
        rows = [(i, "https://a.example", "a line that stands on pages" if 0 < i < 5 else "") for i in range(total)]
        rows[0] = (0, "https://a.example", "a line that stands on pages\nx\na line that stands on pages")
        assert s.repeated_occurrences(pages(spark, rows)).count() == found
    rows = [(i, "https://a.example", "a line that stands on pages") for i in range(4)]
    assert s.repeated_occurrences(pages(spark, rows)).count() == 0


def test_empty_table(spark):
    assert s.repeated_occurrences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_are_hashes_are_numbered_densely(spark):
    rng = random.Random(3)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(40)]
    rows = [(i, "https://a.example", f"own text of this page {'abcdefgh'[n % 8] * 9}\n\nA line that stands on all pages") for n, i in enumerate(ids)]
    df = pages(spark, rows)
    lines = s.line_occurrences(df, "page_id", "url", "markdown")
    assert sorted(r.number for r in s.numbered_pages(lines).collect()) == list(range(40))
    assert {(r.page_id, r.line_no) for r in s.repeated_occurrences(df).where("line_no = 3").collect()} == {(i, 3) for i in ids}


def test_bitmaps_are_cut_into_buckets(spark):
    from pyspark.sql import functions as F

    have = {0, 7, 8, 32767, 32768, 70000}
    df = spark.range(70001).select((F.col("id") + 1).alias("n"), "id")
    bits = df.where(F.col("id").isin(*have)).groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m"))
    looked = df.join(bits, F.bitmap_bucket_number("n") == F.col("b")).where(s.has_place(F.col("m"), F.bitmap_bit_position("n")))
    assert {r.id for r in looked.collect()} == have
