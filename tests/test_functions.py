import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import CatalogConfig, ChunkingConfig, EmbeddingConfig
from docloom.functions import identity, text
from docloom.functions.chunker import chunk_markdown, section_chunks
from docloom.functions.htmltree import parse
from docloom.functions.markdown import code_lines, sections
from docloom.operators import discovery, ingest

LEVELS = frozenset((1, 2, 3, 4))


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_package_names_and_urls(spark):
    assert column(spark, ["Demo_Package.Name", "-a--b_", "..", None], identity.normalize_package_name) == ["demo-package-name", "a-b", None, None]
    assert identity.package_name("Demo_Package.Name") == "demo-package-name"
    with pytest.raises(ValueError, match="letters or numbers"):
        identity.package_name("-._")
    urls = ["https://example.com/docs/#install", " https://e.com/// ", "/", None]
    assert column(spark, urls, identity.canonical_url) == ["https://example.com/docs", "https://e.com", "/", None]


def test_chunk_id_is_the_digest_of_its_parts(spark):
    df = spark.createDataFrame([("p", "1", "u", ["A", "B"], 3, "h")], "a string, b string, c string, d array<string>, e int, f string")
    got = df.select(identity.chunk_id(*[F.col(c) for c in "abcdef"])).first()[0]
    assert got == hashlib.sha256("\0".join(("p", "1", "u", "A/B", "3", "h")).encode()).hexdigest()


def test_clean_markdown_equals_a_line_loop(spark):
    def plain(value):
        out, pending = [], False
        for line in value.splitlines():
            if line.strip():
                out += ["", line.rstrip()] if pending and out else [line.rstrip()]
                pending = False
            else:
                pending = True
        return "\n".join(out)

    values = ["\n# T  \n\n\n\ntext\t \n", "", " \n ", "a\r\nb\rc d\x1ce", "x\n \n　\ny", "```\n\n\n```"]
    assert column(spark, values, text.clean_markdown) == [plain(v) for v in values]
    assert column(spark, [None], text.clean_markdown) == [None]


def test_search_text_and_slugs(spark):
    assert column(spark, ["create\\_agent ToolRuntime v2X", "Ümlaut é", None], text.search_text) == ["create agent tool runtime v2 x", "mlaut", None]
    assert column(spark, ["Foo_Bar", "Ünïcode Café", "***", None], text.slugify) == ["foo-bar", "unicode-cafe", "topic", None]
    assert column(spark, ["Straße", "STRASSE", "ẞ", "ΟΔΟΣ", "οδος", "ﬁ", None], text.fold) == ["strasse", "strasse", "ss", "οδοσ", "οδοσ", "fi", None]


def test_definitions(spark):
    df = spark.createDataFrame(
        [("Agent", "agent: runs `tools`](/python/x/y)[Class"), ("Agent", "Other text"), ("Agent", "Agent"), ("A", None)], "name string, content string"
    )
    got = [r[0] for r in df.select(text.definition_after_name(F.col("content"), F.col("name"))).collect()]
    assert got == ["runs tools", "Other text", None, None]
    assert column(spark, ["# T\n\n**Bold** line\nnext", "## only", ""], text.first_plain_line) == ["Bold line", None, None]


def test_lexical_relevance(spark):
    df = spark.createDataFrame([("ToolRuntime class", "Tool Runtime", "x"), ("the of", "Tool", "x"), ("tool other", "", "a tool")], "q string, h string, c string")
    terms = text.query_terms_column(F.col("q"))
    got = [r[0] for r in df.select(text.lexical_relevance(terms, F.col("h"), F.lit(""), F.col("c"), F.lit(None).cast("string"))).collect()]
    assert got == [1.0, 0.0, pytest.approx(0.275)]


def test_nested_headings_and_fences():
    paths = [p for p, _ in chunk_markdown("# Guide\nintro\n## Install\nx\n### Linux\ny", 4000, 400, LEVELS)]
    assert paths == [("Guide",), ("Guide", "Install"), ("Guide", "Install", "Linux")]
    fenced = chunk_markdown("# A\n```markdown\n# no heading\n## none\n```\n# B\ntext", 4000, 400, LEVELS)
    assert [p for p, _ in fenced] == [("A",), ("B",)] and "## none" in fenced[0][1]
    assert chunk_markdown("just text", 4000, 400, LEVELS) == [((), "just text")]
    assert chunk_markdown(" \n\n ", 4000, 400, LEVELS) == []


def test_oversized_prose_and_code():
    prose = " ".join(f"word{i}" for i in range(100))
    pieces = [c for _, c in chunk_markdown(prose, 120, 20, LEVELS)]
    assert len(pieces) > 1 and max(map(len, pieces)) <= 120 and set(" ".join(pieces).split()) == set(prose.split())
    code = "# Code\n\n```python\n" + "\n".join(f"line_{i} = {i}" for i in range(30)) + "\n```"
    pieces = [c for _, c in chunk_markdown(code, 90, 20, LEVELS) if "line_" in c]
    assert all(c.count("```") == 2 and len(c) <= 90 for c in pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n#`~.", max_size=400), st.integers(10, 80), st.integers(0, 9))
def test_chunks_lose_no_word_and_stay_in_bounds(value, limit, overlap):
    pieces = list(section_chunks(value, limit, overlap))
    if "```" not in value and "~~~" not in value:
        assert all(len(p) <= limit for p in pieces)
        assert not value.strip() or pieces


def test_sections_and_code_lines():
    value = "pre\n# A\nx\n~~~\n# code\n~~~~\n##\tB\ny\n##### deep\n```\nopen"
    got = [(value[a:b].strip().split("\n")[0], path) for a, b, path in sections(value)]
    assert got == [("pre", ()), ("# A", ("A",)), ("##\tB", ("A", "B"))]
    assert code_lines(value.split("\n"))[3:6] == [True] * 3 and code_lines(value.split("\n"))[-1]


def test_html_blocks_of_broken_pages():
    page = "<html><head><title>no</title></head><body><p>a <b>b</b> &amp; c<p>d<ul><li>e<li>f <a href=x>g</a></ul><script>'<p>x</p>'</script><!-- <p>y</p> -->h"
    _, blocks = parse(page)
    assert [" ".join(b.text.split()) for b in blocks] == ["a b & c", "d", "e", "f g", "h"]
    assert blocks[3].link_chars == 1 and parse("")[1] == []


def test_configuration_checks():
    with pytest.raises(ValueError, match="below the size"):
        ChunkingConfig(max_characters=10, overlap_characters=10)
    for headers in ([], ["#", "#"], ["#", "heading"]):
        with pytest.raises(ValueError, match="heading mark"):
            ChunkingConfig(headers=headers)
    embedding = EmbeddingConfig("local", "m", 384)
    with pytest.raises(ValueError, match="in any case"):
        CatalogConfig(embedding, ("/a", "/A"))
    base = CatalogConfig(embedding, ("/python/a/",)).hash("A_b", "1", "run", "snap")
    assert base == CatalogConfig(EmbeddingConfig("local", "m", 384, batch_size=1, cache_directory="x"), ("/python/a",)).hash("a-b", "1", "run", "snap")
    assert base != CatalogConfig(embedding, ("/python/a",), api_evidence_limit=9).hash("a-b", "1", "run", "snap")


def test_manifest_and_status(spark):
    df = spark.createDataFrame(
        [("a", "1", {"Documentation": "", "Repository": "r"}, "", "home"), ("b", "1", None, None, None)],
        "package string, version string, project_urls map<string,string>, docs_url string, home_page string",
    )
    got = [(r.package, r.source_type, r.url) for r in discovery.manifest_sources(df).collect()]
    assert got == [("a", "documentation", "home"), ("a", "examples", "r")]
    answers = spark.createDataFrame([("home", 404, "home", None), ("r", None, None, "Request timed out: x")], "url string, status_code int, final_url string, error string")
    checked = discovery.validate_sources(discovery.manifest_sources(df), answers).collect()
    assert [(r.status, r.notes) for r in sorted(checked, key=lambda r: r.url)] == [("failed", "HTTP 404"), ("failed", "Request timed out: x")]


def test_crawl_plan_keeps_first_and_same_site(spark):
    page = '<a href="/x"> One </a><a href="x#f">F</a><a href="https://other.example/">O</a><a href="/x">Two</a><a href="mailto:a@b">M</a><a href="/e"></a>'
    df = spark.createDataFrame([("https://d.example/", page), ("https://e.example/", None)], "url string, html string")
    got = [(r.title, r.url) for r in discovery.crawl_plan(df).orderBy("position").collect()]
    assert got == [("One", "https://d.example/x"), ("F", "https://d.example/x#f"), ("M", "mailto:a@b")]
    assert [r.title for r in discovery.crawl_plan(df, strict=True).orderBy("position").collect()] == ["One", "F"]


def test_ingest_makes_markdown_of_the_main_part(spark):
    page = "<body><nav>menu</nav><main><h1>T</h1><script>x</script><p>a <b>b</b> <a href='/l'>l</a></p><ul><li>i<li>j</ul><pre><code>c\n  d</code></pre></main>built with MkDocs</body>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    got = [(r.framework, r.markdown) for r in ingest.ingest(df).collect()]
    assert got[0][0] == "mkdocs" and got[0][1].startswith("# T\n\na **b** [l](/l)") and "```\nc\n  d\n```" in got[0][1] and "menu" not in got[0][1]
    assert got[1] == (None, None) and got[2] == ("generic", "")
    deep = "<div>" * 5000 + "text"
    assert "text" in ingest.html_to_markdown(deep)
