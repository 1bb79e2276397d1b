from docloom.llm import main_body as m

SCHEMA = "raw_id long, url string, html string, status_code int, host string"


def page(i, body):
    return (
        f"<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>Menu {i}</a></li><li><a href='/b'>Other</a></li></ul></nav>"
        f"<div class=promo-{i}{i}><p>Buy the thing number {i} now, it is very cheap</p></div>{body}<footer><p>© {i} all rights</p></footer></body></html>"
    )


def body(i):
    return (
        f"<div class='text'><h1>Heading {i}</h1><p>Paragraph {i} with <b>several</b> words of running text.</p><aside><p>In between</p></aside>"
        f"<ul><li>Item {i} one<li>Item {i} two</ul><div class=para>A paragraph {i} in a div, of several words.</div><pre>code({i})</pre>"
        f"<table><tr><td>cell {i}</td><td>value</td></tr></table><script>var x='<p>no</p>'</script></div>"
    )


def test_body_without_what_surrounds_or_interrupts_it(spark):
    rows = [(i, "https://h.example/p", page(i, body(i)), 200, "clash") for i in range(6)]
    rows += [(10, "https://h.example/q", page(10, ""), 200, ""), (11, "https://h.example/r", page(11, body(11)), 404, ""), (12, None, None, 200, ""), (13, "x", "", 200, "")]
    got = {}
    for r in m.main_blocks(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.raw_id, set()).add(r.block_key)
    assert set(got) == set(range(6))
    want = ["Heading 0", "Paragraph 0 with several words of running text.", "Item 0 one", "Item 0 two", "A paragraph 0 in a div, of several words.", "code(0)", "cell 0", "value"]
    assert got[0] == {m.block_key(t) for t in want}


def test_empty_table_and_keys(spark):
    assert m.main_blocks(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.block_key(" A, b! ") == m.block_key("aB") and m.block_key("--") == ""


def test_paths_are_general():
    found = m.containers("<body><div class='css-1a2b3 x12'><p>some words that stand here in a row</p></div></body>")
    assert [f[0] for f in found] == ["html>body>div.css-# x#"]


def test_bodies_as_markdown(spark):
    rows = [(i, "https://h.example/p", page(i, body(i)), 200, "clash") for i in range(6)] + [(10, "https://h.example/q", page(10, ""), 200, ""), (12, None, None, 200, ""), (13, "x", "", 200, "")]
    got = {r.raw_id: r.body for r in m.main_bodies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {*range(6), 10, 13} and got[10] is None and got[13] is None
    assert got[3].split("\n\n")[:4] == ["# Heading 3", "Paragraph 3 with several words of running text.", "* Item 3 one", "* Item 3 two"]
    assert "```\ncode(3)\n```" in got[3] and "Menu" not in got[3] and "In between" not in got[3]
    keys = {}
    for r in m.main_blocks(spark.createDataFrame(rows, SCHEMA)).collect():
        keys.setdefault(r.raw_id, set()).add(r.block_key)
    assert {m.block_key(t) for t in got[3].replace("```", "").split("\n\n")} == keys[3]


def test_votes_rank_before_a_page_s_own_score(spark):
    side = "<div class='related'><p>" + "many words of some other page that stand beside the text " * 6 + "</p></div>"
    rows = [(i, "https://h.example/p", page(i, body(i)), 200, "") for i in range(30)] + [(i, "https://h.example/p", page(i, body(i) + side), 200, "") for i in range(30, 40)]
    rows += [(40 + i, "https://h.example/p", page(i, side), 200, "") for i in range(5)]
    got = {r.raw_id: r.body for r in m.main_bodies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].startswith(f"# Heading {i}") for i in range(30))


def test_a_host_of_all_pages_is_spread(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT_BLOCK", 10)
    rows = [(i, "https://h.example/p" if i % 9 else f"https://h{i}.example/", page(i, body(i)), 200, "") for i in range(60)]
    assert m.main_blocks(spark.createDataFrame(rows, SCHEMA)).select("raw_id").distinct().count() == 60
