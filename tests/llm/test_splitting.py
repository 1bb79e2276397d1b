from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting as s
from docloom.llm.tokens import VOCABULARY, tokenizer


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n`é", max_size=600), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text_and_overlap(text, limit, overlap):
    pieces = s.cut(text, limit, overlap)
    assert all(b - a <= limit for a, b in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(end - start == overlap for (_, end), (start, _) in zip(pieces, pieces[1:], strict=False))
    else:
        assert pieces == []


def test_boundaries_by_strength_and_hard_cuts():
    text = "a" * 30 + "\n\n" + "b c " * 10
    assert s.cut(text, 40, 0)[0] == (0, 32)
    assert s.cut("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]
    code = "```\n" + "line\n\n" * 10 + "```"
    assert len(s.boundaries(code)[0]) == 0


def test_early_boundary_before_a_hard_cut():
    text = "a" * 9 + " " + "b" * 8 + "\n" + "c" * 60
    assert s.cut(text, 40, 5) == [(0, 19), (14, 54), (49, 79)]
    # A boundary within the overlap would not lead on.
    assert s.cut("abc " + "d" * 60, 40, 5)[0] == (0, 40)
    assert s.cut("e " * 10 + "f" * 60, 40, 19) == [(0, 20), (1, 41), (22, 62), (43, 80)]


def test_token_sizes():
    import numpy as np

    sizes = np.array([2] * 50)
    assert all(sizes[a:b].sum() <= 20 for a, b in s.cut("y" * 50, 20, 4, sizes))


def test_sections_and_contents(spark):
    schema = "page_id long, markdown string, header_path array<string>, limit int"
    long = "word " * 900
    rows = [(1, f"intro\r\n# A\n{long}\n## B\nshort\n```\n# not\n{long}", None, 0), (2, None, None, 0), (3, "", None, 0), (4, " " * 5000, None, 0), (5, "x\r\n" * 2001 + " ", None, 0)]
    df = spark.createDataFrame(rows, schema)
    got = s.oversized(df, "page_id", "markdown").collect()
    assert {(r.item_id, r.section_no, tuple(r.header_path)) for r in got} == {(1, 1, ("A",)), (1, 2, ("A", "B")), (5, 0, ())}
    assert all(len(r.content) <= 4000 for r in got)
    whole = s.oversized(df.withColumn("header_path", df.header_path), "page_id", "markdown", "header_path").where("piece_no = 0").collect()
    assert {(r.item_id, r.section_no) for r in whole} == {(1, 0), (5, 0)}
    assert s.oversized(spark.createDataFrame([], schema), "page_id", "markdown").count() == 0


def test_boundaries_outside_code_come_first():
    text = "Some text. More\n\n```\n" + "x = 1\n" * 12 + "```\nafter it"
    ends = s.boundaries(text)
    code = (text.index("```") + 4, text.rindex("```") + 3)
    assert all(not code[0] <= e <= code[1] - 3 for kind in ends[:4] for e in kind.tolist())
    assert text.rindex("```") + 4 in ends[1].tolist() and len(ends[4]) == 13
    # The blank line before the code is early in the window, but the code's lines are weaker.
    assert s.cut(text, 60, 3)[0] == (0, text.index("```"))or s.cut(text, 60, 3)[0][1] in ends[4].tolist()
    assert s.cut("a b\n\n```\n" + "long line\n" * 20 + "```", 50, 3)[0][1] in s.boundaries("a b\n\n```\n" + "long line\n" * 20 + "```")[4].tolist()


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary here")
def test_pieces_in_tokens(spark):
    texts = ["Words of a sentence, with numbers 12345 and names_like_this. " * 200, "日本語の文章です。" * 300, "x" * 5000, "short", None, "", "emoji 🎉👩‍👩‍👧 " * 300]
    df = spark.createDataFrame([(i, t, ["h"]) for i, t in enumerate(texts)], "id long, t string, h array<string>")
    encode = tokenizer(VOCABULARY).encode_ordinary
    pieces = {}
    for r in s.oversized(df, "id", "t", "h", limit=120, overlap=10, vocabulary=VOCABULARY).collect():
        pieces.setdefault(r.item_id, []).append((r.start, r.end, r.content))
    assert set(pieces) == {i for i, t in enumerate(texts) if t and len(encode(t.strip())) > 120}
    for i, rows in pieces.items():
        rows.sort()
        assert rows[0][0] == 0 and rows[-1][1] == len(texts[i].strip()) and max(len(encode(c)) for _, _, c in rows) <= 120
        assert all(b[0] < a[1] for a, b in zip(rows, rows[1:], strict=False))
        assert sum(s.token_sizes(texts[i], VOCABULARY)) == len(encode(texts[i]))
