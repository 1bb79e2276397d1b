import random

from docloom.llm import residue as r

NOUNS = ["cache", "router", "shard", "session", "token", "queue", "index", "window"]
SCHEMA = "doc_id long, text string, residue string"


def content(rng):
    a, b, c = (rng.choice(NOUNS) for _ in range(3))
    return rng.choice([f"The {a} stores every {b} before the {c} is closed.", f"Call `load_{a}` to validate the {b}.", f"In practice the {a} retries {rng.randrange(99)} times per {b}.", f"A {a} never reads the {b} of another {c}."])


def corpus():
    rng = random.Random(2)
    good = ["# Guide\n\n" + " ".join(content(rng) for _ in range(6)) for _ in range(150)]
    good += [
        "# Templates\n\nPut `{{ name }}` there.\n\n```text\nHello {{ state }} and [your name]\n```\n\n" + content(rng),
        "Markers such as <s>, </s> and <|endoftext|> stay in the text. " + content(rng),
        "# Errors\n\nThe client retries when the server answers with 404 Not Found. " + " ".join(content(rng) for _ in range(4)),
        "The crawler opens pages with JavaScript enabled and without it. " + " ".join(content(rng) for _ in range(4)),
        "", "   ", None, "Nullable tokens",
    ]
    filled = [f"# Guide\n\n{content(rng)}\n\nThe default of {x} is set. {content(rng)}" for x in ("{{ cache }}", "${TOKEN}", "<your shard>", "[add queue here]", "__REPLACE_ME__") for _ in range(4)]
    filler = [f"# A\n\n{content(rng)}\n\n# B\n\n{x}" for x in ("Lorem ipsum nostrud venim.", "Your content here.", "Description goes here.") for _ in range(4)]
    errors = ["404 Not Found\n\nThe page you asked for was moved, renamed or never existed.", "Error 500\nPlease try again in 9 minutes.\nRef: ab12cd", "Service unavailable\n\nCheck the address or go back to the start page."] * 3
    notices = ["The cache router\n\nPlease enable JavaScript to view this page.\nReload", "You need to allow scripts to run this app."] * 3
    return good, filled + filler + errors + notices


def test_records_are_told_apart(spark):
    good, bad = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(good + bad)]
    random.Random(1).shuffle(rows)
    found = {x.id: x.residue for x in r.residue(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set(range(len(good), len(good) + len(bad)))
    assert set(found) == want
    assert set(found.values()) == {"placeholder", "filler", "error_page", "script_notice"}


def test_empty_table_and_parts(spark):
    assert r.residue(spark.createDataFrame([], SCHEMA)).count() == 0
    flat = [s for p in r.paragraphs("# H\n\nOne `x`. Two?\n```\ncode {{ a }}\n```\n&lt;name&gt; three") for s in p]
    assert flat == [("H", True), ("One \x00.", False), ("Two?", False), ("<name> three", True)]
    assert r.is_placeholder("a {{ b }}") and not r.is_placeholder("<s> and </s> and <|x|>")


def test_fit_reads_whole_records(spark, monkeypatch):
    long = " ".join(f"This is sentence number {i} of a very long record." for i in range(2500)) + "\n\n" + "word " * 1000 + "end."
    monkeypatch.setattr(r, "fit", lambda rows: rows)
    rows = r.fitted(spark.createDataFrame([(1, long)], "doc_id long, text string"), "doc_id", "text")
    assert [[(p, x) for p, x, _ in row] for row in rows] == [[x for paragraph in r.paragraphs(long) for x in paragraph]]
    assert len(rows[0]) > 2000 and max(len(p) for p, _, _ in rows[0]) > 2000


def test_the_sample_ends_at_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(r, "fit", lambda rows: rows)
    df = spark.createDataFrame([(i, "One word. " * (50_000 if i == 3 else 10)) for i in range(40)], "doc_id long, text string")
    assert len(r.fitted(df, "doc_id", "text")) == 40
    assert len(r.fitted(df, "doc_id", "text", bound=7)) == 7
    assert len(r.fitted(df, "doc_id", "text", characters=1000)) == 10
    assert r.fitted(df, "doc_id", "text", characters=10) == []


def test_placeholders_of_any_length():
    name = "a" * 84
    long = [f"{{{{ {name} }}}}", "[Insert the name of the product owner and of everybody else who has a say in this matter here]", f"<<{'owner_' * 20}>>", f"${{{name}}}", f"{{% {name} %}}", f"«{name}»"]
    assert all(r.is_placeholder(f"Set {p} first.") for p in long)
    filled = [f"The default is kept by the owner. Set {p} before the router of shard {i} is closed." for i in range(5) for p in long]
    good = ["The default is kept by the owner. Set the queue before the router is closed."] * 60
    model = r.fit([[x for paragraph in r.paragraphs(t) for x in paragraph] for t in good + filled])
    assert [k is not None for k in r.decide(good + filled, model)] == [False] * 60 + [True] * 30


def test_frames_are_found_in_one_pass():
    import time

    for marks in ("{{", "<%", "{%", "[[", "«", "<<", "${", "%(", "$(a", "[a"):
        began = time.time()
        assert not r.is_placeholder(marks * 50_000)
        assert time.time() - began < 5
