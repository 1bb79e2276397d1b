import random

import pytest

from docloom.llm import dedup

GROUPS = [
    ["Set the Limit, to 3.", "set the limit to 3", "SET​ THE-LIMIT (to) 3!"],
    ["key: a b\nother: c", "- other: C.\n- Key: a, b", '{"other": "c", "key": "a b"}'],
    ["straße 1", "STRASSE 1"],
]
ALONE = ["key: c\nother: a b", "other: c, key: a b", "limit the set to 3", "", None, " * * * ", "---", "{}", '{"a": 1', "note: one line only"]


def table(spark, extra=()):
    texts = [t for g in GROUPS for t in g] + ALONE + list(extra)
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "load_seq long, content string, key string, id long")


def run(df, batches=2):
    scratch = dedup.Scratch(df.sparkSession, "test")
    keys = scratch.write(dedup.content_keys(df), "keys")
    ledger = dedup.ledger_of(keys, f"{scratch.root}/ledger", batches)
    return ledger, sorted((r.keep_id, r.copy_id) for r in dedup.copies(keys, ledger).collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_groups_of_copies(spark, batches):
    _, pairs = run(table(spark), batches)
    assert pairs == [(0, 1), (0, 2), (3, 4), (3, 5), (6, 7)]


def test_hot_group_is_found_whole(spark):
    df = table(spark, ["Hot text."] * 400 + ["HOT text"] * 100)
    ledger, pairs = run(df)
    first = len(GROUPS[0]) + len(GROUPS[1]) + len(GROUPS[2]) + len(ALONE)
    assert [c for k, c in pairs if k == first] == list(range(first + 1, first + 500))
    assert max(r.copies for r in ledger.current().collect()) == 500


def test_a_later_session_adds_to_touched_buckets_only(spark):
    ledger, _ = run(table(spark), 1)
    before = ledger.state()["places"]
    later = dedup.Ledger(spark.newSession(), ledger.root)
    batch = dedup.content_keys(spark.createDataFrame([(900, "Set the limit to 3"), (901, None)], "load_seq long, content string"))
    assert later.add(batch, "day 2") and not later.add(batch, "day 2")
    after = later.state()["places"]
    assert len([b for b in after if after[b] != before.get(b)]) == 1
    assert sorted(r.copies for r in later.current().where("first_id = 0").collect()) == [4]
    assert later.add(batch.limit(0), "empty") and sorted(r.copies for r in ledger.current().where("first_id = 0").collect()) == [4]
    later.vacuum(1)
    assert sorted(r.copies for r in ledger.current().where("first_id = 0").collect()) == [4]


def test_buckets_double_as_the_ledger_grows(spark):
    df = spark.createDataFrame([(i, f"text {i % 150}") for i in range(300)], "load_seq long, content string")
    keys = dedup.content_keys(df)
    ledger = dedup.ledger_of(keys, f"{dedup.Scratch(spark, 'test').root}/ledger", 2, bucket_keys=2)
    state = ledger.state()
    assert state["bits"] > dedup.LEAST_BITS and sum(state["keys"].values()) == 150 and len(state["batches"]) == 2
    assert {(r.first_id, r.copies) for r in ledger.current().collect()} == {(i, 2) for i in range(150)}


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "load_seq long, content string"))[1] == []


def test_fields():
    assert dedup.fields_of('{"a": ["b", 1], "c": "d"}') == [("a", "b1"), ("c", "d")]
    assert dedup.canonical('{"a": {"x": 1, "y": "Z"}, "b": []}') == dedup.canonical('{"b": [], "a": {"y": "z", "x": 1}}')
    assert dedup.canonical('{"a": {"x": 1, "y": 2}}') != dedup.canonical('{"a": {"x": 2, "y": 1}}')
    assert dedup.fields_of("a: 1\ntext") is None and dedup.fields_of("[1]") is None
    assert dedup.canonical("1. a: x\n2. b: y") == dedup.canonical("b: y\na: x")
