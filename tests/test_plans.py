import random
from pathlib import Path

from pyspark.sql import functions as F

from docloom.plans.digests import set_digest
from docloom.plans.ranges import points_in_ranges
from docloom.plans.ranks import positions, prefix_sums, ranks
from docloom.plans.shared import Scratch


def test_prefix_sums_cross_blocks_and_null_groups(spark):
    rows = [("a", i, i % 7) for i in range(50)] + [(None, 3, 5), (None, 1, 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r.g, r.i): r.s for r in prefix_sums(df, ["g"], "i", F.col("v"), "s", block_bits=2).collect()}
    want, run = {}, 0
    for i in range(50):
        want["a", i] = run
        run += i % 7
    assert got == want | {(None, 1): 0, (None, 3): 2}


def test_ranks_of_empty_table(spark):
    assert ranks(spark.createDataFrame([], "g string, i long"), ["g"], "i", "r").count() == 0


def test_points_in_ranges_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randrange(64)) for _ in range(80)] + [(None, 5)]
    ranges = [(rng.choice("ab"), *sorted((rng.randrange(65), rng.randrange(65)))) for _ in range(40)] + [(None, 0, 64)]
    p = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(points)], "pid int, g string, x long")
    r = spark.createDataFrame([(i, g, a, b) for i, (g, a, b) in enumerate(ranges)], "rid int, g string, a long, b long")
    got = sorted((t.pid, t.rid) for t in points_in_ranges(p, r, "g", "x", "a", "b", 7).collect())
    want = sorted((i, j) for i, (g, x) in enumerate(points) for j, (h, a, b) in enumerate(ranges) if g == h and a <= x < b)
    assert got == want


def test_set_digest_ignores_order_and_repetition(spark):
    a = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", None)], "g string, v string")
    b = spark.createDataFrame([("x", "2"), ("x", "1"), ("x", "2")], "g string, v string").repartition(3)
    c = spark.createDataFrame([("x", "1"), ("x", "3")], "g string, v string")
    one, two, three = (set_digest(d, ["g"], F.col("v"), "h").collect() for d in (a, b, c))
    assert one == two and len(one) == 1 and one[0].h != three[0].h


def test_ranks_of_sparse_and_negative_ids(spark):
    rng = random.Random(4)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(ids)], "g int, i long").repartition(5)
    got = {(r.g, r.i): r.r for r in ranks(df, ["g"], "i", "r").collect()}
    assert got == {(g, x): n for g in (0, 1) for n, x in enumerate(sorted(ids[g::2]))}


def test_positions_in_a_whole_table(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(50), i) for i in range(500)]
    rng.shuffle(rows)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r.p, r.a, r.b) for r in positions(df, [F.desc("a"), F.col("b")], "p", scratch, "t").collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])))]
    assert positions(df.limit(0), [F.col("a")], "p", scratch, "e").count() == 0


def test_scratch_tables_go_when_the_result_is_there(spark):
    scratch = Scratch(spark, "test")
    one = scratch.write(spark.range(3), "one")
    scratch.write(one, "two")
    result = scratch.result(one.selectExpr("id * 2 AS x"))
    folder = Path(scratch.root.removeprefix("file://"))
    assert sorted(p.name for p in folder.iterdir()) == ["result"] and result.count() == 3
