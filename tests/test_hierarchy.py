import random
from datetime import datetime, timedelta

import pytest

from docloom.operators.hierarchy import ancestors, build_hierarchy, descendants

SCHEMA = "catalog_id long, topic_id long, qualified_name string, parent_qualified_name string, updated_at timestamp, depth string, path string"
T0 = datetime(2024, 1, 1)


def rows(*items):
    return [(c, t, q, p, T0 + timedelta(seconds=u) if u is not None else None, "clash", "clash") for c, t, q, p, u in items]


def test_roots_cycles_and_names(spark):
    df = spark.createDataFrame(
        rows(
            (1, 1, "a", None, 0), (1, 2, "`A.b` ", " a", 0), (1, 3, "a\\.c", "A.B", 0), (1, 4, "lost", "nowhere", 0), (1, 5, "blank", "  ", 0),
            (1, 6, "x", "y", 0), (1, 7, "y", "x", 0), (1, 8, "below", "x", 0), (1, 9, "self", "self", 0),
            (1, 10, "a", "x", None), (1, 11, "A.b", "a", 5), (1, 12, None, "a", 9), (1, 13, "a.b", "a", 5), (1, 13, "a.b", "a", 5),
            (2, 20, "a.b", "a", 0), (None, 30, "a", None, 0), (None, 31, "k", "a", 0),
        ),
        SCHEMA,
    )
    got = {r.node_id: (r.root_id, r.depth) for r in build_hierarchy(df).collect()}
    assert got == {
        1: (1, 0), 13: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (-1, -1), 7: (-1, -1), 8: (-1, -2), 9: (-1, -1), 20: (20, 0), 30: (30, 0), 31: (30, 1),
    }


def test_empty_table(spark):
    assert build_hierarchy(spark.createDataFrame([], SCHEMA), with_path=True).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 120
    parent = {i: (rng.randrange(max(1, i - 3), i) if i > 1 and rng.random() < 0.93 else None) for i in range(1, n)}
    for i in (100, 110):  # links back close cycles
        parent[i - 5] = i
    df = spark.createDataFrame(rows(*[(1, i, f"n{i}", f"n{p}" if p else None, 0) for i, p in parent.items()]), SCHEMA)
    nodes = build_hierarchy(df, with_path=True)
    got = {r.node_id: r for r in nodes.collect()}

    def walk(i):
        seen = [i]
        while parent[seen[-1]] is not None:
            nxt = parent[seen[-1]]
            if nxt in seen:
                return seen, nxt
            seen.append(nxt)
        return seen, None

    below = {i: set() for i in parent}
    for i in parent:
        seen, loop = walk(i)
        if loop is None:
            assert (got[i].root_id, got[i].depth) == (seen[-1], len(seen) - 1)
            assert got[i].path == [f"n{x}" for x in reversed(seen)]
            for a in seen[1:]:
                below[a].add((i, seen.index(a)))
        else:
            assert (got[i].root_id, got[i].depth) == (-1, -1 if loop == i else -2)
    for i, members in below.items():
        if got[i].root_id != -1:
            assert got[i].range_end - got[i].range_start == len(members) + 1
    asked = nodes.where("node_id % 7 = 0").select("node_id")
    down = sorted((r.node_id, r.descendant_id, r.distance) for r in descendants(nodes, asked).collect())
    assert down == sorted((i, d, k) for i, m in below.items() if i % 7 == 0 for d, k in m)
    up = sorted((r.node_id, r.ancestor_id, r.distance) for r in ancestors(nodes, asked).collect())
    assert up == sorted((d, i, k) for i, m in below.items() for d, k in m if d % 7 == 0)
