import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import additive, neighbours
from docloom.plans.shared import shared_folder

ROWS = "vec_id long, chunk_id string, embedding_version_id int, embedding array<float>, list int"


def data(seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 24))
    near = centres[np.repeat(np.arange(60), 10)] + 0.25 * rng.normal(size=(600, 24))
    return near


def exact(vectors, ids, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    return {(ids[i], ids[j]): scores[i, j] for i in range(len(ids)) for j in np.argsort(-scores[i], kind="stable")[:k]}


@pytest.fixture(scope="module")
def tables(spark):
    vectors = data()
    rows = [(i, "c", 1 + i % 2, [float(x) for x in v * (1 + i % 3)], 0) for i, v in enumerate(vectors)]
    rows += [(900, "c", 1, None, 0), (901, "c", 1, [0.0] * 24, 0), (902, "c", 1, [float("nan")] * 24, 0), (903, "c", 1, [1.0] * 23, 0), (904, "c", 9, [1.0] * 24, 0), (None, "c", 1, [1.0] * 24, 0)]
    versions = spark.createDataFrame([(1, "p", "m", 24), (2, "p", "n", 24), (3, "p", "o", 24)], "embedding_version_id int, provider string, model_name string, dimension int")
    return spark.createDataFrame(rows, ROWS).repartition(3), versions, vectors


def test_recall_against_brute_force(tables):
    df, versions, vectors = tables
    got = {(r.query_id, r.vec_id): r.similarity for r in neighbours.nearest(df, versions, 5).collect()}
    want = {}
    for parity in (0, 1):
        ids = list(range(parity, 600, 2))
        want |= exact(vectors[ids], ids, 5)
    assert len(set(got) & set(want)) / len(want) >= 0.9
    assert all(abs(got[p] - want[p]) < 1e-5 for p in set(got) & set(want))


def test_least_similarity_and_queries(tables):
    df, versions, _ = tables
    some = neighbours.nearest(df, versions, 5, least=0.8, only="vec_id % 20 = 0").collect()
    assert some and all(r.similarity >= 0.8 and r.query_id % 20 == 0 and r.query_id != r.vec_id for r in some)


def wide(spark, vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, "c", 1, [float(x) for x in v], 0) for i, v in enumerate(unit)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, "p", "m", 384)], "embedding_version_id int, provider string, model_name string, dimension int")


def test_pairs_of_a_group_of_a_third_of_all_vectors(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(600, 384))
    vectors = np.concatenate([rng.normal(size=(1200, 384)), 3 * rng.normal(size=384) + noise])
    want = {p for p, s in exact(vectors, list(range(1800)), 5).items() if s >= 0.8}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(*wide(spark, vectors), 5, least=0.8).collect()}
    assert len(want) == 3000 and len(got & want) / len(want) >= 0.95 and len(got - want) <= 3000 - len(got & want)


def test_recall_where_neighbours_are_far(spark):
    rng = np.random.default_rng(6)
    vectors = np.repeat(rng.normal(size=(8, 384)), 250, axis=0) + 1.1 * rng.normal(size=(2000, 384))
    want = {p for p in exact(vectors, list(range(2000)), 5) if p[0] % 20 == 0}
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(*wide(spark, vectors), 5, only="vec_id % 20 = 0").collect()}
    assert len(want) == len(got) == 500 and len(got & want) / 500 >= 0.9


def test_copies_tie_by_id(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(40, 384)), np.repeat(rng.normal(size=(1, 384)), 200, axis=0)])
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(*wide(spark, vectors), 5, least=0.8).collect()}
    assert got == {(q, v) for q in range(40, 240) for v in [v for v in range(40, 46) if v != q][:5]}


def test_no_usable_vector(spark, tables):
    assert neighbours.nearest(spark.createDataFrame([], ROWS), tables[1], 5).count() == 0
    one = spark.createDataFrame([(1, "c", 1, [1.0] * 24, 0)], ROWS)
    assert neighbours.nearest(one, tables[1], 5).count() == 0


def test_quantiser_approximates():
    vectors = data().astype(np.float32)
    model = additive.train(vectors, 8, 16, 4)
    codes = additive.encode(vectors, model)
    error = np.linalg.norm(vectors - model.decode(codes), axis=1)
    assert error.mean() < 0.6 * np.linalg.norm(vectors, axis=1).mean()
    query = vectors[:3]
    tables_ = model.tables(query)
    scores = sum(tables_[b][:, codes[:, b]] for b in range(model.books))
    assert np.allclose(scores, query @ model.decode(codes).T, atol=1e-3)


def test_lists_that_are_split_into_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = np.repeat(rng.normal(size=(20, 384)), 100, axis=0) + 0.7 * rng.normal(size=(2000, 384))
    want = {p for p in exact(vectors, list(range(2000)), 5) if p[0] % 20 == 0}
    df, versions = wide(spark, vectors)
    usable = neighbours.usable_vectors(df, versions)
    models = neighbours.fit(usable)
    table = neighbours.encoded(usable, models).persist()
    got = {(r.query_id, r.vec_id) for r in neighbours.compared(table, table.where("vec_id % 20 = 0"), models, 5, None, list_most=60).collect()}
    assert len(got) == 500 and len(got & want) / 500 >= 0.9


def test_copies_of_chosen_queries(spark):
    rng = np.random.default_rng(9)
    some = rng.normal(size=(30, 384))
    vectors = np.concatenate([some, some[:10], some[:5] + 0.01 * rng.normal(size=(5, 384))])
    got = {}
    for r in neighbours.nearest(*wide(spark, vectors), 3, only="vec_id % 4 = 3").collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
    assert set(got) == {i for i in range(45) if i % 4 == 3} and all(len(v) == 3 for v in got.values())
    assert [v for _, v in sorted(got[3])][:2] == [33, 43] and min(got[43])[1] == 3 and [v for _, v in sorted(got[39])][0] == 9


def test_training_with_thousands_of_lists_stays_small():
    import time
    import tracemalloc

    data_ = np.random.default_rng(1).normal(size=(neighbours.SAMPLE, 128)).astype(np.float32)
    tracemalloc.start()
    began = time.time()
    model = additive.train(data_, 2048, 64, 8)
    assert model.lists == 2048 and [len(w) for w in model.words[1:]] == [64] * 7
    assert tracemalloc.get_traced_memory()[1] < 400e6 and time.time() - began < 120
    tracemalloc.stop()


def test_packed_vectors_are_the_same_at_unit_length():
    rng = np.random.default_rng(11)
    coarse = np.rint(rng.normal(size=(50, 384)) * 200).astype(np.float32) / 4096
    rows = np.concatenate([coarse, 3 * coarse, rng.normal(size=(50, 384)).astype(np.float32), coarse * np.float32(2.0**-130), np.eye(3, 384, dtype=np.float32) * np.float32(-3e38)])
    double = rows.astype(np.float64)
    want = (double / np.linalg.norm(double, axis=1, keepdims=True)).astype(np.float32)
    bytes_ = neighbours.packed(rows)
    assert {len(b) for b in bytes_[:100]} == {769} and {len(b) for b in bytes_[100:150]} == {1536}
    column = pa.array([b"", *bytes_], pa.binary()).slice(1)
    assert np.array_equal(neighbours.unit_rows(column), want)
    assert np.array_equal(neighbours.unit_rows(pa.chunked_array([column.slice(0, 70), column.slice(70)])), want)
    assert neighbours.unit_rows(pa.chunked_array([], pa.binary())).shape == (0, 0)


def test_rounds_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df, versions = wide(spark, np.repeat(rng.normal(size=(20, 384)), 60, axis=0) + 0.7 * rng.normal(size=(1200, 384)))
    usable = neighbours.usable_vectors(df, versions)
    models = neighbours.fit(usable)
    table = neighbours.encoded(usable, models).persist()
    one = set(map(tuple, neighbours.compared(table, table, models, 5, None).collect()))
    monkeypatch.setattr(neighbours, "ROUND", 1)
    assert len(one) == 6000 and set(map(tuple, neighbours.compared(table, table, models, 5, None).collect())) == one


def test_disk_stays_below_four_times_the_vectors(spark, monkeypatch, tmp_path):
    """Of tables written and shuffle files together, while it runs; before, no round ended and each query's copies stayed."""
    monkeypatch.setattr(neighbours, "ROUND", 1, raising=False)
    rng = np.random.default_rng(13)
    df, versions = wide(spark, rng.normal(size=(4000, 384)))
    df.write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    places = [Path(d.getPath()) for d in disk.localDirs()]
    written = Path(shared_folder(spark).removeprefix("file://"))

    def used():
        total = 0
        for p in [*(p for d in places for p in d.rglob("shuffle_*")), *written.rglob("*.parquet")]:
            try:
                total += p.stat().st_size
            except OSError:
                pass
        return total

    seen, over, floor = [], threading.Event(), used()
    watch = threading.Thread(target=lambda: [seen.append(used()) for _ in iter(lambda: over.wait(0.05), True)])
    watch.start()
    try:
        assert neighbours.nearest(df, versions, 5).count() == 20000
    finally:
        over.set()
        watch.join()
    assert max(seen) - floor < 4 * 4000 * 1536, (max(seen) - floor) / (4000 * 1536)
