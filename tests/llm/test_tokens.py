import random

import numpy as np
import pytest

from docloom.llm import packing, tokens

pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(5)
    words = ["the", "naïve", "don't", "x" * 40, "ありがとう", "12345", "  ", "\n\n", "\t", "<|endoftext|>", "🚀", "a_b", "'re"]
    out = ["", " ", "a", "don't", "<|endoftext|>", "z" * 9000, "あ" * 5000, " \n" * 3000, "it's " * 2000]
    return out + ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.choice([3, 80, 900]))) for _ in range(60)]


def test_ids_equal_plain_encoding(spark):
    encode = tokens.tokenizer().encode_ordinary
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(900, None, 1), (901, None, 1), (5, "repeated id", 1), (None, "no id", 1)]
    rows += [(1000 + i, "one shared text that many documents hold " * 8, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner int").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == sorted((i is None, i or 0, encode(t or "")) for i, t, _ in rows)
    assert tokens.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rough_joints_are_repaired():
    rng, encode, most = random.Random(3), tokens.tokenizer().encode_ordinary, tokens.MOST
    tokens.MOST = 150
    try:
        for alphabet in ("ab'r 9.", "あいう、。x ", "a", "é \n\t'", "  a", "🚀a'"):
            for size in (5, 300, 2000):
                text = "".join(rng.choice(alphabet) for _ in range(size))
                out, group, start = [], [], 0
                for end, clean in tokens.chunk_ends(text):
                    group.append((np.array(encode(text[start:end]), dtype=np.int64), text[start:end]))
                    start = end
                    if clean:
                        out += (group[0][0] if len(group) == 1 else tokens.join_rough(group)).tolist()
                        group = []
                assert out == encode(text)
    finally:
        tokens.MOST = most


def test_equal_stretches_give_equal_chunks():
    shared = " ".join(f"word{i}" for i in range(3000))
    a, b = (f"{head} {shared}" for head in ("one start", "quite another start, longer"))

    def cut(text):
        ends = [0, *(e for e, _ in tokens.chunk_ends(text))]
        return {text[x:y] for x, y in zip(ends, ends[1:], strict=False)}

    assert len(cut(a) & cut(b)) > 0.8 * len(cut(a))


def pack(spark, sizes, **options):
    df = spark.createDataFrame([(i, n, i) for i, n in enumerate(sizes)], "doc_id long, n int, rank int")
    return packing.pack(df, **options).collect()


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    sizes = [rng.choice([rng.randrange(1, 90), rng.randrange(1, 1400), 700, 2048, 2049, 5000]) for _ in range(3000)] + [0, None, -1] + [300] * 1500
    got = pack(spark, sizes)
    used, parts = {}, {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.token_end - r.token_start
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.token_end))
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    for i, n in enumerate(sizes):
        pieces = sorted(parts.get(i, []))
        assert sum(b - a for _, a, b in pieces) == max(0, n or 0)
        assert len(pieces) == -(-max(0, n or 0) // 2048)
    assert sum(used.values()) / (2048 * len(used)) > 0.97
    assert pack(spark, []) == [] and pack(spark, [0]) == []


def test_bounds_are_optimal():
    rng = random.Random(6)
    histogram = {s: rng.randrange(1, 9) for s in rng.sample(range(1, 40), 9)}

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in histogram.items())

    from itertools import combinations

    sizes = sorted(histogram)
    best = min(padding([*c, sizes[-1]]) for k in range(3) for c in combinations(sizes[:-1], k))
    assert padding(packing.bucket_bounds(histogram, 3)) == best
    assert packing.bucket_bounds({}, 3) == []


def test_bounds_of_many_sizes_are_optimal_and_quick():
    import time

    rng = random.Random(8)
    for n, buckets in ((1, 1), (2, 1), (7, 3), (40, 5), (41, 40), (65, 9)):
        histogram = {s: rng.randrange(1, 50) for s in rng.sample(range(1, 400), n)}
        sizes = sorted(histogram)

        def cost(i, j, sizes=sizes, histogram=histogram):
            return sum(histogram[s] * (sizes[j - 1] - s) for s in sizes[i:j])

        best = [0.0] + [cost(0, j) for j in range(1, n + 1)]
        for _ in range(buckets - 1):
            best = [0.0] + [min(best[i] + cost(i, j) for i in range(j)) for j in range(1, n + 1)]
        bounds = packing.bucket_bounds(histogram, buckets)
        assert len(bounds) <= buckets
        assert sum(c * (min(b for b in bounds if b >= s) - s) for s, c in histogram.items()) == best[n]
    began = time.time()
    packing.bucket_bounds({s: rng.randrange(1, 1000) for s in range(1, 8193)}, 512)
    assert time.time() - began < 15
