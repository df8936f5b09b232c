import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import topk

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted(((-int(q @ c), j) for j, c in ok if j != i and len(c) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=5, every=5, **sizes):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 8)) * np.exp(rng.normal(0, spread, (150, 1)))
    v[100:] = v[rng.integers(0, 20, 50)]  # ties
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_coordinates_prune_safely():
    rng = np.random.default_rng(0)
    c = np.floor(256 * rng.normal(size=(900, 4))).astype(np.int64)
    q = c[:50]
    who, which, score = topk.search_block(np.arange(50), q, np.arange(900), c, 3)
    for i in range(50):
        s = c @ q[i]
        want = [j for j in np.lexsort((np.arange(900), -s)) if j != i][:3]
        assert sorted(which[who == i]) == sorted(want) and sorted(score[who == i]) == sorted(s[want])


def test_dominant_coordinates_prune_safely():
    c = np.array([[58, 244]] * 5 + [[215, 0]])
    who, which, score = topk.search_block(np.array([100]), np.array([[230, 100]]), np.arange(6), c, 5)
    assert which[0] == 5 and score[0] == 49450
    rng = np.random.default_rng(1)
    for _ in range(200):
        q = np.array([[1, 0, 0]]) * rng.choice([-1, 1], (3, 1)) + 0.4 * rng.normal(size=(3, 3))
        near = q[rng.integers(0, 3, 40)] * rng.uniform(0.3, 1.2, (40, 1)) + rng.choice([0.05, 0.8], (40, 1)) * rng.normal(size=(40, 3))
        q, c = np.floor(256 * q).astype(np.int64), np.floor(256 * near).astype(np.int64)
        who, which, score = topk.search_block(np.arange(100, 103), q, np.arange(40), c, 5)
        for i in range(3):
            assert sorted(score[who == 100 + i]) == sorted(c @ q[i])[-5:]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, [None, 1.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0]), (25, []), (30, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows, 5, 5)
    assert run(spark, []) == []
    twice = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (0, [1.0, 2.0])]
    assert run(spark, twice) == brute(twice[:2], 5, 5)


def test_large_components(spark):
    rows = [(0, [1.0e7, 2.0]), (1, [1.1e7, 3.0]), (2, [-1.0e7, 1.0]), (3, [0.9e7, 0.5]), (4, [1.0, 1.0])]
    assert run(spark, rows, k=2) == brute(rows, 2, 5)
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [(0, [1.0e30, 1.0]), (1, [1.0e30, 2.0])])


def test_waves_double_and_go_from_the_longest_on():
    buckets = [(8, b, 10, float(b)) for b in range(1, 41)] + [(4, 1, 3, 2.0)]
    found = topk.waves(buckets, 20)
    own = [[b[1] for b in wave if b[0] == 8] for wave in found]
    assert [b for wave in own for b in wave] == list(range(40, 0, -1))
    assert [10 * len(w) for w in own] == [20, 20, 40, 80, 160, 80] and (4, 1, 3, 2.0) in found[0]


def test_clashing_columns_and_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0, 1.0, "x") for i, v in rows], KIND + ", theta double, bucket string")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 5).collect()) == brute(rows, 5, 5)
