import hashlib

import numpy as np
import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from tidewire.llm import queries, yinyang

KIND = "vec_id long, embedding array<double>, label int"


def order(vec_id):
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")), 256)


def brute(rows, k, dim, rounds, scale=64):
    """Lloyd's over Python integers: sorted (id, cluster, distance) and the centroids."""
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in by_hash[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for _, v in ok]
        return [(x.index(min(x)), min(x)) for x in d]

    for _ in range(rounds):
        of = [a for a, _ in assign()]
        for j in set(of):
            own = [v for (_, v), a in zip(ok, of, strict=True) if a == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i or -1, a, d) for (i, _), (a, d) in zip(ok, assign(), strict=True))), centroids


def run(spark, rows, k, dim, rounds=3, kind=KIND, **options):
    found = yinyang.yinyang(spark.createDataFrame(rows if kind != KIND else [(*r, 0) for r in rows], kind), k, dim, order, rounds=rounds, **options)
    return sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in found.assigned.collect()), found.centroids, found.passes


@pytest.mark.parametrize(("k", "group_size", "spread"), [(16, 8, 1.0), (16, 4, 0.2), (9, 1, 0.5), (5, 8, 0.01)])
def test_equals_brute_force(spark, k, group_size, spread):
    rng = np.random.default_rng(k + group_size)
    centres = rng.normal(size=(7, 6))
    v = centres[rng.integers(0, 7, 260)] + spread * rng.normal(size=(260, 6))
    v[200:] = v[rng.integers(0, 30, 60)]  # repeated vectors
    rows = [(i + 1, x.tolist()) for i, x in enumerate(v)]
    got, centroids, passes = run(spark, rows, k, 6, group_size=group_size)
    assert (got, centroids) == brute(rows, k, 6, 3)
    assert passes[0] == (260, 260 * k) and all(n == 260 and scans < 260 * k for n, scans in passes[1:])


@pytest.mark.parametrize("seed", range(6))
def test_ties_go_to_the_smaller_number(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (150, 2)) / 64.0  # a small grid: most distances are tied
    rows = [(i + 1, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows, 12, 2, 4, group_size=3)[:2] == brute(rows, 12, 2, 4)


@pytest.mark.parametrize("seed", range(40))
def test_passes_equal_comparing_everything(seed):
    rng = np.random.default_rng(seed)
    n, k, dim = 200, int(rng.integers(1, 20)), int(rng.integers(1, 5))
    v = rng.integers(-6, 7, (n, dim)).astype(float)
    c = rng.integers(-6, 7, (k, dim)).astype(float)
    group = yinyang.grouped(c.tolist(), -(-k // 4))
    cluster, upper, lower, _ = yinyang.first_pass(v, c, group)
    for _ in range(5):
        new = c + rng.integers(-1, 2, (k, dim)) * (rng.random((k, 1)) < 0.6)
        drift = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + yinyang.SLACK)
        c = new
        cluster, upper, lower, _ = yinyang.next_pass(v, c, group, drift, cluster, upper, lower)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(n), cluster])
        assert (upper * (1 + 1e-9) + 1e-9 >= own).all()
        d[np.arange(n), cluster] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= np.sqrt(d[:, group == g].min(axis=1)) + 1e-9).all()


def test_well_parted_vectors_are_filtered(spark):
    rng = np.random.default_rng(0)
    v = 20 * rng.normal(size=(16, 8))[rng.integers(0, 16, 600)] + 0.01 * rng.normal(size=(600, 8))
    rows = [(i + 1, x.tolist()) for i, x in enumerate(v)]
    got, centroids, passes = run(spark, rows, 16, 8)
    assert (got, centroids) == brute(rows, 16, 8, 3) and passes[-1][1] < 0.3 * passes[0][1]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [-1.0, 0.5]), (None, [3.0, 3.0]), (9, [0.0, -0.0])]
    assert run(spark, rows, 3, 2)[:2] == brute(rows, 3, 2, 3)
    assert run(spark, rows, 100, 2)[:2] == brute(rows, 100, 2, 3)
    assert run(spark, [], 3, 2) == ([], [], [])
    assert yinyang.with_inertia(yinyang.yinyang(spark.createDataFrame([], KIND), 3, 2, order)).count() == 0


def test_large_components(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([(1e7, 3), (1.2e7, -4), (-1e7, 8), (0.9e7, 1), (5, 5), (1.1e7, 0.25)], 1)]
    assert run(spark, rows, 3, 2)[:2] == brute(rows, 3, 2, 3)
    with pytest.raises(Exception, match="doesn't fit a long"):
        run(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.0])], 1, 2)
    with pytest.raises(OverflowError, match="exact sums"):
        run(spark, [(1, [1e300, 0.0]), (2, [1e300, 0.0])], 1, 2)
    with pytest.raises(ValueError, match="above"):
        run(spark, rows, 1 << 22, 64)


def test_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i + 1, rng.normal(size=3).tolist()) for i in range(40)]
    more = [(*r, "x", 1.5, [0.0]) for r in rows]
    assert run(spark, more, 4, 3, kind="vec_id long, embedding array<double>, cluster string, upper double, v array<double>")[:2] == brute(rows, 4, 3, 3)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(queries.op11_centroids(spark, sf)) == rows_of_sql(connect(sf), queries.SQL["op11_centroids"])
