import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions.special import digamma
from tidewire.operators import discrete, gaussian, knn, permutation, significance
from tidewire.operators.embedding import index_to_lag, lag_embed, lag_to_index, realisations
from tidewire.sources.series import TimeSeries, array_frame


def test_realisations(spark):
    one = array_frame(spark, np.arange(8.0), "s")
    assert [tuple(r)[2:] for r in realisations(one, 7, [(0, 1)]).collect()] == [(1.0,)]
    two = array_frame(spark, np.arange(9.0), "s")
    assert sorted(r[2] for r in realisations(two, 7, [(0, 1)]).collect()) == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        realisations(two, 3, [(0, 4)])
    with pytest.raises(RuntimeError):
        lag_embed(two, [(0, 3)], 2)


def test_lags_and_indices():
    assert index_to_lag([(1, 3), (2, 0)], 5) == [(1, 2), (2, 5)]
    assert lag_to_index([(1, 2), (2, 5)], 5) == [(1, 3), (2, 0)]
    with pytest.raises(IndexError):
        index_to_lag([(0, 6)], 5)


def test_correlated_gaussians(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=5_000)
    y = 0.4 * x + 0.6 * rng.normal(size=5_000)
    df = spark.createDataFrame(np.stack([x, y, rng.normal(size=5_000)], axis=1).tolist(), "x double, y double, u double")
    want = -0.5 * np.log(1 - 0.16 / 0.52)
    got = df.agg(gaussian.mi_expr("x", "y"), gaussian.cmi_expr("x", "y", "u"), gaussian.mi_expr("x", "u")).first()
    assert abs(got[0] - want) < 0.05 and abs(got[1] - want) < 0.05 and got[2] < 0.01
    _, c = gaussian.covariances(df, ["x", "y", "u"])[None]
    assert abs(gaussian.cmi_of(c, [0], [1]) - got[0]) < 1e-9 and abs(gaussian.cmi_of(c, [0], [1], [2]) - got[1]) < 1e-9
    assert abs(knn.ksg(x[:2_000], y[:2_000]) - want) < 0.05 and abs(knn.ksg(x[:2_000], y[:2_000], df.toPandas()["u"].to_numpy()[:2_000]) - want) < 0.08


@pytest.mark.parametrize("k", range(4, 16))
def test_identical_variables(k):
    x = np.arange(100) + np.random.default_rng(0).normal(0, 1e-6, 100)
    assert abs(knn.ksg(x, x, k=k) - (digamma(k) - 2 * digamma(k) + digamma(100))) < 1e-5
    assert abs(knn.ksg(x, x, k=k, algorithm=2) - (digamma(k) - 1 / k - 2 * digamma(k) + digamma(100))) < 1e-5


def test_nearest_distances():
    one = np.array([[-1.0], [-1.2], [1.0], [1.1]])
    assert np.allclose(knn.neighbours(one, 1, [one])[0], [0.2, 0.2, 0.1, 0.1])
    two = np.array([(-1, -1), (0.5, 0.5), (1.1, 1.1), (2, 2)])
    assert np.allclose(knn.neighbours(two, 1, [two])[0], [1.5, 0.6, 0.6, 0.9])
    with pytest.raises(RuntimeError):
        knn.ksg(np.arange(4.0), np.arange(4.0), k=4)


def test_join_and_kernel_agree(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "rid int, x double, y double")
    got = knn.neighbour_counts(df, [], {"x": ["x"], "y": ["y"]}, 3, theiler=1).orderBy("rid").collect()
    radius, (nx, ny), _ = knn.neighbours(p, 3, [p[:, :1], p[:, 1:]], theiler=1)
    assert np.allclose([r["radius"] for r in got], radius) and [r["n_x"] for r in got] == nx.tolist() and [r["n_y"] for r in got] == ny.tolist()
    grouped = knn.ksg_by_group(df.withColumn("g", F.lit(1)), ["g"], ["x"], ["y"], k=3).first()
    assert abs(grouped["mi"] - knn.ksg(p[:, 0], p[:, 1], k=3)) < 1e-12


def test_discrete_information(spark):
    df = spark.createDataFrame([(a, b, a ^ b) for a in (0, 1) for b in (0, 1)] * 5, "x int, y int, z int")
    assert abs(discrete.cmi(df, ["x"], ["y"]).first()[0]) < 1e-12
    assert abs(discrete.cmi(df, ["x"], ["y"], ["z"]).first()[0] - 1) < 1e-12
    local = [r["local"] for r in discrete.local_cmi(df, ["x"], ["y"], ["z"]).collect()]
    assert len(local) == 20 and abs(np.mean(local) - 1) < 1e-12
    assert abs(discrete.entropy(df, ["x", "y"]).first()[0] - 2) < 1e-12


@pytest.mark.parametrize("how", [permutation.Permutation(), permutation.Permutation("circular", max_shift=10), permutation.Permutation("block", block_size=7, perm_range=4), permutation.Permutation("local", perm_range=3)])
def test_maps_are_permutations(spark, how):
    got = {}
    for r in permutation.sample_map(spark, 50, 5, 1, how).collect():
        got.setdefault(r["perm"], {})[r["i"]] = r["src"]
    assert len(got) == 5
    for m in got.values():
        assert sorted(m) == sorted(m.values()) == list(range(50))
        if how.type == "local":
            assert all(i // 3 == s // 3 for i, s in m.items())
        if how.type == "circular":
            assert 1 <= (50 - m[0]) % 50 <= 10


def test_bad_permutations(spark):
    for how in (permutation.Permutation("odd"), permutation.Permutation("circular"), permutation.Permutation("block", block_size=60, perm_range=2), permutation.Permutation("local", perm_range=1)):
        with pytest.raises(ValueError):
            permutation.sample_map(spark, 50, 1, 1, how)


def test_p_values():
    assert significance.p_value_of(float("inf"), [0.0] * 500, tail="two") == (True, 1 / 500)
    with pytest.raises(RuntimeError):
        significance.p_value_of(1.0, [0.0] * 5, 0.05)
    with pytest.raises(ValueError):
        significance.p_value_of(1.0, [0.0] * 500, tail="foo")


def test_fdr(spark):
    p = [i / 300 for i in range(8)]
    for order in (p, p[::-1], p[3:] + p[:3]):
        want = [x in p[:3] for x in order]
        assert significance.fdr_of(order, 0.05, 2) == want
        df = spark.createDataFrame([(float(x),) for x in order], "p double")
        assert sorted((r["p"], r["significant"]) for r in significance.fdr(df).collect()) == sorted(zip(order, want, strict=True))


def test_table_extremes(spark):
    table = spark.createDataFrame([(c, p, float(v)) for c, row in enumerate([[0, 2, 1], [3, 4, 5], [10, 8, 1]]) for p, v in enumerate(row)], "cand int, perm int, stat double")
    assert [r["stat"] for r in significance.table_extreme(table).orderBy("perm").collect()] == [10.0, 8.0, 5.0]


def test_series_slices(spark):
    ts = TimeSeries.from_array(spark, np.arange(20.0).reshape(2, 10), "ps", normalise=False)
    assert sorted(r["value"] for r in ts.slice(1, 7).collect()) == [17.0, 18.0, 19.0]
    assert ts.n_realisations(3) == 7


def test_slices_of_replications_and_samples(spark):
    x = np.repeat(np.arange(4.0)[:, None], 20, axis=1)
    df = array_frame(spark, x, "rs")
    got = permutation.slice_surrogates(df, 0, permutation.Surrogates(4, 3, 1, axis="repl")).collect()
    for p in range(3):
        rows = {}
        for r in got:
            if r["perm"] == p:
                rows.setdefault(r["repl"], set()).add(r["value"])
        assert sorted(v for s in rows.values() for v in s) == [0.0, 1.0, 2.0, 3.0] and all(len(s) == 1 for s in rows.values())


@pytest.mark.parametrize("dependent", [True, False])
def test_replications_are_swapped_or_dealt(spark, dependent):
    got = permutation.swapped_replications(spark, 5, 4, 1, dependent).collect()
    for p in range(4):
        own = [r for r in got if r["perm"] == p]
        assert sorted((r["group_id"], r["i"]) for r in own) == sorted((r["from_group"], r["src"]) for r in own) == [(g, i) for g in (0, 1) for i in range(5)]
        if dependent:
            assert all(r["i"] == r["src"] for r in own)


def test_helpers():
    from tidewire.functions import helpers

    assert helpers.swap_chars("abc", 0, 2) == "cba" and helpers.descending([1, 3, 2]).tolist() == [3, 2, 1] and helpers.descending_order([1, 3, 3]).tolist() == [1, 2, 0]
    assert helpers.equal_settings({"a": np.arange(2)}, {"a": np.arange(2)}) and helpers.conflicting({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == {"b": (2, 3)}
    with pytest.raises(TimeoutError), helpers.time_limit(1):
        while True:
            pass


def test_wide_covariances_equal_single_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 1e3
    df = spark.createDataFrame([(k % 3, *map(float, row)) for k, row in enumerate(x)], "perm int, a double, b double, c double, d double").repartition(5)
    for by in (None, "perm"):
        one, many = gaussian.covariances(df, list("abcd"), by), gaussian.wide_covariances(df, list("abcd"), by)
        assert one.keys() == many.keys()
        for k in one:
            assert one[k][0] == many[k][0] and np.allclose(one[k][1], many[k][1])


def test_closed_nulls_equal_many_drawn_ones():
    from tidewire.functions.special import chi2_sf

    rng = np.random.default_rng(6)
    table = rng.chisquare([[1], [1], [3]], (3, 40_000))
    drawn = significance.Drawn(table)
    closed = significance.Closed((lambda x: chi2_sf(x, 1), lambda x: chi2_sf(x, 1), lambda x: chi2_sf(x, 3)), 40_000)
    for stat in (0.05, 0.5, 2.0, 6.0):
        for name, args in (("largest", (stat,)), ("smallest", (stat,)), *(("ranked", (r, stat)) for r in range(3))):
            assert abs(getattr(drawn, name)(*args, 0.05)[1] - getattr(closed, name)(*args, 0.05)[1]) < 0.01
    assert closed.of([2]).largest(2.0, 0.05)[1] == pytest.approx(chi2_sf(2.0, 3)) and drawn.of([2]).table.shape == (1, 40_000)
    few = significance.Closed((lambda x: 0.0,), 50)
    assert few.largest(1.0, 0.05) == (True, 1 / 50)
    with pytest.raises(RuntimeError):
        few.largest(1.0, 0.01)
