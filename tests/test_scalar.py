import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import special
from tidewire.functions.scalar import digamma_table, equal_width, max_entropy, psi, radix, standardise
from tidewire.sources.series import TimeSeries, array_frame, spike_trains


def values(df):
    return [r["value"] for r in df.orderBy("sample").collect()]


def series(spark, x):
    return array_frame(spark, np.asarray(x), "s")


@pytest.mark.parametrize(("x", "want"), [([1.1, 0.55, 0.0], [1, 1, 0]), ([1.1, 0.54, 0.0], [1, 0, 0]), ([1.0, 0.9, 0.8, 0.0], [1, 1, 1, 0])])
def test_equal_width(spark, x, want):
    assert values(equal_width(series(spark, x), 2)) == want


@pytest.mark.parametrize(("x", "want"), [([1.0, 0.9, 0.8, 0.0], [1, 1, 0, 0]), ([1.0, 0.8, 0.8, 0.0], [1, 0, 0, 0])])
def test_max_entropy(spark, x, want):
    assert values(max_entropy(series(spark, x), 2)) == want


def test_radix(spark):
    df = spark.createDataFrame([(1, 0, 1), (0, 1, 0)], "a int, b int, c int")
    assert sorted(r[0] for r in df.select(radix(["a", "b", "c"], 2)).collect()) == [2, 5]
    assert sorted(r[0] for r in df.select(radix(["a", "b", "c"], 3)).collect()) == [3, 10]
    with pytest.raises(ArithmeticError):
        radix(["a"] * 64, 2)


def test_standardise(spark):
    got = np.array(values(standardise(series(spark, [1.0, 2.0, 3.0, 6.0]))))
    assert abs(got.mean()) < 1e-12 and abs(got.std(ddof=1) - 1) < 1e-12
    assert values(standardise(series(spark, [2.0, 2.0]))) == [0.0, 0.0]


def test_digamma(spark):
    table = {r["n"]: r["psi"] for r in digamma_table(spark, 40).collect()}
    expr = {r["n"]: r["p"] for r in spark.range(1, 41).select(F.col("id").alias("n"), psi(F.col("id")).alias("p")).collect()}
    for n in range(1, 41):
        assert abs(table[n] - special.digamma(n)) < 1e-10
        assert abs(expr[n] - table[n]) < 1e-10


@given(st.floats(0.01, 0.99), st.integers(1, 40))
def test_chi2_quantiles(p, dof):
    assert abs(1 - special.chi2_sf(special.chi2_ppf(p, dof), dof) - p) < 1e-9
    assert np.allclose(special.chi2_quantiles(np.array([p, p / 2]), dof), [special.chi2_ppf(p, dof), special.chi2_ppf(p / 2, dof)], rtol=1e-7)


def test_array_dimensions(spark):
    ts = TimeSeries.from_array(spark, np.arange(24.0).reshape(4, 3, 2), "srp", normalise=False)
    assert ts.sizes == (2, 4, 3)
    assert ts.to_array()[1, 3, 2] == 23
    with pytest.raises(RuntimeError):
        TimeSeries.from_array(spark, np.arange(4.0), "ps")


def test_spikes_count_from_the_first(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 3.0), (1, 2.0)], "proc int, t double")
    assert sorted(map(tuple, spike_trains(df).collect())) == [(0, 0.0), (0, 2.0), (1, 0.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=12, unique=True), st.integers(2, 3))
def test_max_entropy_bins_are_balanced(spark, x, bins):
    counts = np.bincount(values(max_entropy(series(spark, x), bins)), minlength=bins)
    assert counts.sum() == len(x) and counts.max() - counts.min() <= 1
