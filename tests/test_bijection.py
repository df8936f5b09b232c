import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import bijection


@pytest.mark.parametrize("key", [0, 12_345, bijection.MASK])
def test_every_number_has_one_place(key):
    for n in range(1, 5_001):
        x = bijection.places(np.arange(n), n, key)
        assert len(np.unique(x)) == n and x.max() == n - 1


def test_expression_equals_numpy(spark):
    rows = [(n, p, i) for n in (1, 2, 3, 5, 24, 100, 720, 1_001) for p in range(3) for i in range(n)]
    df = spark.createDataFrame(rows, "n long, p int, i int")
    for n in (F.col("n"), None):
        own = df if n is not None else df.where("n = 720")
        got = bijection.with_bijection(own, "to", F.col("i"), 720 if n is None else n, bijection.key_of(9, F.col("p"))).collect()
        for r in got:
            assert r["to"] == bijection.places(r["i"], r["n"], bijection.key_number(9, r["p"]))


def test_places_look_shuffled():
    """Each item comes to each place about as often, and neighbours don't stay neighbours."""
    n, keys = 12, 6_000
    seen = np.zeros((n, n))
    together = 0
    for k in range(keys):
        x = bijection.places(np.arange(n), n, bijection.key_number(1, k))
        seen[np.arange(n), x] += 1
        together += (np.abs(np.diff(x)) == 1).sum()
    want = keys / n
    assert ((seen - want) ** 2 / want).sum() < 1.5 * (n - 1) ** 2
    assert abs(together / keys - 2 * (n - 1) / n) < 0.25


def test_many_keys_at_once():
    got = bijection.places(np.arange(50), 50, np.arange(20)[:, None])
    assert got.shape == (20, 50) and all((got[k] == bijection.places(np.arange(50), 50, k)).all() for k in range(20))


def test_tables_give_the_same_places():
    import numpy as np

    from tidewire.functions.bijection import places, places_by_key

    for n in (1, 2, 7, 255, 1000, 30_011):
        i = np.arange(n)
        for key in (0, 5, 2**31 - 1):
            assert (places_by_key(i, n, key) == places(i, n, key)).all()
        assert (places_by_key(i[: n // 2], n, 9) == places(i[: n // 2], n, 9)).all()
