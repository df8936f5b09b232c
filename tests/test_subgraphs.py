import itertools

import numpy as np
import pytest

from tidewire.functions.bijection import key_number, places
from tidewire.functions.ranks import numbered
from tidewire.plans import subgraphs

KIND = "group_id int, subject int, link_id int"


def dense(n_a, n_b, links, seed, share=0.8):
    rng = np.random.default_rng(seed)
    held = rng.random((n_a + n_b, links)) < share
    held[:n_a, 0] |= rng.random(n_a) < 0.9
    return [(int(s >= n_a), s - (s >= n_a) * n_a, k) for s in range(n_a + n_b) for k in range(links) if held[s, k]], held


@pytest.mark.parametrize("design", subgraphs.DESIGNS)
def test_dense_graphs_equal_brute_force(spark, design):
    n, links = 9, 9
    rows, held = dense(n, n, links, 3)
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), n, n, design=design)
    want = {}
    for size in range(1, links + 1):
        for own in itertools.combinations(range(links), size):
            has = held[:, own].all(axis=1)
            a, b = has[:n], has[n:]
            if has.any():
                want[own] = (int(a.sum()), int(has.sum())) if design == "between" else (int((a & ~b).sum()), int((a ^ b).sum()))
    got = {tuple(r["links"]): r for r in mining.counted().collect()}
    assert {k: (r["in_a"], r["total"]) for k, r in got.items()} == want and len(want) > 300
    for r in got.values():
        assert abs(r["p_value"] - subgraphs.p_of(design, n, n, r["in_a"], r["total"])) < 1e-9
    low = sorted(subgraphs.min_p(design, n, n, t) for _, t in want.values())
    assert mining.tarone_factor() == next(k for k in range(1, len(low) + 1) if sum(p <= 0.05 / k for p in low) <= k)


@pytest.mark.parametrize(("n_a", "n_b"), [(7, 5), (6, 6)])
def test_p_values_of_all_tables(n_a, n_b):
    for total in range(n_a + n_b + 1):
        p = subgraphs.p_values("between", n_a, n_b, total)
        for a in range(max(0, total - n_b), min(total, n_a) + 1):
            assert abs(p[a] - subgraphs.p_of("between", n_a, n_b, a, total)) < 1e-9
    for total in range(8):
        assert np.allclose(subgraphs.p_values("within", 7, 7, total), [subgraphs.p_of("within", 7, 7, a, total) for a in range(total + 1)])


def test_permuted_groups_equal_brute_force(spark, monkeypatch):
    n_a, n_b, links, perms, seed = 12, 9, 6, 400, 5
    rows, held = dense(n_a, n_b, links, 8, 0.5)
    held[n_a + n_b - 1] = False  # a graph without links
    rows = [r for r in rows if (r[0], r[1]) != (1, n_b - 1)]
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), n_a, n_b, alpha=0.3)
    least = mining.least_for(0.3)
    best = np.full(perms, np.inf)
    for perm in range(perms):
        a = np.arange(n_a + n_b) < n_a if not perm else places(np.arange(n_a + n_b), n_a + n_b, key_number(seed, perm)) < n_a
        for size in range(1, links + 1):
            for own in itertools.combinations(range(links), size):
                has = held[:, own].all(axis=1)
                if has.sum() >= least:
                    best[perm] = min(best[perm], subgraphs.p_values("between", n_a, n_b, int(has.sum()))[int((has & a).sum())])
    level = 0.0
    for p in np.unique(best[np.isfinite(best)]):
        if (best <= p).sum() / perms > 0.3:
            break
        level = p
    for bits in (subgraphs.LABEL_BITS, 64 * 150):
        monkeypatch.setattr(subgraphs, "LABEL_BITS", bits)
        assert abs(mining.westfall_young_level(perms, seed) - level) < 1e-12 and level > 0


def test_permutations_of_pairs_keep_the_level(spark):
    rows = [(0, s, 0) for s in range(12)] + [(g, s, 1 + (s + g) % 3) for g in (0, 1) for s in range(12)]
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), 12, 12, design="within")
    assert 0 < mining.westfall_young_level(500, 2) <= 0.05


def test_sizes_can_be_bounded_and_tables_empty(spark):
    rows, _ = dense(5, 5, 5, 1)
    df = spark.createDataFrame(rows, KIND)
    assert max(len(r["links"]) for r in subgraphs.SubgraphMining(df, 5, 5, most_links=2).totals().collect()) == 2
    none = subgraphs.SubgraphMining(df.limit(0), 5, 5)
    assert none.totals().count() == 0 and none.tarone_factor() == 1 and none.westfall_young_level(100, 1) == 0.0


def test_numbers_over_a_whole_table(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))})
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "a int, b int").repartition(6)
    for parts in (1, 5, 50):
        assert [tuple(r) for r in numbered(df, ["a", "b"], "k", parts).orderBy("k").collect()] == [(*r, k) for k, r in enumerate(rows)]


def test_tails_of_large_populations_need_no_exact_binomials():
    import time

    from tidewire.functions.special import binomial_pmf, hypergeometric_pmf

    assert abs(binomial_pmf(2000, 4000) * np.sqrt(np.pi * 2000) - 1) < 1e-3
    assert abs(hypergeometric_pmf(30_000, 240_000, 60_000, 120_000) / (1 / np.sqrt(2 * np.pi * 120_000 / 4 * 0.75 / 2)) - 1) < 1e-3
    begin = time.time()
    low = [subgraphs.min_p("between", 70_000, 170_000, t) for t in range(1, 30_000, 10)]
    assert time.time() - begin < 5 and low == sorted(low, reverse=True)
    p = subgraphs.p_values("between", 700_000, 1_700_000, 20_000)
    assert len(p) == 20_001 and p[0] == 0.0 and 0.9 < p.max() < 1.1


@pytest.mark.parametrize("design", subgraphs.DESIGNS)
def test_copies_of_graphs_are_one_pattern(spark, design):
    rows, _ = dense(6, 6, 14, 4, 0.3)
    once = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), 6, 6, design=design)
    copies = subgraphs.SubgraphMining(spark.createDataFrame([(g, s + 100 * c, k) for g, s, k in rows for c in range(50)], KIND), 300, 300, design=design)
    assert copies.graphs.count() > 25 * once.graphs.count() and copies.patterns.count() == once.patterns.count()
    want = {tuple(r["links"]): (50 * r["in_a"], 50 * r["total"]) for r in once.totals().collect()}
    assert {tuple(r["links"]): (r["in_a"], r["total"]) for r in copies.totals().collect()} == want
    for size in (1, 20):  # sums over supersets, and growth by single links, of few and of many links
        part = subgraphs.SubgraphMining(spark.createDataFrame([(g, s, k * size) for g, s, k in rows], KIND), 6, 6, design=design, most_links=3)
        assert {tuple(k // size for k in r["links"]) for r in part.totals().collect()} == {k for k in want if len(k) <= 3}


def test_sets_of_many_links_grow_like_sums(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(s % 2), s, int(k)) for s in range(40) for k in np.unique(rng.integers(0, 60, 7))]
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), 20, 20)
    found = sorted((r["links"], r["in_a"], r["total"]) for r in mining.totals().collect())
    monkeypatch.setattr(subgraphs, "SUMMED", 0)
    assert sorted((r["links"], r["in_a"], r["total"]) for r in mining.totals().collect()) == found and len(found) > 1000


def test_hommel_level_equals_its_definition(spark):
    rng = np.random.default_rng(3)
    for trial in range(6):
        n = int(rng.integers(5, 60))
        p = np.round(rng.random(n) ** rng.choice([1, 4]) * rng.choice([0.06, 1.0]), 4) + 1e-9
        order = sorted(p.tolist())
        j = next((m for m in range(n, 0, -1) if all(order[n - m + i - 1] > i * 0.05 / m for i in range(1, m + 1))), 0)
        level = 0.05 / j if j else 0.05
        df = spark.createDataFrame([([k], float(x)) for k, x in enumerate(p)], "links array<int>, p_value double")
        got = subgraphs.hommel(df, n, 0.05)
        assert got.count() == sum(x <= 0.05 / n or x <= level for x in order)
        for r in got.collect():
            assert abs(r["p_value"] - p[r["links"][0]] * 0.05 / max(level, 0.05 / n)) < 1e-12
    many = spark.range(30_000).selectExpr("array(cast(id as int)) AS links", "(id + 1) * 0.05 / 30001 AS p_value")
    assert subgraphs.hommel(many, 30_000, 0.05).count() == 30_000


def test_permuted_pairs_equal_brute_force_in_blocks(spark, monkeypatch):
    n, links, perms, seed = 30, 4, 60, 4
    rows, held = dense(n, n, links, 6, 0.5)
    monkeypatch.setattr(subgraphs, "PERMS_AT_ONCE", 25)
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, KIND), n, n, alpha=0.2, design="within")
    best = np.full(perms, np.inf)
    for perm in range(perms):
        swapped = subgraphs.mixed_bits(np.arange(n), key_number(seed, perm)) > 0 if perm else np.zeros(n, dtype=bool)
        for size in range(1, links + 1):
            for own in itertools.combinations(range(links), size):
                a, b = held[:n, own].all(axis=1), held[n:, own].all(axis=1)
                t = int((a ^ b).sum())
                if (a | b).any() and subgraphs.min_p("within", n, n, t) <= 0.2:
                    best[perm] = min(best[perm], subgraphs.p_values("within", n, n, t)[int((np.where(swapped, b, a) & ~np.where(swapped, a, b)).sum())])
    got = {r["perm"]: r["p"] for r in mining._smallest(perms, seed, 0.2).collect()}
    assert np.allclose([got[k] for k in range(perms)], best)
    level = max((p for p in np.unique(best) if (best <= p).sum() / perms <= 0.2), default=0.0)
    monkeypatch.setattr(subgraphs, "GUESS_PERMS", 3)  # a poor guess leads to another search, not to another level
    assert abs(mining.westfall_young_level(perms, seed) - level) < 1e-12
