import numpy as np
import pytest

from tidewire.plans import comparison, history, pid, results, subgraphs
from tidewire.plans.estimators import estimator_names, get_estimator, register
from tidewire.plans.inference import InformationStorage, NetworkInference, StorageResult, TargetResult, max_sequential, network_fdr, resume, storage_fdr
from tidewire.sources import generators
from tidewire.sources.series import TimeSeries

FEW = dict(n_perm_max_stat=21, n_perm_min_stat=21, n_perm_omnibus=21, n_perm_max_seq=21, n_perm_mi=21)


@pytest.fixture(scope="module")
def coupled(spark):
    rng = np.random.default_rng(0)
    x, u = rng.normal(size=(2, 600))
    y = np.r_[0, 0.4 * x[:-1]] + 0.6 * rng.normal(size=600)
    return TimeSeries.from_array(spark, np.stack([x, u, y]), "ps")


@pytest.mark.parametrize("multivariate", [True, False])
@pytest.mark.parametrize("measure", ["te", "mi"])
def test_only_the_driver_is_found(coupled, measure, multivariate):
    s = dict(estimator="gaussian", max_lag_sources=1, permute_in_time=True, **FEW)
    found = NetworkInference(measure, multivariate).analyse_single_target(s, coupled, 2)
    assert found.selected_vars_sources == [(0, 1)] and found.omnibus_sign
    assert abs(found.link_stat[0] + 0.5 * np.log(1 - 0.16 / 0.52)) < 0.06


def test_permuted_discrete_and_kernel_estimators(coupled):
    for s in (dict(estimator="discrete", estimator_options=dict(discretise_method="max_ent", n_bins=2)), dict(estimator="kraskov", estimator_options=dict(k=4))):
        found = NetworkInference("mi").analyse_single_target({**s, "max_lag_sources": 1, **FEW}, coupled, 2)
        assert found.selected_vars_sources == [(0, 1)]


def test_registered_estimator(coupled):
    register("corr", lambda x, y, z, **o: abs(float(np.corrcoef(x[:, 0], y[:, 0])[0, 1])))
    assert "corr" in estimator_names()
    found = NetworkInference("mi", False).analyse_single_target(dict(estimator="corr", max_lag_sources=1, **FEW), coupled, 2, [0])
    assert found.selected_vars_sources == [(0, 1)]
    with pytest.raises(RuntimeError):
        get_estimator("none such")


def test_storage(spark):
    rng = np.random.default_rng(5)
    x = np.zeros(500)
    for t in range(2, 500):
        x[t] = 0.95 * 2**0.5 * x[t - 1] - 0.9025 * x[t - 2] + rng.normal()
    ts = TimeSeries.from_array(spark, np.stack([x, rng.normal(size=500)]), "ps")
    got = InformationStorage().analyse_network(dict(estimator="gaussian", max_lag=2, permute_in_time=True, **FEW), ts)
    assert got[0].ais_sign and got[0].ais > 0.5 and not got[1].ais_sign


def test_replications_are_permuted_where_there_are_enough(spark):
    ts = TimeSeries.from_frame(generators.autoregressive(spark, np.array([[[0.5, 0.0], [0.6, 0.5]]]), 40, 10))
    found = NetworkInference("te").analyse_single_target(dict(estimator="gaussian", max_lag_sources=1, **FEW), ts, 1)
    assert (0, 1) in found.selected_vars_sources
    with pytest.raises(RuntimeError):
        generators.autoregressive(spark, np.array([[[1.5]]]))


@pytest.mark.parametrize(("change", "error"), [(dict(max_lag_sources=None), RuntimeError), (dict(min_lag_sources=3), RuntimeError), (dict(tau_sources=0), RuntimeError), (dict(estimator=None), RuntimeError), (dict(alpha_max_stat=2), ValueError), (dict(n_perm_omnibus=5), RuntimeError), (dict(what=1), RuntimeError)])
def test_bad_settings(coupled, change, error):
    with pytest.raises(error):
        NetworkInference().analyse_single_target({**dict(estimator="gaussian", max_lag_sources=2, **FEW), **change}, coupled, 2)


def test_bad_targets(coupled):
    s = dict(estimator="gaussian", max_lag_sources=1, **FEW)
    for target, sources in ((3, "all"), (-1, "all"), (0, [0]), (0, [5])):
        with pytest.raises(RuntimeError):
            NetworkInference().analyse_single_target(s, coupled, target, sources)


def test_progress_is_kept(spark, coupled, tmp_path):
    path = str(tmp_path / "progress")
    s = dict(estimator="gaussian", max_lag_sources=1, permute_in_time=True, checkpoint_path=path, **FEW)
    found = NetworkInference("te").analyse_single_target(s, coupled, 2)
    kept = resume(spark, path)
    assert (0, 1) in kept[2]
    again = NetworkInference("te").analyse_single_target({**s, "checkpoint_path": None, "add_conditionals": kept}, coupled, 2)
    assert again.selected_vars_sources == found.selected_vars_sources


def test_sequential_ranks():
    table = np.tile(np.linspace(0, 1, 100), (3, 1))
    assert max_sequential(np.array([2.0, 0.5, 3.0]), table, 0.05)[0] == [True, False, True]
    assert max_sequential(np.array([2.0, 0.5, 3.0]), table, 0.05, keep_failing_p=False)[1][1] == 1.0


def target(t, p):
    return TargetResult(t, [5], 1, [(t, 1)], [(5, 1)], [1.0], [p], 1.0, p, True, {5: 1.0})


def test_network_fdr():
    got = network_fdr(dict(n_perm_omnibus=2_000, n_perm_max_seq=2_000, max_lag_sources=1), [target(k, p) for k, p in enumerate((0.0001, 0.031, 0.41))])
    assert [bool(r.selected_vars_sources) for r in got] == [True, False, False] and got[1].omnibus_pval == 1
    assert network_fdr(dict(n_perm_omnibus=2), [target(0, 0.01)]) is None
    kept = storage_fdr(dict(n_perm_mi=1_000), [StorageResult(k, [(k, 1)], 1.0, p, True) for k, p in enumerate((0.0001, 0.031, 0.41))])
    assert [r.ais_sign for r in kept] == [True, False, False]


def test_results(spark):
    v = spark.createDataFrame([(1, 0, 1, 0.2, 0.03), (1, 0, 2, 0.5, 0.04), (2, 0, 3, 0.1, 0.01)], "target int, source int, lag int, stat double, pval double")
    assert sorted(map(tuple, results.adjacency(v, "max_te_lag").collect())) == [(0, 1, 2), (0, 2, 3)]
    assert sorted(map(tuple, results.adjacency(v, "max_p_lag").collect())) == [(0, 1, 1), (0, 2, 3)]
    assert sorted(map(tuple, results.adjacency(v, "vars_count").collect())) == [(0, 1, 2), (0, 2, 1)]
    with pytest.raises(RuntimeError):
        results.adjacency(v, "odd")
    with pytest.raises(RuntimeError):
        results.combine([target(1, 0.1)], [target(1, 0.2)])


def test_brain_net_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2)], "source int, target int, weight int")
    results.write_brain_net(edges, [(0, 0, 0), (1, 2, 3)], str(tmp_path / "net"), labels=["a b", "c"])
    assert (tmp_path / "net.edge").read_text() == "0\t2\n0\t0\n" and "ab" in (tmp_path / "net.node").read_text()


def gate(f):
    p = np.zeros((2, 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            p[f(a, b), a, b] = 0.25
    return p


def test_two_source_gates():
    assert abs(pid.two_source(gate(lambda a, b: a & b))["syn_s1_s2"] - 0.5) < 1e-4
    assert abs(pid.two_source(gate(lambda a, b: a ^ b))["syn_s1_s2"] - 1) < 1e-6
    copy = pid.two_source(gate(lambda a, b: a))
    assert abs(copy["unq_s1"] - 1) < 1e-7 and max(abs(copy[k]) for k in ("unq_s2", "shd_s1_s2", "syn_s1_s2")) < 1e-7


def atoms(spark, n, f):
    rows = [(*map(int, s), f(*s)) for s in np.ndindex(*[2] * n)]
    df = spark.createDataFrame(rows, ", ".join([*(f"s{k + 1} int" for k in range(n)), "t int"]))
    return df, {r["alpha"]: r["pi"] for r in pid.decompose(df, n).collect()}


def test_shared_exclusions(spark):
    df, got = atoms(spark, 2, lambda a, b: a & b)
    assert abs(got["{1}{2}"] - 0.12255624891826572) < 1e-12
    assert all(abs(r["pi"] - got[r["alpha"]]) < 1e-12 for r in pid.shared_exclusions_two(df).collect())
    point = {(tuple(r["symbols"]), r["alpha"]): r["pi"] for r in pid.decompose(df, 2, pointwise=True).collect()}
    assert abs(point[(0, 1, 0), "{1}{2}"] + 0.16992500144231237) < 1e-12 and abs(point[(1, 1, 1), "{1}{2}"] - 0.4150374992788438) < 1e-12
    assert abs(atoms(spark, 2, lambda a, b: a ^ b)[1]["{1}{2}"] + 0.5849625007211562) < 1e-12
    parity = atoms(spark, 3, lambda a, b, c: a ^ b ^ c)[1]
    for alpha, want in (("{1}{2}{3}", 0.1926450779423959), ("{12}{13}{23}", -0.22686079328030903), ("{123}", 0.24511249783653177)):
        assert abs(parity[alpha] - want) < 1e-12
    assert len(pid.lattice(4)[0]) == 166


def test_least_p_values():
    got = [subgraphs.min_p("between", 7, 5, m) for m in range(7)]
    assert np.allclose(got, [2, 0.8333333, 0.3030303, 0.0909091, 0.020202, 0.0025253, 0.0151515], atol=1e-6)
    assert [subgraphs.min_p("within", 7, 7, m) for m in range(4)] == [2, 1, 0.5, 0.25]
    assert subgraphs.p_of("between", 5, 5, 2, 3) == 1.0 == subgraphs.p_of("between", 5, 5, 1, 3)


def test_mining(spark):
    # ten graphs against ten; links 0 and 1 are in eight graphs of a and in none of b
    rows = [(0, s, k) for s in range(8) for k in (0, 1)] + [(g, s, 2) for g in (0, 1) for s in range(10)]
    mining = subgraphs.SubgraphMining(spark.createDataFrame(rows, "group_id int, subject int, link_id int"), 10, 10)
    counts = {tuple(r["links"]): (r["in_a"], r["total"]) for r in mining.counted(1).collect()}
    assert counts[(0, 1)] == (8, 8) and counts[(2,)] == (10, 20) and counts[(0, 1, 2)] == (8, 8)
    for method in subgraphs.METHODS:
        found = {tuple(r["links"]) for r in mining.significant(method, 200).collect()}
        assert (0, 1) in found and (2,) not in found
    paired = subgraphs.SubgraphMining(spark.createDataFrame([(0, s, 0) for s in range(8)] + [(g, s, 1) for g in (0, 1) for s in range(8)], "group_id int, subject int, link_id int"), 8, 8, design="within")
    assert {tuple(r["links"]) for r in paired.significant("Tarone").collect()} == {(0,), (0, 1)}


def test_between_groups(spark):
    rows = [(g, s, 1, 0, (1.0 if g == 0 else 0.0) + s / 100) for g in (0, 1) for s in range(6)]
    got = comparison.between_groups(spark.createDataFrame(rows, "group_id int, subject int, target int, source int, cmi double"), 200).first()
    assert abs(got["diff"] - 1) < 1e-12 and got["significant"]


def test_links_within(coupled):
    own = [TargetResult(2, [0, 1], 1, [(2, 1)], [(0, 1), (1, 1)])]
    c = comparison.NetworkComparison(dict(estimator="gaussian", stats_type="independent", n_perm_comp=100, permute_in_time=True))
    row = c.compare_links_within((0, 2), (1, 2), own, coupled).first()
    assert row["significant"] and row["diff"] > 0.1
    with pytest.raises(RuntimeError):
        c.compare_links_within((0, 1), (1, 2), own, coupled)
    with pytest.raises(RuntimeError):
        comparison.NetworkComparison(dict(estimator="gaussian"))


def test_symbols_equal_a_scan(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.exponential(0.05, 300))
    t -= t[0]
    e = history.Embedding(0.06, 2, 0.1)
    got = {r["symbol"]: r["n"] for r in history.symbol_counts(spark.createDataFrame([(0, float(x)) for x in t], "proc int, t double"), e, 0.01).collect()}
    ends = e.delimiters(0.01)
    n = int((t[-1] - ends[-1]) / 0.01)
    raw = np.zeros((n, 3))
    for k in range(n):
        for x in t[(t >= k * 0.01) & (t < k * 0.01 + ends[-1])]:
            raw[k, next(i for i, end in enumerate(ends) if x <= k * 0.01 + end)] += 1
    code, count = np.unique((raw > np.median(raw, axis=0)) @ [4, 2, 1], return_counts=True)
    assert got == dict(zip(code.astype(int).tolist(), count.tolist(), strict=True))


def train_table(spark):
    rng = np.random.default_rng(4)
    regular = np.cumsum(0.1 + 0.01 * rng.random(200))
    free = np.sort(rng.random(150) * 20)
    rows = [(0, x) for x in regular - regular[0]] + [(1, x) for x in free - free[0]] + [(2, 0.0), (2, 0.3)]
    return rows, spark.createDataFrame([(p, float(t)) for p, t in rows], "proc int, t double")


def counted(rows, proc, e, step):
    """Symbol counts of one process, window by window."""
    t = np.array([x for p, x in rows if p == proc])
    edges = [0.0, *e.delimiters(step)]
    windows = int(np.floor((t.max() - edges[-1]) / step))
    counts = np.zeros((max(windows, 0), e.bins + 1), dtype=int)
    for k in range(windows):
        own = t[(t >= k * step) & (t < k * step + edges[-1])]
        for x in own:
            counts[k, min(sum(x > k * step + end for end in edges[1:]), e.bins)] += 1
    out = {}
    for row in counts > np.median(counts, axis=0) if windows > 0 else []:
        s = int("".join("1" if b else "0" for b in row), 2)
        out[s] = out.get(s, 0) + 1
    return out


GRID = [history.Embedding(0.05, 1), history.Embedding(0.1, 2), history.Embedding(0.2, 3, 0.2), history.Embedding(0.9, 2)]


def test_all_embeddings_in_one_pass_equal_brute_force(spark):
    rows, spikes = train_table(spark)
    got = {}
    for r in history.grid_counts(history.grid_symbols(spikes, GRID, 0.02)).collect():
        got.setdefault((r["e"], r["proc"]), {})[r["symbol"]] = r["n"]
    want = {(k, p): c for k, e in enumerate(GRID) for p in range(3) if (c := counted(rows, p, e, 0.02)) and set(c) != {0}}
    assert got == want and (3, 2) not in got  # the third train is shorter than the last embedding's window
    empty = spikes.limit(0)
    assert history.grid_symbols(empty, GRID, 0.02).count() == 0 and history.optimised(empty, GRID, n_boot=2, step=0.02).count() == 0


def test_spikes_between_the_same_ends_are_merged(spark):
    rng = np.random.default_rng(9)
    t = np.concatenate([rng.integers(0, 600, 4_000) * 0.005, rng.random(4_000) * 3])  # on ends of bins and between them
    rows = [(0, float(x)) for x in t - t.min()]
    spikes = spark.createDataFrame(rows, "proc int, t double")
    few = history.merged(spikes, [e.delimiters(0.02) for e in GRID], 0.02)
    assert few.count() < 4_000 and few.groupBy().sum("m").first()[0] == 8_000
    got = {}
    for r in history.grid_counts(history.grid_symbols(spikes, GRID, 0.02)).collect():
        got.setdefault(r["e"], {})[r["symbol"]] = r["n"]
    assert got == {k: counted(rows, 0, e, 0.02) for k, e in enumerate(GRID)}


@pytest.mark.parametrize("method", ["shuffling", "bbc"])
def test_optimised_embeddings_equal_brute_force(spark, method):
    rows, spikes = train_table(spark)
    found = {r.process: r for r in history.optimise(spikes, GRID, method, 0.02, tolerance=0.5, n_boot=6, least_range=0.0)}
    assert 0 in found
    for proc in range(3):
        best = {}
        for k, e in enumerate(GRID):
            c = counted(rows, proc, e, 0.02)
            if not set(c) - {0}:
                continue
            plain, nsb = history.plug_in_of(c)[1], history.nsb_of(c, e.bins)[1]
            r = nsb if method == "bbc" else history.shuffling_of(c, e.bins)[1]
            if method == "bbc" and history.bias_term(nsb, plain) >= 0.5:
                continue
            if e.past_range not in best or r > best[e.past_range][0]:
                best[e.past_range] = (r, k)
        assert (proc in found) == bool(best)
        if best:
            own = found[proc]
            assert own.max_r.keys() == best.keys() and all(abs(own.max_r[t] - r) < 1e-9 for t, (r, _) in best.items())
            r, k = best[own.best.past_range]
            assert own.best == GRID[k] and r >= max(best.values())[0] - 1e-12 and own.r_tot_interval[0] <= own.r_tot <= own.r_tot_interval[1]


def test_nsb_equals_integration_over_expected_entropy():
    """The same estimate with the prior flat in the expected entropy itself, by its own grid and digamma."""
    from math import lgamma

    def psi(x, h=1e-5):
        return (lgamma(x * (1 + h)) - lgamma(x * (1 - h))) / (2 * h * x)

    for counts, states in (([5, 3, 1], 8), ([20, 1, 1, 1], 16), ([7, 7], 2)):
        beta = np.exp(np.linspace(-14, 12, 4_001))
        expected = np.array([psi(states * b + 1) - psi(b + 1) for b in beta])
        log_evidence = np.array([lgamma(states * b) - lgamma(sum(counts) + states * b) + sum(lgamma(n + b) - lgamma(b) for n in counts) for b in beta])
        full = [*counts, *[0] * (states - len(counts))]
        mean = np.array([psi(sum(full) + states * b + 1) - sum((n + b) / (sum(full) + states * b) * psi(n + b + 1) for n in full) for b in beta])
        w = np.exp(log_evidence - log_evidence.max())
        width = np.diff(expected)
        top, bottom = (width * (w * mean)[1:]).sum() + (width * (w * mean)[:-1]).sum(), (width * w[1:]).sum() + (width * w[:-1]).sum()
        assert abs(history.nsb_entropy(np.array(counts), states) - top / bottom) < 2e-3


def test_history_estimators_agree_on_many_symbols():
    rng = np.random.default_rng(1)
    counts = {s: int(v) for s, v in enumerate(rng.multinomial(20_000, [0.8, 0.1, 0.07, 0.03]))}
    plain = history.plug_in_of(counts)[1]
    assert abs(history.nsb_of(counts, 1)[1] - plain) < 0.01 and abs(history.shuffling_of(counts, 1)[1] - plain) < 0.01
    assert history.bias_term(-1.0, 1.0) == np.inf


def test_time_scales():
    r = {0.01: 0.1, 0.1: 0.2, 1.0: 0.21, 2.0: 0.2}
    assert history.temporal_depth(r) == 1.0 and history.temporal_depth(r, 0.02) == 0.1
    assert abs(history.information_timescale({0.1: 0.1, 0.2: 0.3}, 0.3, 0.0) - (0.05 * 0.1 + 0.15 * 0.2) / 0.3) < 1e-12
    assert abs(history.averaged_r_tot(r, 0.1, 0.02) - np.mean([0.2, 0.21, 0.2])) < 1e-12


def test_stream_bins(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewire.streaming.raster import binned

    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "ab"[m % 2], 1.0) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = binned(stream).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, binned(df).collect()))


def test_local_values_average_to_the_links(coupled):
    from tidewire.plans.inference import local_link_values

    own = TargetResult(2, [0, 1], 1, [(2, 1)], [(0, 1), (1, 1)])
    for s in (dict(estimator="gaussian"), dict(estimator="kraskov", estimator_options=dict(k=4))):
        c = comparison.NetworkComparison({**s, "stats_type": "independent", "n_perm_comp": 100})
        want = c.calculate_link_te(coupled, [own])
        got = {(r["target"], r["source"]): r["m"] for r in local_link_values(s, coupled, own).groupBy("target", "source").agg({"local": "avg"}).withColumnRenamed("avg(local)", "m").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < (0.01 if s["estimator"] == "gaussian" else 1e-9) for k in want)


def test_decomposition_of_a_network(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, (2, 400))
    x = np.r_[0, (a ^ b)[:-1]]
    ts = TimeSeries.from_array(spark, np.stack([a, b, x]), "ps", normalise=False)
    got = pid.analyse_network(ts.df, [2, 0], [[0, 1], [1, 2]]).collect()
    assert 0.9 < got[0]["syn_s1_s2"] <= 1.1 and got[0]["target"] == 2 and got[1]["syn_s1_s2"] < 0.1
    tested = {r["atom"]: r["significant"] for r in pid.against_surrogates(ts.df, 2, [0, 1], 30).collect()}
    assert tested["syn_s1_s2"] and len(tested) == 4
    with pytest.raises(RuntimeError):
        pid.analyse_network(ts.df, [2], [[0]])
    with pytest.raises(RuntimeError):
        pid.sources_frame(ts.df, 2, [2, 1])


def test_duality_gap_is_small_at_the_best_table_only():
    rng = np.random.default_rng(4)
    for shape in ((2, 2, 2), (3, 2, 4), (2, 3, 3)):
        p = rng.dirichlet(np.ones(np.prod(shape))).reshape(shape)
        q = pid.closest_to_unique(p)
        assert pid.duality_gap(p, q) < 1e-4 and pid.two_source(p)["gap"] < 1e-4
        spread = p.sum(axis=2)[:, :, None] * p.sum(axis=1)[:, None, :] / p.sum(axis=(1, 2))[:, None, None]
        assert pid.duality_gap(p, spread) >= pid._conditional(spread) - pid._conditional(q) - 1e-9
    for gate in (lambda a, b: a & b, lambda a, b: a ^ b):
        p = np.zeros((2, 2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p[gate(a, b), a, b] = 0.25
        assert pid.two_source(p)["gap"] < 1e-6
