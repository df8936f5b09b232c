"""Cases whose right answer is known, for the tests: data with planted structure, and closed forms; and some queries.

Series are made from keyed digits, the same on every cluster, so what an analysis finds
doesn't depend on how the data are dealt out.  The SQL states what was planted.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import discrete
from tidewire.operators.embedding import lag_embed
from tidewire.plans import comparison, inference, pid, results, subgraphs
from tidewire.plans.estimators import Job, get_estimator
from tidewire.queries import _BINNED, _HOURLY, QUERIES, SQL, _cmi_sql, hourly, hourly_bins, known, query
from tidewire.sources import generators
from tidewire.sources.series import TimeSeries, array_frame

__all__ = ["QUERIES", "SQL", "planted", "remembering"]

#: Planted links: source, target, lag.
LINKS = [(0, 1, 1), (1, 2, 2)]
_TRUTH = "SELECT CAST(target AS INTEGER) AS target, CAST(source AS INTEGER) AS source, CAST(lag AS INTEGER) AS lag FROM (VALUES (1, 0, 1), (2, 1, 2)) t(target, source, lag)"


def _digits(n_proc: int, n_samples: int, n_repl: int, salt: int) -> np.ndarray:
    return np.random.default_rng([7, salt]).random((n_proc, n_samples, n_repl))


def planted(spark: SparkSession, n_samples: int, n_repl: int = 1, salt: int = 0, kind: str = "real", n_proc: int = 4, links: Sequence[tuple[int, int, int]] = LINKS) -> TimeSeries:
    """Independent processes, but for the targets of ``links``: noisy copies of their source (``real``) or of its sign (``binary``)."""
    u = _digits(2 * n_proc, n_samples, n_repl, salt)
    if kind == "binary":
        x = (u[:n_proc] < 0.5).astype(int)
    else:
        x = np.sqrt(-2 * np.log(1 - u[:n_proc])) * np.cos(2 * np.pi * u[n_proc:])
    for source, target, lag in links:
        past = np.roll(x[source], lag, axis=0)
        x[target] = np.where(u[n_proc + target] < 0.85, past, x[target]) if kind == "binary" else 0.9 * past + 0.45 * x[target]
    return TimeSeries.from_frame(array_frame(spark, x, "psr"), normalise=kind != "binary")


_TESTS = dict(n_perm_max_stat=100, n_perm_min_stat=100, n_perm_omnibus=100, n_perm_max_seq=100, alpha_max_stat=0.02, alpha_min_stat=0.02, alpha_omnibus=0.02, alpha_max_seq=0.02, max_lag_sources=2, max_lag_target=1)


def _links(spark: SparkSession, found: Sequence[inference.TargetResult]) -> DataFrame:
    return results.variables_frame(spark, found).select("target", "source", "lag")


def _found(spark: SparkSession, measure: str, multivariate: bool, estimator: str, series: TimeSeries, **more) -> list[inference.TargetResult]:
    return inference.NetworkInference(measure, multivariate).analyse_network({**_TESTS, "estimator": estimator, **more}, series)


@known("planted_te_discrete", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "te", True, "discrete", planted(spark, 40, 10, kind="binary", n_proc=3)))


@known("planted_te_discrete_in_time", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "te", True, "discrete", planted(spark, 300, kind="binary", n_proc=3)))


@known("planted_te_gaussian", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "te", True, "gaussian", planted(spark, 40, 10)))


@known("planted_te_kraskov", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "te", True, "kraskov", planted(spark, 150, n_proc=3)))


@known("planted_te_bivariate", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "te", False, "gaussian", planted(spark, 40, 10, n_proc=3)))


@known("planted_mi_multivariate", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "mi", True, "gaussian", planted(spark, 40, 10, n_proc=3)))


@known("planted_mi_bivariate", _TRUTH)
def _(spark, sf_dir):
    return _links(spark, _found(spark, "mi", False, "discrete", planted(spark, 40, 10, kind="binary", n_proc=3)))


@known("planted_te_conditionals", f"SELECT * FROM ({_TRUTH}) WHERE target = 2")
def _(spark, sf_dir):
    """A variable that is in from the start, but tells nothing more, is pruned."""
    series = planted(spark, 40, 10, n_proc=3)
    s = {**_TESTS, "estimator": "gaussian", "add_conditionals": [(0, 1)]}
    return _links(spark, [inference.NetworkInference("te").analyse_single_target(s, series, 2)])


@known("planted_omnibus", "SELECT CAST(target AS INTEGER) AS target, omnibus_sign FROM (VALUES (0, false), (1, true), (2, true)) t(target, omnibus_sign)")
def _(spark, sf_dir):
    return results.targets_frame(spark, _found(spark, "te", True, "gaussian", planted(spark, 40, 10, n_proc=3))).select("target", "omnibus_sign")


@known("planted_network_fdr", _TRUTH)
def _(spark, sf_dir):
    more = {"n_perm_omnibus": 300, "permute_in_time": True}
    found = _found(spark, "te", True, "gaussian", planted(spark, 400, n_proc=3), **more)
    return _links(spark, inference.network_fdr({**_TESTS, "estimator": "gaussian", **more}, found))


@known("planted_combined_results", _TRUTH)
def _(spark, sf_dir):
    """Targets analysed apart are put together again."""
    series, s = planted(spark, 40, 10, n_proc=3), {**_TESTS, "estimator": "gaussian"}
    parts = [inference.NetworkInference("te").analyse_network(s, series, own) for own in ([2], [0, 1])]
    return _links(spark, results.combine(*parts))


def remembering(spark: SparkSession, n_samples: int, n_repl: int) -> TimeSeries:
    """Process 0 repeats its last symbol in most steps; process 1 has no memory."""
    u = _digits(4, n_samples, n_repl, 3)
    x = (u[:2] < 0.5).astype(int)
    for t in range(1, n_samples):
        x[0, t] = np.where(u[2, t] < 0.8, x[0, t - 1], x[0, t])
    return TimeSeries.from_frame(array_frame(spark, x, "psr"), normalise=False)


_STORAGE = dict(estimator="discrete", max_lag=2, n_perm_max_stat=100, n_perm_min_stat=100, n_perm_mi=200, alpha_max_stat=0.02, alpha_min_stat=0.02, alpha_mi=0.02)
_STORED = "SELECT CAST(0 AS INTEGER) AS process, CAST(0 AS INTEGER) AS proc, CAST(1 AS INTEGER) AS lag"


def _stored(spark: SparkSession, found: Sequence[inference.StorageResult]) -> DataFrame:
    return results.storage_frame(spark, found).select("process", F.explode("selected_vars").alias("v")).select("process", F.col("v.proc").alias("proc"), F.col("v.lag").alias("lag"))


@known("planted_storage", _STORED)
def _(spark, sf_dir):
    return _stored(spark, inference.InformationStorage().analyse_network(_STORAGE, remembering(spark, 30, 12)))


@known("planted_storage_fdr", _STORED)
def _(spark, sf_dir):
    found = inference.InformationStorage().analyse_network(_STORAGE, remembering(spark, 30, 12))
    return _stored(spark, inference.storage_fdr(_STORAGE, found))


@known("planted_storage_conditionals", _STORED)
def _(spark, sf_dir):
    """A past value that is in from the start, but tells nothing more, is pruned."""
    return _stored(spark, [inference.InformationStorage().analyse_single_process({**_STORAGE, "add_conditionals": [(0, 2)]}, remembering(spark, 30, 12), 0)])


@query(
    "local_storage",
    f"""WITH {_BINNED}, h AS (SELECT y.sample, y.value AS y, a.value AS a FROM bins y JOIN bins a ON a.proc = y.proc AND a.sample = y.sample - 1 WHERE y.proc = 1)
    SELECT sample, round(log2(CAST(count(*) OVER (PARTITION BY y, a) AS DOUBLE) * count(*) OVER () / (CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) * count(*) OVER (PARTITION BY a))), 8) + 0.0 AS local FROM h""",
)
def _(spark, sf_dir):
    result = inference.StorageResult(1, [(1, 1)])
    return inference.local_storage({"estimator": "discrete", "max_lag": 1}, TimeSeries(hourly_bins(spark, sf_dir)), result).select("sample", "local")


# ---- estimators -------------------------------------------------------------------------------


@known("closed_form_null", "SELECT u, round(-ln(1 - u) / (100 * ln(2)), 8) + 0.0 AS quantile FROM (SELECT CAST(k / 20.0 AS DOUBLE) AS u FROM unnest(range(1, 20)) t(k))")
def _(spark, sf_dir):
    """Two symbols and one condition of two: chi-square of two degrees of freedom."""
    u = np.arange(1, 20) / 20
    got = get_estimator("discrete").null_quantiles(u, Job(("x",), ("y",), ("z",)), 100, 2)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(u, got, strict=True)], "u double, quantile double")


_Q = f"{_BINNED}, q AS (SELECT a.value AS s1, b.value AS s2, t.value AS t FROM bins t JOIN bins a ON a.proc = 0 AND a.sample = t.sample - 1 JOIN bins b ON b.proc = 1 AND b.sample = t.sample - 1 WHERE t.proc = 2)"


@query("pmf_information", f"WITH {_Q}, r AS ({_cmi_sql('', 's1', 't', 's2', 'q', 'cmi')}), m AS ({_cmi_sql('', 's1', 't', '', 'q', 'mi')}) SELECT round(cmi, 8) + 0.0 AS cmi, round(mi, 8) + 0.0 AS mi FROM r, m")
def _(spark, sf_dir):
    """The probabilities of a table of symbols, and from them informations on one axis given another."""
    table = discrete.pmf(pid.sources_frame(hourly_bins(spark, sf_dir), 2, [0, 1]), ["s1", "s2", "t"]).toPandas()
    p = np.zeros((3, 3, 3))
    p[table["t"], table["s1"], table["s2"]] = table["p"]
    return spark.createDataFrame([(pid._conditional(p), pid._information(p.sum(axis=2)))], "cmi double, mi double")


@known(
    "series_reordered",
    "SELECT CAST(p AS INTEGER) AS proc, CAST(r AS INTEGER) AS repl, CAST(s AS INTEGER) AS sample, CAST(100 * p + 10 * r + s AS DOUBLE) AS value FROM unnest(range(0, 3)) a(p), unnest(range(0, 4)) b(r), unnest(range(0, 5)) c(s)",
)
def _(spark, sf_dir):
    """Any order of the dimensions gives the same rows; a single one gives process 0."""
    p, s, r = np.indices((3, 5, 4))
    values = (100.0 * p + 10 * r + s).transpose(2, 0, 1)
    return array_frame(spark, values, "rps")


@query("realisations_without", f"WITH {_HOURLY} SELECT b.repl, b.sample, round(t.value, 8) + 0.0 AS v3_1 FROM (SELECT DISTINCT repl, sample FROM series WHERE sample >= 2) b JOIN series t ON t.proc = 3 AND t.sample = b.sample - 1")
def _(spark, sf_dir):
    """The embedding of a target and two variables, without the target and one of them."""
    return lag_embed(hourly(spark, sf_dir), [(0, 0), (3, 1), (1, 2)], 2).drop("v0_0", "v1_2")


@known(
    "generated_coupling",
    "SELECT CAST(kind AS INTEGER) AS kind, CAST(repl AS INTEGER) AS repl, CAST(n AS BIGINT) AS n, true AS coupled FROM (VALUES (0, 0, 398), (0, 1, 398), (1, 0, 399), (1, 1, 399), (2, 0, 399), (2, 1, 399)) t(kind, repl, n)",
)
def _(spark, sf_dir):
    """Of each generator, that the driven process depends on the driver's past."""
    a = np.array([[[0.5, 0.0], [0.4, 0.5]]])
    out = None
    for kind, (series, driver, driven, lag, power) in enumerate([(generators.coupled_network(spark, 400, 2), 0, 1, 2, 2), (generators.autoregressive(spark, a, 400, 2), 0, 1, 1, 1), (generators.logistic_maps(spark, np.array([[[1.0, 0.0], [0.9, 0.1]]]), 400, 2), 0, 1, 1, 1)]):
        wide = lag_embed(series, [(driver, lag), (driven, 0)], lag)
        x, y = F.col(f"v{driver}_{lag}"), F.col(f"v{driven}_0")
        x = F.pow(x, F.lit(power)) if kind != 2 else 4 * x * (1 - x)
        own = wide.groupBy("repl").agg(F.count("*").alias("n"), (F.abs(F.corr(x, y)) > 0.2).alias("coupled")).select(F.lit(kind).alias("kind"), "repl", "n", "coupled")
        out = own if out is None else out.unionByName(own)
    return out


# ---- decomposition ----------------------------------------------------------------------------

_ATOMS = ("unq_s1", "unq_s2", "shd_s1_s2", "syn_s1_s2")


@known("pid_gates", f"SELECT gate, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ATOMS)} FROM (VALUES ('and', 0, 0, 0.31128, 0.5), ('copy', 1, 0, 0, 0), ('same', 0, 0, 1, 0), ('xor', 0, 0, 0, 1)) t(gate, {', '.join(_ATOMS)})")
def _(spark, sf_dir):
    rows = [(name, a, b, t) for a, b in itertools.product((0, 1), repeat=2) for name, t in (("and", a & b), ("xor", a ^ b), ("copy", a))]
    rows += [("same", a, a, a) for a in (0, 1)]
    found = pid.decompose_two(spark.createDataFrame(rows, "gate string, s1 int, s2 int, t int"), ["gate"])
    return found.select("gate", *((F.round(c, 5) + 0.0).alias(c) for c in _ATOMS))


@known("planted_synergy", "SELECT atom, significant FROM (VALUES ('shd_s1_s2', false), ('syn_s1_s2', true), ('unq_s1', false), ('unq_s2', false)) t(atom, significant)")
def _(spark, sf_dir):
    """The exclusive or of two independent sources."""
    u = (_digits(3, 200, 1, 5) < 0.5).astype(int)
    u[2, 1:] = u[0, :-1] ^ u[1, :-1]
    found = pid.against_surrogates(array_frame(spark, u, "psr"), 2, [0, 1], 60, seed=3)
    return found.select("atom", "significant")


# ---- comparison and graphs --------------------------------------------------------------------

_CHANGED = "FROM (VALUES (1, 0, true, true)) t(target, source, a_larger, significant)"


def _compared(spark: SparkSession) -> DataFrame:
    coupled, free = planted(spark, 60, 8, n_proc=2, links=[(0, 1, 1)]), planted(spark, 60, 8, salt=4, n_proc=2, links=[])
    own = [inference.TargetResult(1, [0], 1, [(1, 1)], [(0, 1)])]
    settings = {**_TESTS, "estimator": "gaussian", "stats_type": "independent", "n_perm_comp": 100}
    return comparison.NetworkComparison(settings).compare_within(own, own, coupled, free)


@known("planted_compare_within", f"SELECT CAST(target AS INTEGER) AS target, CAST(source AS INTEGER) AS source, a_larger, significant {_CHANGED}")
def _(spark, sf_dir):
    return _compared(spark).select("target", "source", "a_larger", "significant")


@known("planted_compare_links", f"SELECT CAST(target AS INTEGER) AS target, CAST(source AS INTEGER) AS source, a_larger, significant {_CHANGED}")
def _(spark, sf_dir):
    """A planted link against one that isn't."""
    series = planted(spark, 60, 8, n_proc=3, links=[(0, 1, 1)])
    own = [inference.TargetResult(1, [0], 1, [(1, 1)], [(0, 1)]), inference.TargetResult(2, [0], 1, [(2, 1)], [(0, 1)])]
    settings = {**_TESTS, "estimator": "gaussian", "stats_type": "independent", "n_perm_comp": 100}
    return comparison.NetworkComparison(settings).compare_links_within((0, 1), (0, 2), own, series).select("target", "source", "a_larger", "significant")


@known("planted_comparison_adjacency", "SELECT CAST(0 AS INTEGER) AS source, CAST(1 AS INTEGER) AS target, kind, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('comparison', 1), ('union', 1)) t(kind, weight)")
def _(spark, sf_dir):
    found = _compared(spark)
    return comparison.adjacency(found, "comparison").withColumn("kind", F.lit("comparison")).unionByName(comparison.adjacency(found, "union").withColumn("kind", F.lit("union"))).select("source", "target", "kind", "weight")


def _mined(spark: SparkSession, design: str) -> subgraphs.SubgraphMining:
    """Twelve graphs a group: all of the first have link 0 and none of the second; links 1 to 6 are in two of each."""
    rows = [(0, k, 0) for k in range(12)] + [(g, (2 * link + k) % 12, link) for g in (0, 1) for link in range(1, 7) for k in range(2)]
    return subgraphs.SubgraphMining(spark.createDataFrame(rows, "group_id int, subject int, link_id int"), 12, 12, design=design)


for _design, _p in (("between", "2.0 / 2704156"), ("within", "2.0 / 4096")):
    for _method in subgraphs.METHODS:
        _name = f"planted_subgraphs_{_design}_{_method.lower().replace('-', '_')}"
        _column = "" if _method == "Hommel" else f", round({_p}, 8) + 0.0 AS p_value"
        known(_name, f"SELECT '0' AS links{_column}")(
            lambda spark, sf_dir, d=_design, m=_method: _mined(spark, d).significant(m, 200, 3).select(F.array_join("links", ",").alias("links"), *([] if m == "Hommel" else ["p_value"]))
        )


@known(
    "coded_links",
    "SELECT subject, CAST(target AS INTEGER) AS target, CAST(source AS INTEGER) AS source, CAST(lag AS INTEGER) AS lag, CAST(dense_rank() OVER (ORDER BY target, source, lag) - 1 AS INTEGER) AS link_id FROM (VALUES (0, 1, 0, 1), (0, 2, 1, 2), (1, 1, 0, 1), (1, 1, 0, 2)) t(subject, target, source, lag)",
)
def _(spark, sf_dir):
    kinds = "target int, source int, lag int"
    networks = [spark.createDataFrame([(1, 0, 1), (2, 1, 2)], kinds), spark.createDataFrame([(1, 0, 1), (1, 0, 2)], kinds)]
    return subgraphs.coded(subgraphs.links_of_results(networks, 0)).select("subject", "target", "source", "lag", "link_id")


@known("edges_replaced", "SELECT CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, CAST(weight AS INTEGER) AS weight FROM (VALUES (0, 1, 5), (1, 2, 2), (2, 0, 7)) t(source, target, weight)")
def _(spark, sf_dir):
    kinds = "source int, target int, weight int"
    return results.edge_list(results.add_edge_list(spark.createDataFrame([(0, 1, 1), (1, 2, 2)], kinds), spark.createDataFrame([(0, 1, 5), (2, 0, 7)], kinds)))
