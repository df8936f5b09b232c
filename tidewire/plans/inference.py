"""Network inference and information storage: greedy selection with permutation tests.

The driver holds the selected variables and decides; each round is one job that
evaluates all candidates, observed and permuted, over one embedded frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.embedding import Var, column, lag_embed
from tidewire.operators.permutation import Surrogates, permuted
from tidewire.operators.significance import Closed, Drawn, fdr_of
from tidewire.plans.estimators import Estimator, Job, Stats, get_estimator
from tidewire.plans.settings import Settings
from tidewire.sources.series import TimeSeries

#: Targets whose rounds run side by side.
TARGETS_AT_ONCE = 4


@dataclass
class TargetResult:
    """What was found for one target."""

    target: int
    sources_tested: list[int]
    current_lag: int
    selected_vars_target: list[Var] = field(default_factory=list)
    selected_vars_sources: list[Var] = field(default_factory=list)
    selected_sources_stat: list[float] = field(default_factory=list)
    selected_sources_pval: list[float] = field(default_factory=list)
    omnibus_stat: float | None = None
    omnibus_pval: float = 1.0
    omnibus_sign: bool = False
    link_stat: dict[int, float] = field(default_factory=dict)


@dataclass
class StorageResult:
    """What was found for one process."""

    process: int
    selected_vars: list[Var] = field(default_factory=list)
    ais: float = float("nan")
    ais_pval: float = 1.0
    ais_sign: bool = False


class Evaluator:
    """Evaluates jobs over the embedded frame of one target."""

    def __init__(self, series: TimeSeries, target: int, variables: Sequence[Var], max_lag: int, settings: Settings, estimator: Estimator) -> None:
        self.settings, self.estimator, self.max_lag = settings, estimator, max_lag
        self.n_samples, self.n_replications = series.n_samples, series.n_replications
        if self.n_samples <= max_lag:
            raise RuntimeError("the series is not longer than the largest lag")
        self.current = column((target, 0))
        self.frame = lag_embed(estimator.prepare(series.df), [*variables, (target, 0)], max_lag).cache()
        self.rounds = 0
        self._summary: object | None = None
        self._levels: int | None = None

    def close(self) -> None:
        self.frame.unpersist()

    @property
    def n(self) -> int:
        return (self.n_samples - self.max_lag) * self.n_replications

    def _in_time(self, n_perm: int) -> bool:
        """Replications are permuted only if there are more orders of them than permutations."""
        return self.settings.permute_in_time or math.lgamma(self.n_replications + 1) <= math.log(n_perm)

    def _surrogates(self, n_perm: int) -> Surrogates:
        seed = self.settings.seed * 1_000 + self.rounds
        if not self._in_time(n_perm):
            return Surrogates(self.n_replications, n_perm, seed, axis="repl")
        how = self.settings.permutation() if self.settings.permute_in_time else replace(self.settings.permutation(), type="random")
        return Surrogates(self.n_samples - self.max_lag, n_perm, seed, how, offset=self.max_lag)

    def run(self, jobs: Sequence[tuple[Sequence[Var], Sequence[Var]]], n_perm: int = 0, of: str = "x") -> tuple[np.ndarray, np.ndarray]:
        """Statistics of the jobs (x variables, z variables), and of their surrogates (job x permutation).

        ``of``: whether surrogates permute the x variables or the current value.
        """
        self.rounds += 1
        plain = [Job(tuple(column(v) for v in x), (self.current,), tuple(column(v) for v in z)) for x, z in jobs]
        closed = n_perm and self.estimator.analytic and self.settings.permute_in_time
        if not n_perm or closed:
            got = self._observed(plain)
            stats = np.array([got[k, -1] for k in range(len(plain))])
            if not closed:
                return stats, np.zeros((len(plain), 0))
            rng = np.random.default_rng([self.settings.seed, self.rounds])
            return stats, np.array([self.estimator.null_quantiles(rng.random(n_perm), j, self.n, self.levels) for j in plain])
        under = sorted({c for j in plain for c in (j.x if of == "x" else j.y)})
        copy = {c: f"q_{c}" for c in under}
        moved = [Job(tuple(copy.get(c, c) for c in j.x), j.y, j.z) if of == "x" else Job(j.x, tuple(copy[c] for c in j.y), j.z) for j in plain]
        with_copies = self.frame.withColumns({q: F.col(c) for c, q in copy.items()})
        both = with_copies.withColumn("perm", F.lit(-1)).unionByName(permuted(with_copies, list(copy.values()), self._surrogates(n_perm)))
        got = self.estimator.evaluate(both, moved)
        return np.array([got[k, -1] for k in range(len(plain))]), np.array([[got[k, p] for p in range(n_perm)] for k in range(len(plain))])

    def test(self, jobs: Sequence[tuple[Sequence[Var], Sequence[Var]]], n_perm: int, of: str = "x") -> tuple[np.ndarray, Drawn | Closed]:
        """Statistics of the jobs and their null distribution: tail probabilities where the estimator has them and samples may be permuted, else surrogates."""
        if not (self.estimator.analytic and self.settings.permute_in_time):
            stats, table = self.run(jobs, n_perm, of)
            return stats, Drawn(table)
        stats = self.run(jobs)[0]
        plain = [Job(tuple(column(v) for v in x), (self.current,), tuple(column(v) for v in z)) for x, z in jobs]
        return stats, Closed(tuple(lambda stat, j=j: self.estimator.tail(stat, j, self.n, self.levels) for j in plain), n_perm)

    def _observed(self, jobs: Sequence[Job]) -> Stats:
        """Unpermuted statistics: from one summary of the frame for all rounds, where the estimator has one."""
        if self._summary is None:
            self._summary = self.estimator.summary(self.frame)
        if self._summary is not None:
            return self.estimator.from_summary(self._summary, jobs)
        return self.estimator.evaluate(self.frame.withColumn("perm", F.lit(-1)), jobs)

    @property
    def levels(self) -> int:
        """Symbols of the most varied column."""
        if self._levels is None:
            columns = [c for c in self.frame.columns if c not in ("repl", "sample")]
            self._levels = max(self.frame.agg(*(F.count_distinct(c) for c in columns)).first()) if self.estimator.name == "discrete" else 0
        return self._levels


def include(ev: Evaluator, candidates: Sequence[Var], selected: list[Var], fixed: Sequence[Var], s: Settings) -> None:
    """Add the candidate with the largest information until the largest isn't significant."""
    left = [c for c in candidates if c not in selected and c not in fixed]
    while left:
        given = [*fixed, *selected]
        stats, null = ev.test([([c], given) for c in left], s.n_perm_max_stat)
        best = int(np.argmax(stats))
        if not null.largest(stats[best], s.alpha_max_stat)[0]:
            return
        selected.append(left.pop(best))


def prune(ev: Evaluator, selected: list[Var], fixed: Sequence[Var], s: Settings) -> None:
    """Drop the variable with the least information, given all others, while it isn't significant."""
    while len(selected) > 1:
        stats, null = ev.test([([v], [*fixed, *(w for w in selected if w != v)]) for v in selected], s.n_perm_min_stat)
        worst = int(np.argmin(stats))
        if null.smallest(stats[worst], s.alpha_min_stat)[0]:
            return
        del selected[worst]


def max_sequential(stats: np.ndarray, null: np.ndarray | Drawn | Closed, alpha: float, keep_failing_p: bool = True) -> tuple[list[bool], list[float]]:
    """Ranks against ranks; stops at the first failure, whose p is kept or (in the bivariate form) stays 1."""
    order = np.argsort(-stats, kind="stable")
    null = Drawn(null) if isinstance(null, np.ndarray) else null
    sign, p = [False] * len(stats), [1.0] * len(stats)
    for rank, k in enumerate(order.tolist()):
        ok, value = null.ranked(rank, stats[k], alpha)
        if ok or keep_failing_p:
            p[k] = value
        if not ok:
            break
        sign[k] = True
    return sign, p


def _each(settings: dict | Settings, series: TimeSeries, jobs: Sequence, run: Callable) -> list:
    """Targets don't depend on each other: their rounds are submitted side by side, so that small jobs fill the cluster.

    A run that notes its progress goes target by target, since one table takes the notes.
    """
    held = TimeSeries(series.df.cache())
    try:
        with ThreadPoolExecutor(1 if Settings.of(settings).checkpoint_path else TARGETS_AT_ONCE) as pool:
            return list(pool.map(lambda job: run(held, job), jobs))
    finally:
        held.df.unpersist()


def forced_variables(s: Settings, target: int, sources: Sequence[int]) -> list[Var]:
    """Conditionals that are in from the start; ``faes`` means all sources at lag 0."""
    given = s.add_conditionals
    if isinstance(given, dict):
        given = given.get(target, ())
    if given is None:
        return []
    if given == "faes":
        return [(p, 0) for p in sources]
    return [given] if isinstance(given, tuple) and given and isinstance(given[0], int) else [tuple(v) for v in given]


class NetworkInference:
    """Transfer entropy (``te``) or mutual information (``mi``), multivariate or bivariate."""

    def __init__(self, measure: str = "te", multivariate: bool = True) -> None:
        if measure not in ("te", "mi"):
            raise ValueError("the measure is te or mi")
        self.te, self.multivariate = measure == "te", multivariate

    def _sources(self, series: TimeSeries, target: int, sources: str | int | Sequence[int]) -> list[int]:
        n = series.n_processes
        if not isinstance(target, int) or not 0 <= target < n:
            raise RuntimeError(f"target {target!r} is not a process")
        found = [p for p in range(n) if p != target] if isinstance(sources, str) and sources == "all" else [sources] if isinstance(sources, int) else list(sources)
        if target in found:
            raise RuntimeError("the target is among the sources")
        if any(not isinstance(p, int) or not 0 <= p < n for p in found):
            raise RuntimeError(f"sources {found} are not all processes")
        return found

    def analyse_single_target(self, settings: dict | Settings, series: TimeSeries, target: int, sources: str | int | Sequence[int] = "all") -> TargetResult:
        s = replace(Settings.of(settings))
        s.check_network(self.te)
        own = self._sources(series, target, sources)
        forced = forced_variables(s, target, own)
        past = [(target, lag) for lag in range(1, s.max_lag_target + 1, s.tau_target)] if self.te else []
        grid = {p: [(p, lag) for lag in range(s.min_lag_sources, s.max_lag_sources + 1, s.tau_sources)] for p in own}
        every = [*past, *(v for vs in grid.values() for v in vs), *forced, *([(target, 1)] if self.te else [])]
        max_lag = max([s.max_lag_sources, s.max_lag_target or 0, *(lag for _, lag in forced)])
        ev = Evaluator(series, target, every, max_lag, s, get_estimator(s.estimator, s.estimator_options))
        out = TargetResult(target, own, max_lag)
        try:
            fixed = [v for v in forced if v[0] == target]
            chosen = [v for v in forced if v[0] != target]
            if self.te:
                include(ev, past, fixed, chosen, s)
                if not [v for v in fixed if v[0] == target]:
                    fixed.append((target, 1))
                self._note(s, series, target, fixed, chosen)
            if self.multivariate:
                include(ev, [v for vs in grid.values() for v in vs], chosen, fixed, s)
                self._note(s, series, target, fixed, chosen)
                prune(ev, chosen, fixed, s)
            else:
                kept = []
                for p in own:
                    mine = [v for v in chosen if v[0] == p]
                    include(ev, grid[p], mine, fixed, s)
                    prune(ev, mine, fixed, s)
                    kept += mine
                    self._note(s, series, target, fixed, kept)
                chosen = kept
            self._final(ev, out, fixed, chosen, s)
            out.selected_vars_target = sorted(fixed)
        finally:
            ev.close()
        return out

    def _final(self, ev: Evaluator, out: TargetResult, fixed: list[Var], chosen: list[Var], s: Settings) -> None:
        """Omnibus test of all sources together, then each variable by ranks, then the information of each link."""
        if not chosen:
            return
        stats, null = ev.test([(chosen, fixed)], s.n_perm_omnibus)
        out.omnibus_stat = float(stats[0])
        out.omnibus_sign, out.omnibus_pval = null.largest(stats[0], s.alpha_omnibus)
        if not out.omnibus_sign:
            return
        if self.multivariate:
            stats, null = ev.test([([v], [*fixed, *(w for w in chosen if w != v)]) for v in chosen], s.n_perm_max_seq)
            sign, p = max_sequential(stats, null, s.alpha_max_seq)
        else:
            stats, null = ev.test([([v], [*fixed, *(w for w in chosen if w != v and w[0] == v[0])]) for v in chosen], s.n_perm_max_seq)
            sign, p = [False] * len(chosen), [1.0] * len(chosen)
            for source in {v[0] for v in chosen}:
                at = [k for k, v in enumerate(chosen) if v[0] == source]
                for k, a, b in zip(at, *max_sequential(stats[at], null.of(at), s.alpha_max_seq, keep_failing_p=False), strict=True):
                    sign[k], p[k] = a, b
        kept = [k for k in range(len(chosen)) if sign[k]]
        out.selected_vars_sources = [chosen[k] for k in kept]
        out.selected_sources_stat = [float(stats[k]) for k in kept]
        out.selected_sources_pval = [p[k] for k in kept]
        links = sorted({v[0] for v in out.selected_vars_sources})
        if links:
            out.link_stat = dict(zip(links, link_values(ev, out.selected_vars_sources, fixed, links, "full" if self.multivariate else "target").tolist(), strict=True))

    def _note(self, s: Settings, series: TimeSeries, target: int, fixed: Sequence[Var], chosen: Sequence[Var]) -> None:
        if s.checkpoint_path:
            write_progress(series.df.sparkSession, s.checkpoint_path, target, [*fixed, *chosen])

    def analyse_network(self, settings: dict | Settings, series: TimeSeries, targets: str | Sequence[int] = "all", sources: str | Sequence = "all") -> list[TargetResult]:
        """Every target; ``network_fdr`` corrects over the results."""
        own = list(range(series.n_processes)) if isinstance(targets, str) else list(targets)
        nested = not isinstance(sources, str) and len(sources) and not isinstance(sources[0], int)
        if nested and len(sources) != len(own):
            raise RuntimeError("there is one list of sources for each target")
        jobs = [(target, sources[k] if nested else sources if isinstance(sources, str) else [p for p in sources if p != target]) for k, target in enumerate(own)]
        return _each(settings, series, jobs, lambda data, job: self.analyse_single_target(settings, data, *job))


def link_values(ev: Evaluator, variables: Sequence[Var], target_past: Sequence[Var], sources: Sequence[int], conditioning: str) -> np.ndarray:
    """Joint information of each source's variables; given all else (full), the target's past, or nothing (none)."""
    jobs = []
    for p in sources:
        rest = [v for v in variables if v[0] != p] if conditioning == "full" else []
        jobs.append(([v for v in variables if v[0] == p], [*(target_past if conditioning != "none" else ()), *rest]))
    return ev.run(jobs)[0]


def local_link_values(settings: dict | Settings, series: TimeSeries, result: TargetResult) -> DataFrame:
    """target, source, repl, sample, local: the pointwise values of each link of a result."""
    s = Settings.of(settings)
    variables, past = result.selected_vars_sources, result.selected_vars_target
    if not variables:
        raise RuntimeError("the target has no links")
    ev = Evaluator(series, result.target, [*variables, *past], result.current_lag, s, get_estimator(s.estimator, s.estimator_options))
    out = None
    for p in sorted({v[0] for v in variables}):
        x = tuple(column(v) for v in variables if v[0] == p)
        z = tuple(column(v) for v in [*past, *(v for v in variables if v[0] != p)])
        own = ev.estimator.local(ev.frame, Job(x, (ev.current,), z)).select(F.lit(result.target).alias("target"), F.lit(p).alias("source"), "repl", "sample", "local")
        out = own if out is None else out.unionByName(own)
    return out


def local_storage(settings: dict | Settings, series: TimeSeries, result: StorageResult) -> DataFrame:
    """process, repl, sample, local: the pointwise storage of a result's selected values."""
    s = Settings.of(settings)
    if not result.selected_vars:
        raise RuntimeError("the process has no selected values")
    max_lag = max([s.max_lag or 0, *(lag for _, lag in result.selected_vars)])
    ev = Evaluator(series, result.process, result.selected_vars, max_lag, s, get_estimator(s.estimator, s.estimator_options))
    own = ev.estimator.local(ev.frame, Job(tuple(column(v) for v in result.selected_vars), (ev.current,), ()))
    return own.select(F.lit(result.process).alias("process"), "repl", "sample", "local")


class InformationStorage:
    """Active information storage: which of a process's own past values tell of its next."""

    def analyse_single_process(self, settings: dict | Settings, series: TimeSeries, process: int) -> StorageResult:
        s = replace(Settings.of(settings))
        s.check_storage()
        if not isinstance(process, int) or not 0 <= process < series.n_processes:
            raise RuntimeError(f"{process!r} is not a process")
        past = [(process, lag) for lag in range(1, s.max_lag + 1, s.tau)]
        forced = forced_variables(s, process, [p for p in range(series.n_processes) if p != process])
        max_lag = max([s.max_lag, *(lag for _, lag in forced)])
        ev = Evaluator(series, process, list(dict.fromkeys([*past, *forced])), max_lag, s, get_estimator(s.estimator, s.estimator_options))
        out = StorageResult(process)
        try:
            chosen: list[Var] = list(forced)
            include(ev, past, chosen, (), s)
            if s.checkpoint_path:
                write_progress(series.df.sparkSession, s.checkpoint_path, process, chosen)
            prune(ev, chosen, (), s)
            if chosen:
                stats, null = ev.test([(chosen, ())], s.n_perm_mi, of="y")
                out.ais = float(stats[0])
                out.ais_sign, out.ais_pval = null.largest(stats[0], s.alpha_mi)
                out.selected_vars = chosen if out.ais_sign else []
        finally:
            ev.close()
        return out

    def analyse_network(self, settings: dict | Settings, series: TimeSeries, processes: str | Sequence[int] = "all") -> list[StorageResult]:
        own = list(range(series.n_processes)) if isinstance(processes, str) else list(processes)
        return _each(settings, series, own, lambda data, p: self.analyse_single_process(settings, data, p))


def network_fdr(settings: dict | Settings, results: Sequence[TargetResult]) -> list[TargetResult] | None:
    """Corrected copies of the results; None where the permutations can't reach the threshold."""
    s = Settings.of(settings)
    if s.correct_by_target:
        p, n_perm = [r.omnibus_pval if r.omnibus_stat is not None else 1.0 for r in results], s.n_perm_omnibus
        n_tests = len(p)
    else:
        p, n_perm = [x for r in results for x in r.selected_sources_pval], s.n_perm_max_seq
        n_tests = sum(len(r.sources_tested) * ((s.max_lag_sources or 0) - s.min_lag_sources + 1) for r in results)
    if not p or 1 / n_perm > s.alpha_fdr / max(n_tests, 1) / (1 if s.fdr_constant == 1 else math.fsum(1 / i for i in range(1, n_tests + 1))):
        return None
    kept = iter(fdr_of(p, s.alpha_fdr, s.fdr_constant))
    out = []
    for r in results:
        if s.correct_by_target:
            out.append(replace(r) if next(kept) else replace(r, selected_vars_sources=[], selected_sources_stat=[], selected_sources_pval=[], omnibus_pval=1.0, omnibus_sign=False, link_stat={}))
            continue
        own = [next(kept) for _ in r.selected_sources_pval]
        pick = lambda xs, own=own: [x for x, k in zip(xs, own, strict=True) if k]
        left = pick(r.selected_vars_sources)
        out.append(replace(r, selected_vars_sources=left, selected_sources_stat=pick(r.selected_sources_stat), selected_sources_pval=pick(r.selected_sources_pval), link_stat={k: v for k, v in r.link_stat.items() if k in {x[0] for x in left}}))
    return out


def storage_fdr(settings: dict | Settings, results: Sequence[StorageResult]) -> list[StorageResult] | None:
    s = Settings.of(settings)
    p = [r.ais_pval for r in results]
    if not p or 1 / s.n_perm_mi > s.alpha_fdr / len(p) / (1 if s.fdr_constant == 1 else math.fsum(1 / i for i in range(1, len(p) + 1))):
        return None
    return [r if k else replace(r, selected_vars=[], ais_pval=1.0, ais_sign=False) for r, k in zip(results, fdr_of(p, s.alpha_fdr, s.fdr_constant), strict=True)]


_PROGRESS = "target int, step long, vars array<struct<proc:int,lag:int>>"


def write_progress(spark, path: str, target: int, variables: Sequence[Var]) -> None:
    """Append the variables that a target has so far."""
    try:
        step = spark.read.schema(_PROGRESS).parquet(path).count()
    except Exception as e:  # the first write makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        step = 0
    spark.createDataFrame([(target, step, [tuple(v) for v in variables])], _PROGRESS).coalesce(1).write.mode("append").parquet(path)


def resume(spark, path: str) -> dict[int, list[Var]]:
    """``add_conditionals`` for a run that goes on: each target's latest variables."""
    latest = spark.read.schema(_PROGRESS).parquet(path).groupBy("target").agg(F.max_by("vars", "step").alias("vars"))
    return {r["target"]: [tuple(v) for v in r["vars"]] for r in latest.collect()}
