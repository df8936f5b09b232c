"""Comparison of networks between conditions or groups of subjects."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import keyed
from tidewire.operators.embedding import Var
from tidewire.operators.significance import check_n_perm, p_value, p_value_of
from tidewire.plans.estimators import get_estimator
from tidewire.plans.inference import Evaluator, TargetResult
from tidewire.plans.settings import Settings
from tidewire.sources.series import TimeSeries

_LINKS = "target int, source int, diff double, diff_abs double, a_larger boolean, pval double, significant boolean"


def union(networks: Sequence[Sequence[TargetResult]]) -> dict[int, tuple[list[Var], list[Var], int]]:
    """Per target the variables of any network: of sources, of its own past, and the largest lag."""
    out: dict[int, tuple[set, set, int]] = {}
    for network in networks:
        for r in network:
            sources, past, lag = out.setdefault(r.target, (set(), set(), r.current_lag))
            if lag != r.current_lag:
                raise ValueError("the networks differ in their largest lag")
            sources.update(map(tuple, r.selected_vars_sources))
            past.update(map(tuple, r.selected_vars_target))
    return {t: (sorted(s), sorted(p), lag) for t, (s, p, lag) in sorted(out.items())}


class NetworkComparison:
    """Differences of link information, tested against permuted data or relabelled subjects."""

    def __init__(self, settings: dict | Settings) -> None:
        self.s = replace(Settings.of(settings))
        if self.s.stats_type not in ("dependent", "independent"):
            raise RuntimeError("stats_type is dependent or independent")
        check_n_perm(self.s.n_perm_comp, self.s.alpha_comp)

    def _links(self, series: TimeSeries, target: int, sources: list[Var], past: list[Var], lag: int, n_perm: int = 0, seed: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
        procs = sorted({v[0] for v in sources})
        if not procs:
            return [], np.zeros(0), np.zeros((0, n_perm))
        s = replace(self.s, seed=self.s.seed + seed)
        ev = Evaluator(series, target, [*sources, *past], lag, s, get_estimator(s.estimator, s.estimator_options))
        try:
            jobs = [([v for v in sources if v[0] == p], [*past, *(v for v in sources if v[0] != p)]) for p in procs]
            stats, table = ev.run(jobs, n_perm, of="y")
        finally:
            ev.close()
        return procs, stats, table

    def _frame(self, spark: SparkSession, rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, _LINKS)

    def calculate_link_te(self, series: TimeSeries, network: Sequence[TargetResult]) -> dict[tuple[int, int], float]:
        """(target, source): information of each link of one network."""
        return {(t, p): float(v) for t, (sources, past, lag) in union([network]).items() for p, v in zip(*self._links(series, t, sources, past, lag)[:2], strict=True)}

    def compare_within(self, network_a: Sequence[TargetResult], network_b: Sequence[TargetResult], data_a: TimeSeries, data_b: TimeSeries) -> DataFrame:
        """Two conditions of one subject: surrogates permute the current value in each."""
        if data_a.sizes != data_b.sizes:
            raise RuntimeError("the data sets differ in size")
        n = data_a.n_replications
        orders = 2**n if self.s.stats_type == "dependent" else math.comb(2 * n, n)
        if orders < self.s.n_perm_comp and not self.s.permute_in_time and n > 1:
            raise RuntimeError("there are too few replications for so many permutations")
        rows = []
        for target, (sources, past, lag) in union([network_a, network_b]).items():
            procs, a, table_a = self._links(data_a, target, sources, past, lag, self.s.n_perm_comp, 1)
            _, b, table_b = self._links(data_b, target, sources, past, lag, self.s.n_perm_comp, 2)
            for k, p in enumerate(procs):
                rows.append(self._row(target, p, a[k] - b[k], table_a[k] - table_b[k]))
        return self._frame(data_a.df.sparkSession, rows)

    def _row(self, target: int, source: int, diff: float, surrogates: np.ndarray) -> tuple:
        sign, p = p_value_of(float(diff), surrogates.tolist(), self.s.alpha_comp, self.s.tail_comp)
        return target, source, float(diff), abs(float(diff)), bool(diff > 0), p, sign

    def compare_links_within(self, link_a: tuple[int, int], link_b: tuple[int, int], network: Sequence[TargetResult], data: TimeSeries) -> DataFrame:
        """Two links (source, target) of one network."""
        own = union([network])
        got = []
        for k, (source, target) in enumerate((link_a, link_b)):
            if target not in own or source not in {v[0] for v in own[target][0]}:
                raise RuntimeError(f"the network has no link {source} -> {target}")
            procs, stats, table = self._links(data, target, *own[target], self.s.n_perm_comp, k + 1)
            got.append((stats[procs.index(source)], table[procs.index(source)]))
        return self._frame(data.df.sparkSession, [self._row(link_a[1], link_a[0], got[0][0] - got[1][0], got[0][1] - got[1][1])])

    def compare_between(self, networks_a: Sequence[Sequence[TargetResult]], networks_b: Sequence[Sequence[TargetResult]], data_a: Sequence[TimeSeries], data_b: Sequence[TimeSeries]) -> DataFrame:
        """Two groups of subjects: surrogates deal the subjects' values anew to the groups."""
        if self.s.stats_type == "dependent" and len(data_a) != len(data_b):
            raise RuntimeError("paired groups are of one size")
        own = union([*networks_a, *networks_b])
        rows = []
        for group, subjects in ((0, data_a), (1, data_b)):
            for k, series in enumerate(subjects):
                for target, (sources, past, lag) in own.items():
                    procs, stats, _ = self._links(series, target, sources, past, lag)
                    rows += [(group, k, target, p, float(v)) for p, v in zip(procs, stats, strict=True)]
        spark = data_a[0].df.sparkSession
        values = spark.createDataFrame(rows, "group_id int, subject int, target int, source int, cmi double")
        return between_groups(values, self.s.n_perm_comp, self.s.alpha_comp, self.s.tail_comp, self.s.seed, paired=self.s.stats_type == "dependent")


def group_difference(values: DataFrame, keys: Sequence[str] = ("target", "source")) -> DataFrame:
    """keys, diff: mean of group 0 less mean of group 1."""
    means = values.groupBy(*keys).agg(F.avg(F.when(F.col("group_id") == 0, F.col("cmi"))).alias("a"), F.avg(F.when(F.col("group_id") == 1, F.col("cmi"))).alias("b"))
    return means.select(*keys, (F.col("a") - F.col("b")).alias("diff"))


def relabelled(values: DataFrame, n_perm: int, seed: int, paired: bool) -> DataFrame:
    """Copies of the values, one per permutation, with subjects dealt anew to groups of the same sizes (or pairs swapped)."""
    perms = values.sparkSession.range(n_perm).select(F.col("id").cast("int").alias("perm"))
    subjects = values.select("group_id", "subject").distinct()
    grid = perms.crossJoin(subjects)  # permutations x subjects
    if paired:
        dealt = grid.withColumn("new", F.when(F.conv(F.substring(keyed(seed, "perm", "subject"), 1, 8), 16, 10).cast("long") % 2 == 1, 1 - F.col("group_id")).otherwise(F.col("group_id")))
    else:
        order = Window.partitionBy("perm").orderBy(keyed(seed, "perm", "group_id", "subject"), "group_id", "subject")
        first = F.count_if(F.col("group_id") == 0).over(Window.partitionBy("perm"))
        dealt = grid.withColumn("new", (F.row_number().over(order) > first).cast("int"))
    return values.join(dealt, ["group_id", "subject"]).drop("group_id").withColumnRenamed("new", "group_id")


def between_groups(values: DataFrame, n_perm: int, alpha: float = 0.05, tail: str = "two", seed: int = 1, paired: bool = False) -> DataFrame:
    """The links' differences with p-values from relabelled subjects."""
    keys = ["target", "source"]
    table = group_difference(relabelled(values, n_perm, seed, paired), ["perm", *keys]).withColumnRenamed("diff", "__s")
    tested = group_difference(values, keys).join(table, keys).groupBy(*keys, "diff").agg(p_value(F.col("diff"), F.col("__s"), tail).alias("pval"))
    limit = alpha / 2 if tail == "two" else alpha
    return tested.select(*keys, "diff", F.abs("diff").alias("diff_abs"), (F.col("diff") > 0).alias("a_larger"), "pval", (F.col("pval") < limit).alias("significant"))


def adjacency(compared: DataFrame, weights: str = "comparison") -> DataFrame:
    """source, target, weight of a comparison: every link (union), the significant ones (comparison), or all with their diff_abs or pvalue."""
    kinds = {"union": F.lit(1.0), "comparison": F.when(F.col("significant"), 1.0), "diff_abs": F.col("diff_abs"), "pvalue": F.col("pval")}
    if weights not in kinds:
        raise RuntimeError(f"unknown weights {weights!r}")
    return compared.select("source", "target", kinds[weights].alias("weight")).where("weight is not null")
