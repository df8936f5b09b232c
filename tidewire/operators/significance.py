"""Significance of statistics against surrogate tables, as DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAILS = ("one", "one_bigger", "one_smaller", "two")


def check_n_perm(n_perm: int, alpha: float) -> None:
    if not 1 / n_perm < alpha:
        raise RuntimeError(f"{n_perm} permutations can't give a p-value below {alpha}")


def p_value_of(statistic: float, surrogates: Sequence[float], alpha: float = 0.05, tail: str = "one_bigger") -> tuple[bool, float]:
    """Significance and p-value; p is never 0, and a two-sided p is the smaller tail, held against half of alpha."""
    if tail not in TAILS:
        raise ValueError(f"unknown tail {tail!r}")
    n = len(surrogates)
    check_n_perm(n, alpha)
    bigger, smaller = sum(bool(s >= statistic) for s in surrogates) / n, sum(bool(s <= statistic) for s in surrogates) / n
    p = {"one_smaller": smaller, "two": min(bigger, smaller)}.get(tail, bigger)
    p = p or 1 / n
    return p < (alpha / 2 if tail == "two" else alpha), float(p)


@dataclass(frozen=True)
class Drawn:
    """A null distribution of several candidates by their surrogates (candidate x permutation)."""

    table: np.ndarray

    def largest(self, stat: float, alpha: float) -> tuple[bool, float]:
        return p_value_of(stat, self.table.max(axis=0), alpha)

    def smallest(self, stat: float, alpha: float) -> tuple[bool, float]:
        return p_value_of(stat, self.table.min(axis=0), alpha)

    def ranked(self, rank: int, stat: float, alpha: float) -> tuple[bool, float]:
        """Against the surrogates' largest but ``rank``."""
        return p_value_of(stat, -np.sort(-self.table, axis=0)[rank], alpha)

    def of(self, at: Sequence[int]) -> Drawn:
        return Drawn(self.table[at])


@dataclass(frozen=True)
class Closed:
    """The same in closed form: the probability that a candidate's surrogate reaches a value, candidates being independent.

    No p-value is below 1 / n_perm, which is what that many surrogates could show.
    """

    tails: tuple[Callable[[float], float], ...]
    n_perm: int

    def _held(self, p: float, alpha: float) -> tuple[bool, float]:
        check_n_perm(self.n_perm, alpha)
        p = min(1.0, max(p, 1 / self.n_perm))
        return p < alpha, p

    def largest(self, stat: float, alpha: float) -> tuple[bool, float]:
        return self._held(1 - math.prod(1 - t(stat) for t in self.tails), alpha)

    def smallest(self, stat: float, alpha: float) -> tuple[bool, float]:
        return self._held(math.prod(t(stat) for t in self.tails), alpha)

    def ranked(self, rank: int, stat: float, alpha: float) -> tuple[bool, float]:
        """That more than ``rank`` of the surrogates reach the value."""
        some = [1.0]  # by how many do
        for t in self.tails:
            q = t(stat)
            some = [a * (1 - q) + b * q for a, b in zip([*some, 0.0], [0.0, *some], strict=True)]
        return self._held(math.fsum(some[rank + 1 :]), alpha)

    def of(self, at: Sequence[int]) -> Closed:
        return Closed(tuple(self.tails[k] for k in at), self.n_perm)


def p_value(statistic: Column, surrogate: Column, tail: str = "one_bigger") -> Column:
    """The p-value as an aggregate over rows of surrogates."""
    if tail not in TAILS:
        raise ValueError(f"unknown tail {tail!r}")
    share = {"b": F.avg(F.when(surrogate >= statistic, 1.0).otherwise(0.0)), "s": F.avg(F.when(surrogate <= statistic, 1.0).otherwise(0.0))}
    p = share["s"] if tail == "one_smaller" else F.least(share["b"], share["s"]) if tail == "two" else share["b"]
    return F.greatest(p, 1.0 / F.count("*"))


def table_extreme(table: DataFrame, keys: Sequence[str] = (), kind: str = "max") -> DataFrame:
    """keys, perm, stat: the largest or smallest statistic of each permutation over candidates."""
    own = F.max("stat") if kind == "max" else F.min("stat")
    return table.groupBy(*keys, "perm").agg(own.alias("stat"))


def extreme_statistic(observed: DataFrame, table: DataFrame, keys: Sequence[str] = (), kind: str = "max") -> DataFrame:
    """keys, stat, p: the largest (smallest) observed statistic against the surrogates' largest (smallest).

    ``observed`` has keys, cand, stat; ``table`` has keys, cand, perm, stat.
    """
    own = F.max("stat") if kind == "max" else F.min("stat")
    best = observed.groupBy(*keys).agg(own.alias("observed"))
    extremes = table_extreme(table, keys, kind)
    met = extremes.join(F.broadcast(best), list(keys)) if keys else extremes.crossJoin(F.broadcast(best))
    return met.groupBy(*keys, "observed").agg(p_value(F.col("observed"), F.col("stat")).alias("p")).withColumnRenamed("observed", "stat")


def sequential_max(observed: DataFrame, table: DataFrame, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cand, rank, stat, p, significant: the r-th largest statistic against the surrogates' r-th largest.

    The first that fails keeps its p; all after it have p = 1 and aren't significant.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("stat"), "cand")
    ranked = observed.withColumn("rank", F.row_number().over(down))
    in_perm = Window.partitionBy(*keys, "perm").orderBy(F.desc("stat"))
    surrogates = table.withColumn("rank", F.row_number().over(in_perm)).select(*keys, "rank", F.col("stat").alias("__s"))
    tested = ranked.join(surrogates, [*keys, "rank"]).groupBy(*keys, "cand", "rank", "stat").agg(p_value(F.col("stat"), F.col("__s")).alias("p"))
    before = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((F.col("p") >= alpha).cast("int")).over(before), F.lit(0)) == 1
    return tested.withColumn("__failed", failed).select(*keys, "cand", "rank", "stat", F.when(F.col("__failed"), 1.0).otherwise(F.col("p")).alias("p"), (~F.col("__failed") & (F.col("p") < alpha)).alias("significant"))


def fdr_constant(n: int, constant: int) -> float:
    """1 for independent or positively dependent tests, else the sum of 1 / i."""
    if constant not in (1, 2):
        raise ValueError("the constant is 1 or 2")
    return 1.0 if constant == 1 else math.fsum(1 / i for i in range(1, n + 1))


def fdr(p_values: DataFrame, alpha: float = 0.05, constant: int = 2, p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """``p_values`` with ``significant``: the step-up rule over all rows (of a group of ``keys``)."""
    own = Window.partitionBy(*keys)
    order = own.orderBy(p)
    n = F.count("*").over(own)
    rank = F.rank().over(order) + F.count("*").over(own.orderBy(p).rangeBetween(0, 0)) - 1  # ties take the last rank
    scale = F.lit(1.0) if constant == 1 else F.aggregate(F.sequence(F.lit(1), F.col("__n").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    ranked = p_values.withColumn("__n", n).withColumn("__rank", rank)
    met = F.col(p) <= F.col("__rank") / F.col("__n") * alpha / scale
    last = F.max(F.when(met, F.col("__rank")).otherwise(0)).over(own)
    return ranked.withColumn("__last", last).withColumn("significant", F.col("__rank") <= F.col("__last")).drop("__n", "__rank", "__last")


def fdr_of(p: Sequence[float], alpha: float = 0.05, constant: int = 2) -> list[bool]:
    """The same rule on a driver-side list."""
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    limit = max((k for k in range(1, n + 1) if p[order[k - 1]] <= k / n * alpha / fdr_constant(n, constant)), default=0)
    out = [False] * n
    for k in order[:limit]:
        out[k] = True
    return out
