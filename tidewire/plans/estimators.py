"""Estimators of conditional mutual information that the analyses can use, by name.

An estimator gets one frame per round: the embedded rows of one target, once as
they are (perm = -1) and once per permutation, with permuted copies of the columns
under test.  It returns the statistic of every job and permutation; discrete and
Gaussian ones do so by aggregates, others by a kernel over the arrays of one
permutation.  ``register`` takes any function of (x, y, z) arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import equal_width, max_entropy
from tidewire.functions.special import chi2_quantiles, chi2_sf
from tidewire.operators import discrete, gaussian
from tidewire.operators.knn import ksg

Stats = dict[tuple[int, int], float]


@dataclass(frozen=True)
class Job:
    """One statistic I(x; y | z): columns of the frame."""

    x: tuple[str, ...]
    y: tuple[str, ...]
    z: tuple[str, ...] = ()


@dataclass
class Estimator:
    """Base: a name, and whether a closed-form null distribution exists."""

    name: str = ""
    analytic: bool = False
    options: dict = field(default_factory=dict)

    def prepare(self, series: DataFrame) -> DataFrame:
        return series

    def evaluate(self, frame: DataFrame, jobs: Sequence[Job]) -> Stats:
        raise NotImplementedError

    def summary(self, frame: DataFrame) -> object | None:
        """What one pass over a frame must keep so that all observed statistics follow from it; None if nothing can."""
        return None

    def from_summary(self, summary: object, jobs: Sequence[Job]) -> Stats:
        raise NotImplementedError

    def local(self, frame: DataFrame, job: Job) -> DataFrame:
        """repl, sample, local: the pointwise values whose mean is the statistic."""
        raise RuntimeError(f"{self.name} has no local values")

    def null_quantiles(self, u: np.ndarray, job: Job, n: int, levels: int) -> np.ndarray:
        raise RuntimeError(f"{self.name} has no closed-form null distribution")

    def tail(self, stat: float, job: Job, n: int, levels: int) -> float:
        """The probability that a surrogate reaches ``stat``, where there is a closed form."""
        raise RuntimeError(f"{self.name} has no closed-form null distribution")


class GaussianCMI(Estimator):
    """nats; 2 N I is chi-square with |x| |y| degrees of freedom without dependence."""

    def evaluate(self, frame: DataFrame, jobs: Sequence[Job]) -> Stats:
        columns = sorted({c for j in jobs for c in (*j.x, *j.y, *j.z)})
        return self._of(columns, gaussian.covariances(frame, columns, "perm"), jobs)

    @staticmethod
    def _of(columns: list[str], found: dict, jobs: Sequence[Job]) -> Stats:
        at = {c: k for k, c in enumerate(columns)}
        return {(k, perm): gaussian.cmi_of(c, [at[v] for v in j.x], [at[v] for v in j.y], [at[v] for v in j.z]) for perm, (_, c) in found.items() for k, j in enumerate(jobs)}

    def summary(self, frame: DataFrame) -> object | None:
        columns = sorted(c for c in frame.columns if c not in ("repl", "sample"))
        return columns, {-1: gaussian.covariances(frame, columns)[None]}

    def from_summary(self, summary: object, jobs: Sequence[Job]) -> Stats:
        return self._of(*summary, jobs)

    def local(self, frame: DataFrame, job: Job) -> DataFrame:
        return gaussian.local_cmi(frame, job.x, job.y, job.z).select("repl", "sample", "local")

    def null_quantiles(self, u: np.ndarray, job: Job, n: int, levels: int) -> np.ndarray:
        return chi2_quantiles(u, len(job.x) * len(job.y)) / (2 * n)

    def tail(self, stat: float, job: Job, n: int, levels: int) -> float:
        return chi2_sf(2 * n * stat, len(job.x) * len(job.y))


class DiscreteCMI(Estimator):
    """bits; values are binned first (equal_width or max_entropy with n_bins) unless they are symbols already (none)."""

    def prepare(self, series: DataFrame) -> DataFrame:
        how, bins = self.options.get("discretise_method", "none"), self.options.get("n_bins", 2)
        if how == "none":
            return series
        return {"equal": equal_width, "max_ent": max_entropy}[how](series, bins)

    def evaluate(self, frame: DataFrame, jobs: Sequence[Job]) -> Stats:
        each = [F.struct(F.lit(k).alias("job"), F.array(*j.x).alias("x"), F.array(*j.y).alias("y"), (F.array(*j.z) if j.z else F.array(F.lit(0))).alias("z")) for k, j in enumerate(jobs)]
        values = frame.select("perm", *(F.col(c).cast("int").alias(c) for c in frame.columns if c != "perm"))
        rows = values.select("perm", F.explode(F.array(*each)).alias("e")).select("perm", "e.*")
        return {(r["job"], r["perm"]): r["cmi"] for r in discrete.cmi(rows, ["x"], ["y"], ["z"], ["job", "perm"]).collect()}

    def local(self, frame: DataFrame, job: Job) -> DataFrame:
        return discrete.local_cmi(frame, job.x, job.y, job.z).select("repl", "sample", "local")

    def null_quantiles(self, u: np.ndarray, job: Job, n: int, levels: int) -> np.ndarray:
        return chi2_quantiles(u, self._dof(job, levels)) / (2 * n * np.log(2))

    @staticmethod
    def _dof(job: Job, levels: int) -> int:
        return (levels ** len(job.x) - 1) * (levels ** len(job.y) - 1) * levels ** len(job.z)

    def tail(self, stat: float, job: Job, n: int, levels: int) -> float:
        return chi2_sf(2 * n * np.log(2) * stat, self._dof(job, levels))


class KernelCMI(Estimator):
    """Any function of (x, y, z) on the arrays of one permutation."""

    function: Callable = staticmethod(ksg)

    def evaluate(self, frame: DataFrame, jobs: Sequence[Job]) -> Stats:
        function, options, own = self.function, dict(self.options), list(jobs)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["repl", "sample"])
            perm = int(pdf["perm"].iloc[0])
            values = [function(pdf[list(j.x)].to_numpy(float), pdf[list(j.y)].to_numpy(float), pdf[list(j.z)].to_numpy(float) if j.z else None, **options) for j in own]
            return pd.DataFrame({"job": np.arange(len(own), dtype="int32"), "perm": np.int32(perm), "stat": values})

        got = frame.groupBy("perm").applyInPandas(run, "job int, perm int, stat double").collect()
        return {(r["job"], r["perm"]): r["stat"] for r in got}


    def local(self, frame: DataFrame, job: Job) -> DataFrame:
        if self.function is not ksg:
            return super().local(frame, job)
        options = dict(self.options)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["repl", "sample"])
            values = ksg(pdf[list(job.x)].to_numpy(float), pdf[list(job.y)].to_numpy(float), pdf[list(job.z)].to_numpy(float) if job.z else None, local=True, **options)
            return pd.DataFrame({"repl": pdf["repl"], "sample": pdf["sample"], "local": values})

        return frame.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(run, "repl int, sample int, local double")


_REGISTRY: dict[str, Callable[[dict], Estimator]] = {
    "gaussian": lambda o: GaussianCMI("gaussian", True, o),
    "discrete": lambda o: DiscreteCMI("discrete", True, o),
    "kraskov": lambda o: KernelCMI("kraskov", False, o),
}


def register(name: str, function: Callable) -> None:
    """Make ``function(x, y, z, **options)`` (arrays of rows; z may be None) an estimator."""

    def make(options: dict) -> Estimator:
        out = KernelCMI(name, False, options)
        out.function = function
        return out

    _REGISTRY[name] = make


def estimator_names() -> list[str]:
    return sorted(_REGISTRY)


def get_estimator(name: str | Estimator, options: dict | None = None) -> Estimator:
    if isinstance(name, Estimator):
        return name
    if name not in _REGISTRY:
        raise RuntimeError(f"unknown estimator {name!r}; there are {estimator_names()}")
    return _REGISTRY[name](dict(options or {}))
