"""Generators of benchmark series; each replication is a recurrence of its own, made where its row is."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The five-node benchmark network (fixed values): to, from, lag, weight.
LINEAR_TERMS = [
    (0, 0, 1, 0.95 * math.sqrt(2)),
    (0, 0, 2, -0.9025),
    (2, 0, 3, -0.4),
    (3, 3, 1, 0.25 * math.sqrt(2)),
    (3, 4, 1, 0.25 * math.sqrt(2)),
    (4, 3, 1, -0.25 * math.sqrt(2)),
    (4, 4, 1, 0.25 * math.sqrt(2)),
]
SQUARED_TERMS = [(1, 0, 2, 0.5), (3, 0, 2, -0.5)]

_SCHEMA = "proc int, repl int, sample int, value double"


def _generated(spark: SparkSession, n_replications: int, seed: int, make: Callable[[np.random.Generator], np.ndarray]) -> DataFrame:
    """``make`` gives (process, sample) of one replication."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["id"].iloc[0])
        x = make(np.random.default_rng([seed, r]))
        p, s = np.indices(x.shape)
        return pd.DataFrame({"proc": p.ravel().astype("int32"), "repl": np.int32(r), "sample": s.ravel().astype("int32"), "value": x.ravel()})

    return spark.range(n_replications).groupBy("id").applyInPandas(one, _SCHEMA)


def coupled_network(spark: SparkSession, n_samples: int = 1_000, n_replications: int = 10, seed: int = 1) -> DataFrame:
    """Five nodes: 0 drives 1 (lag 2), 2 (lag 3, nonlinear) and 3 (lag 2); 3 and 4 drive each other (lag 1)."""

    linear = np.zeros((3, 5, 5))
    squared = np.zeros((3, 5, 5))
    for to, source, lag, weight in LINEAR_TERMS:
        linear[lag - 1, to, source] = weight
    for to, source, lag, weight in SQUARED_TERMS:
        squared[lag - 1, to, source] = weight

    def make(rng: np.random.Generator) -> np.ndarray:
        past = [rng.normal(size=5) for _ in range(3)]  # the latest first
        out = np.empty((n_samples, 5))
        for row, noise in zip(out, rng.normal(size=(n_samples, 5)), strict=True):
            row[:] = noise + sum(linear[k] @ x + squared[k] @ x**2 for k, x in enumerate(past))
            past = [row.copy(), *past[:2]]
        return out.T

    return _generated(spark, n_replications, seed, make)


def _coupling(coefficients: np.ndarray, rng: np.random.Generator, n_samples: int, noise_std: float, step: Callable[[np.ndarray], np.ndarray], begin: np.ndarray) -> np.ndarray:
    order, n_proc = coefficients.shape[0], coefficients.shape[1]
    transient = 10 * n_proc
    n = order + n_samples + transient
    x = np.zeros((n_proc, n))
    x[:, :order] = begin
    for t in range(order, n):
        linear = sum(coefficients[k] @ x[:, t - 1 - k] for k in range(order))
        x[:, t] = step(linear + 0.0) if step is not None else linear
        x[:, t] += rng.normal(0, noise_std, n_proc)
        if step is not None:
            x[:, t] %= 1
    return x[:, n - n_samples :]


def autoregressive(spark: SparkSession, coefficients: np.ndarray, n_samples: int = 1_000, n_replications: int = 10, noise_std: float = 0.1, seed: int = 1) -> DataFrame:
    """x(t) = sum of A[lag] x(t - 1 - lag) + noise, with A[lag][to][from]; refused where it isn't stable."""
    a = np.asarray(coefficients, dtype=float)
    order, n_proc = a.shape[0], a.shape[1]
    companion = np.zeros((order * n_proc, order * n_proc))
    companion[:n_proc] = np.hstack(list(a))
    companion[n_proc:, : (order - 1) * n_proc] = np.eye((order - 1) * n_proc)
    if np.abs(np.linalg.eigvals(companion)).max() >= 1:
        raise RuntimeError("the process isn't stable")
    return _generated(spark, n_replications, seed, lambda rng: _coupling(a, rng, n_samples, noise_std, None, rng.normal(size=(n_proc, order))))


def logistic_maps(spark: SparkSession, coefficients: np.ndarray, n_samples: int = 1_000, n_replications: int = 10, noise_std: float = 0.1, seed: int = 1) -> DataFrame:
    """Coupled logistic maps: f(x) = 4 x (1 - x) of the coupled input, plus noise, modulo 1."""
    a = np.asarray(coefficients, dtype=float)
    return _generated(spark, n_replications, seed, lambda rng: _coupling(a, rng, n_samples, noise_std, lambda v: 4 * v * (1 - v), rng.random((a.shape[1], a.shape[0]))))
