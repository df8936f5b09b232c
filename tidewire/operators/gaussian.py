"""Estimators for jointly Gaussian variables, in nats.

One pass gives the moments of all columns; whatever sets of variables are asked
for, the driver gets their information from log-determinants of the covariance.
Many columns are one matrix of cross products per task instead of an aggregate each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns up to which each covariance is an aggregate of its own.
FEW_COLUMNS = 24


def _merged(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred cross products of two parts together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moments(columns: Sequence[str]) -> Callable:
    """The rows, means and centred cross products of each group in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            values = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            group = batch.column("__group").to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                x = values[group == g]
                mean = x.mean(axis=0)
                own = len(x), mean, (x - mean).T @ (x - mean)
                held[g] = _merged(held[g], own) if g in held else own
        yield _packed(held)

    return run


def _packed(held: dict) -> pa.RecordBatch:
    rows = list(held.items())
    return pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in rows], pa.int64()), pa.array([r[0] for _, r in rows], pa.int64()), pa.array([r[1].tobytes() for _, r in rows], pa.binary()), pa.array([r[2].tobytes() for _, r in rows], pa.binary())],
        ["__group", "n", "mean", "cross"],
    )


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for g, n, mean, cross in zip(*(batch.column(c).to_pylist() for c in ("__group", "n", "mean", "cross")), strict=True):
            mean = np.frombuffer(mean)
            own = n, mean, np.frombuffer(cross).reshape(len(mean), -1)
            held[g] = _merged(held[g], own) if g in held else own
    yield _packed(held)


def wide_covariances(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """As ``covariances``, by one matrix of cross products per task and group, for any number of columns without nulls."""
    own = df.select(F.col(by).cast("long").alias("__group") if by else F.lit(0).cast("long").alias("__group"), *columns)
    kind = "__group long, n long, mean binary, cross binary"
    got = own.mapInArrow(_moments(list(columns)), kind).repartition("__group").mapInArrow(_merge_parts, kind).collect()
    return {(r["__group"] if by else None): (r["n"], np.frombuffer(r["cross"]).reshape(len(columns), -1) / max(r["n"] - 1, 1)) for r in got}


def covariances(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """Per value of ``by`` (an integer column; None: one key, None): rows and covariance matrix."""
    if len(columns) > FEW_COLUMNS:
        return wide_covariances(df, columns, by)
    pairs = [(a, b) for a in range(len(columns)) for b in range(a, len(columns))]
    own = df.groupBy(by) if by else df.groupBy()
    got = own.agg(F.count("*").alias("n"), *(F.covar_samp(columns[a], columns[b]).alias(f"c{a}_{b}") for a, b in pairs)).collect()
    out = {}
    for row in got:
        c = np.zeros((len(columns), len(columns)))
        for a, b in pairs:
            c[a, b] = c[b, a] = row[f"c{a}_{b}"] if row[f"c{a}_{b}"] is not None else np.nan
        out[row[by] if by else None] = (row["n"], c)
    return out


def _logdet(c: np.ndarray, which: Sequence[int]) -> float:
    if not len(which):
        return 0.0
    sign, value = np.linalg.slogdet(c[np.ix_(which, which)])
    return value if sign > 0 else -np.inf


def cmi_of(c: np.ndarray, x: Sequence[int], y: Sequence[int], z: Sequence[int] = ()) -> float:
    """1/2 ln(|xz| |yz| / (|z| |xyz|)) of a covariance matrix; indices that x, y or z share are taken once."""
    x, y, z = [i for i in dict.fromkeys(x) if i not in z], [i for i in dict.fromkeys(y) if i not in z], list(dict.fromkeys(z))
    return 0.5 * (_logdet(c, [*x, *z]) + _logdet(c, [*y, *z]) - _logdet(c, z) - _logdet(c, [*x, *y, *z]))


def mi_expr(x: str, y: str) -> Column:
    """Mutual information of two columns as an aggregate expression."""
    r = F.corr(x, y)
    return -0.5 * F.log(1 - r * r)


def cmi_expr(x: str, y: str, z: str) -> Column:
    """Conditional information of two columns given a third, by the partial correlation."""
    xy, xz, yz = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    partial2 = (xy - xz * yz) * (xy - xz * yz) / ((1 - xz * xz) * (1 - yz * yz))
    return -0.5 * F.log(1 - partial2)


def local_cmi(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), name: str = "local") -> DataFrame:
    """Each row with its pointwise value: log densities under the covariance of all rows, as column expressions."""
    columns = list(dict.fromkeys([*x, *y, *z]))
    at = {c: k for k, c in enumerate(columns)}
    _, c = covariances(df, columns)[None]
    means = df.agg(*(F.avg(v) for v in columns)).first()
    gap = [F.col(v) - F.lit(float(m)) for v, m in zip(columns, means, strict=True)]

    def half_distance(which: Sequence[str]) -> Column:
        own = [at[v] for v in which]
        if not own:
            return F.lit(0.0)
        inverse = np.linalg.inv(c[np.ix_(own, own)])
        return sum((gap[a] * gap[b] * float(0.5 * inverse[i, j]) for i, a in enumerate(own) for j, b in enumerate(own)), F.lit(0.0))

    joint, xz, yz = columns, list(dict.fromkeys([*x, *z])), list(dict.fromkeys([*y, *z]))
    average = cmi_of(c, [at[v] for v in x], [at[v] for v in y], [at[v] for v in z])
    return df.withColumn(name, F.lit(average) - half_distance(joint) - half_distance(list(z)) + half_distance(xz) + half_distance(yz))
