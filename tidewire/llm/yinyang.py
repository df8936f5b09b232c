"""Lloyd's clustering by Yinyang bounds, exact in integers.

The first centroids are put into groups once.  Every vector carries its cluster, an
upper bound of the distance to it and one lower bound for each group of centroids.
When centroids have moved, bounds give way by how far they did: a vector whose least
lower bound stays above its upper bound keeps its cluster (global filter), first with
the bound, then with the exact distance; else only groups whose lower bound doesn't
are looked at, and of these only centroids whose own bound doesn't (local filter) are
compared exactly.  Bounds are loosened by more than their rounding, so assignments and
ties are those of comparing everything.

A round is one pass over the written state and one aggregate of a row for each
cluster; the centroids, ``k`` times the dimension numbers, go through the driver, and
``MOST_NUMBERS`` bounds them.

Defined cases: vectors that are null, have another dimension, or hold null or
non-finite components take no part; rows that repeat an id are vectors of their own;
a row without an id takes part but comes last as a first centroid; ties of distance go
to the smaller number, ties among first centroids to the vector that sorts first; a
cluster without vectors stays where it is; with fewer vectors than ``k`` all are
centroids; a distance that doesn't fit a long, or components whose sums need more than
38 digits, raise OverflowError; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import written
from tidewire.llm.topk import quantised

#: Numbers of all centroids together, at most; centroids in a group, about; rounds of the grouping.
MOST_NUMBERS, GROUP_SIZE, GROUP_ROUNDS = 1 << 23, 8, 5
#: Distances that a task holds at once.
AT_ONCE = 1 << 22
#: More than what the rounding of a root and of some sums can amount to, as a share.
SLACK = 1e-12
_STATE = "vec_id long, v array<double>, cluster int, upper double, lower array<double>, scanned int"


@dataclass
class Clustering:
    """vec_id, cluster, distance, scanned (centroids compared in the last pass) of every vector; the centroids; vectors and exact distances of each pass."""

    assigned: DataFrame
    centroids: list[list[int]]
    passes: list[tuple[int, int]]


def floor_mean(total: int, count: int) -> int:
    return int(total) // int(count)


def whole(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids in a kind of number in which squared distances are exact."""
    most = max(float(np.abs(v).max(initial=0.0)), *(float(max(map(abs, c), default=0)) for c in centroids), 1.0)
    if 4.0 * most * most * v.shape[1] < 2.0**53:
        return v, np.array(centroids, dtype=np.float64)
    return np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape), np.array(centroids, dtype=object)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to a centroid (or to one each)."""
    return ((v - c) ** 2).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def grouped(centroids: list[list[int]], groups: int) -> np.ndarray:
    """The group of each centroid: some rounds of Lloyd's over the centroids, from evenly chosen ones."""
    points = np.array(centroids, dtype=np.float64)
    points /= max(1.0, np.abs(points).max(initial=1.0))
    centres = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(GROUP_ROUNDS):
        of = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1) if len(points) * groups * points.shape[1] <= AT_ONCE else np.array([((p - centres) ** 2).sum(axis=1).argmin() for p in points])
        centres = np.array([points[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


def first_pass(v: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound, lower bounds and compared centroids by comparing everything."""
    d = np.stack([squared(v, x) for x in c], axis=1)
    cluster = np.array(d.argmin(axis=1), dtype=np.int64)
    far = root(d)
    upper = far[np.arange(len(v)), cluster]
    far[np.arange(len(v)), cluster] = np.inf
    lower = np.stack([far[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return cluster, upper, lower, np.full(len(v), len(c))


def next_pass(v: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids have moved by ``drift``: bounds first, then only what they leave."""
    before, cluster = lower, cluster.copy()
    of_group = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = before * (1 - SLACK) - of_group * (1 + SLACK)
    scanned = np.zeros(len(v), dtype=np.int64)
    rows = np.flatnonzero(lower.min(axis=1) <= upper * (1 + SLACK))
    own = squared(v[rows], c[cluster[rows]])
    upper[rows], scanned[rows] = root(own), 1
    left = lower[rows].min(axis=1) <= upper[rows] * (1 + SLACK)
    rows, own = rows[left], own[left]
    if not len(rows):
        return cluster, upper, lower, scanned
    old, reach = cluster[rows], upper[rows] * (1 + SLACK)
    best, which = own.copy(), old.copy()
    bound = before[rows][:, group] * (1 - SLACK) - drift * (1 + SLACK)  # of every centroid by itself
    bound[np.arange(len(rows)), old] = upper[rows]
    look = (lower[rows] <= reach[:, None])[:, group] & (bound <= reach[:, None])
    look[np.arange(len(rows)), old] = False
    for k in np.flatnonzero(look.any(axis=0)):
        at = np.flatnonzero(look[:, k])
        d = squared(v[rows[at]], c[k])
        bound[at, k] = root(d)
        better = (d < best[at]) | ((d == best[at]) & (k < which[at]))
        best[at[better]], which[at[better]] = d[better], k
    scanned[rows] += look.sum(axis=1)
    cluster[rows], upper[rows] = which, root(best)
    bound[np.arange(len(rows)), which] = np.inf
    lower[rows] = np.stack([bound[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1)
    return cluster, upper, lower, scanned


def _pass(centroids: list[list[int]], moved: list[float] | None, group: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(1, AT_ONCE // max(1, len(centroids)))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, each):
                batch = whole_batch.slice(at, each)
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                v, c = whole(values, centroids)
                if moved is None:
                    cluster, upper, lower, scanned = first_pass(v, c, group)
                else:
                    lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    cluster, upper, lower, scanned = next_pass(v, c, group, np.array(moved), batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), lower)
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32)), pa.array(lower.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), bounds, pa.array(scanned, pa.int32())], ["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    return run


def _distances(centroids: list[list[int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            v, c = whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), centroids)
            d = [int(x) for x in squared(v, c[cluster])]
            if max(d, default=0) >= 1 << 63:
                raise OverflowError("a distance doesn't fit a long")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d, pa.int64()), batch.column("scanned")], ["vec_id", "cluster", "distance", "scanned"])

    return run


def _sums(state: DataFrame, dim: int, kind: str) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster: k rows."""
    totals = [F.sum(F.col("v")[i].cast(kind)) for i in range(dim)]
    return {r[0]: (r[1], [int(x) for x in r[2]]) for r in state.groupBy("cluster").agg(F.count("*"), F.array(*totals)).collect()}


def kept_vectors(vectors: DataFrame, dim: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    sound = (F.size(x) == dim) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.where(x.isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), quantised(x, scale).alias("v"))


def yinyang(vectors: DataFrame, k: int, dim: int, order: Callable[[Column], Column], *, scale: float = 64.0, rounds: int = 3, group_size: int = GROUP_SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """``rounds`` of assignment and update, then one more assignment; ``order`` of the id picks the first centroids."""
    if k * dim > MOST_NUMBERS:
        raise ValueError(f"centroids go to every task: {k} times {dim} is above {MOST_NUMBERS} numbers")
    spark = vectors.sparkSession
    own = written(kept_vectors(vectors, dim, scale, id_col, vector_col), "vectors")
    n, most = own.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long, scanned int"), [], [])
    if most * n >= 1e38:
        raise OverflowError("components too large for exact sums")
    kind = "long" if most * n < 2**62 else "decimal(38,0)"
    first = own.orderBy(order(F.col("vec_id")).asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(x) for x in r["v"]] for r in first]
    group = grouped(centroids, -(-len(centroids) // group_size))
    state, moved, passes = own, None, []
    for turn in range(rounds + 1):
        state = written(state.mapInArrow(_pass(centroids, moved, group), _STATE), "state")
        passes.append(tuple(state.agg(F.count("*"), F.sum("scanned")).first()))
        if turn == rounds:
            break
        sums = _sums(state, dim, kind)
        new = [[floor_mean(x, sums[j][0]) for x in sums[j][1]] if j in sums else c for j, c in enumerate(centroids)]
        gap = [sum((a - b) ** 2 for a, b in zip(c, d, strict=True)) for c, d in zip(new, centroids, strict=True)]
        moved, centroids = [float(g) ** 0.5 * (1 + SLACK) for g in gap], new
    assigned = state.select("vec_id", "v", "cluster", "scanned").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long, scanned int")
    return Clustering(assigned, centroids, passes)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: Clustering) -> DataFrame:
    """The assignment with each cluster's and the whole inertia and the digest of the centroid."""
    spark = found.assigned.sparkSession
    own = written(found.assigned, "assigned")
    each = {r[0]: r[1] for r in own.groupBy("cluster").agg(F.sum("distance")).collect()}  # at most k rows
    facts = [(j, each.get(j, 0), sum(each.values()), centroid_digest(c)) for j, c in enumerate(found.centroids)]
    if facts and facts[0][2] >= 1 << 63:
        raise OverflowError("the inertia doesn't fit a long")
    return own.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
