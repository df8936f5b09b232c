"""Nearest-neighbour (Kraskov-Stoegbauer-Grassberger) estimators, in nats.

Two forms of one operator: ``neighbour_counts`` and ``ksg_by_cells`` search cells of
about equal counts, so a group of any size spreads over tasks; ``ksg`` compares all
points of arrays, which is quicker for groups of some thousand.  Distances are the
maximum norm (or Euclidean); a point isn't its own neighbour; neighbours in margins
lie strictly closer than the k-th in the joint space.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import beside, psi, standardise
from tidewire.functions.special import digamma
from tidewire.operators import cells
from tidewire.sources.shared import kept

#: Rows of the distance matrix that are held at once.
BLOCK = 512


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    gap = np.abs(a[:, None, :] - b[None, :, :])
    return gap.max(axis=2) if metric == "chebyshev" else np.sqrt((gap**2).sum(axis=2))


def neighbours(points: np.ndarray, k: int, spaces: Sequence[np.ndarray], metric: str = "chebyshev", theiler: int = 0, strict: bool = True) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distance of the k-th neighbour; per space, counts of closer points; and each space's largest distance among the k."""
    n = len(points)
    radius = np.empty(n)
    counts, reach = [np.empty(n, dtype=np.int64) for _ in spaces], [np.empty(n) for _ in spaces]
    for at in range(0, n, BLOCK):
        rows = np.arange(at, min(n, at + BLOCK))
        own = [_distance(s[rows], s, metric) for s in spaces]
        joint = _distance(points[rows], points, metric)
        near = np.abs(rows[:, None] - np.arange(n)[None, :]) <= theiler
        joint[near] = np.inf
        first = np.argpartition(joint, k - 1, axis=1)[:, :k]
        radius[rows] = np.take_along_axis(joint, first, axis=1).max(axis=1)
        for j, d in enumerate(own):
            reach[j][rows] = np.take_along_axis(d, first, axis=1).max(axis=1)
            d[near] = np.inf
            limit = radius[rows] if strict else reach[j][rows]
            counts[j][rows] = ((d < limit[:, None]) if strict else (d <= limit[:, None])).sum(axis=1)
    return radius, counts, reach


def ksg(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, *, k: int = 4, algorithm: int = 1, theiler: int = 0, metric: str = "chebyshev", noise: float = 0.0, seed: int = 0, normalise: bool = False, local: bool = False) -> float | np.ndarray:
    """I(x; y | z) of points given as rows; algorithm 2 is for I(x; y)."""
    parts = [np.asarray(p, dtype=float).reshape(len(x), -1) for p in (x, y, z) if p is not None]
    n = len(parts[0])
    if n - 1 <= k + theiler:
        raise RuntimeError(f"{n} points are too few for k={k} and a Theiler window of {theiler}")
    if normalise:
        parts = [(p - p.mean(axis=0)) / np.where(p.std(axis=0) > 0, p.std(axis=0), 1) for p in parts]
    if noise:
        rng = np.random.default_rng(seed)
        parts = [p + rng.normal(0, noise, p.shape) for p in parts]
    joint = np.hstack(parts)
    if z is None or parts[-1].shape[1] == 0:
        if algorithm == 2:
            _, (nx, ny), _ = neighbours(joint, k, parts[:2], metric, theiler, strict=False)
            values = digamma(k) - 1 / k - digamma(nx) - digamma(ny) + digamma(n)
        else:
            _, (nx, ny), _ = neighbours(joint, k, parts[:2], metric, theiler)
            values = digamma(k) - digamma(nx + 1) - digamma(ny + 1) + digamma(n)
    else:
        _, (nxz, nyz, nz), _ = neighbours(joint, k, [np.hstack([parts[0], parts[2]]), np.hstack([parts[1], parts[2]]), parts[2]], metric, theiler)
        values = digamma(k) + digamma(nz + 1) - digamma(nxz + 1) - digamma(nyz + 1)
    return values if local else float(values.mean())


def _gap(columns: Sequence[str], other: str) -> Column:
    each = [F.abs(F.col(c) - F.col(f"{other}{c}")) for c in columns]
    return F.greatest(*each) if len(each) > 1 else each[0]


def _beyond_window(near: Column, window: Column, k: int) -> Column:
    """The distance of the k-th of a sorted list of (d, m) without the points of the window, whose distances are given."""

    def outside(e: Column) -> Column:
        upto = F.aggregate(F.filter(near, lambda f: f["d"] <= e["d"]), F.lit(0).cast("long"), lambda t, f: t + f["m"])
        return upto - F.size(F.filter(window, lambda w: w <= e["d"])) >= k

    return F.array_min(F.transform(F.filter(near, outside), lambda e: e["d"]))


def _windows(rows: DataFrame, keys: Sequence[str], spaces: dict[str, Sequence[str]], coords: Sequence[str], theiler: int) -> DataFrame:
    """keys, rid, and the distances (joint, and by space) of the points at most ``theiler`` away in rid, itself among them."""
    other = rows.select(*keys, F.col("rid").alias("__o"), *(F.col(c).alias(f"__{c}") for c in coords))
    met = rows.withColumn("__o", F.explode(F.sequence(F.col("rid") - theiler, F.col("rid") + theiler))).join(other, [*keys, "__o"])
    return met.groupBy(*keys, "rid").agg(F.collect_list(_gap(coords, "__")).alias("__w"), *(F.collect_list(_gap(cs, "__")).alias(f"__w_{s}") for s, cs in spaces.items()))


#: Queries of a cell that a task plans together, about.
PLANNED = 4_096


def _counted(points: DataFrame, keys: Sequence[str], spaces: dict[str, Sequence[str]], k: int, theiler: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows, and per distinct point (per row with a Theiler window): keys, qid, coordinates, m, radius, and n_<space>."""
    coords = list(dict.fromkeys(c for cs in spaces.values() for c in cs))
    rows = kept(points.select(*keys, F.col("rid").cast("long").alias("rid"), *((F.col(c).cast("double") + 0.0).alias(c) for c in coords)), "rows")  # no negative zeros
    joint = cells.make_space(rows.groupBy(*keys, *coords).agg(F.count("*").alias("m")).withColumn("qid", F.monotonically_increasing_id()), keys, coords, cell_rows)
    placed = joint.data.join(cells.nearest(joint, k + 2 * theiler + 1), [*keys, "qid"])
    if theiler:
        met = rows.join(placed.drop("m", "qid"), [*keys, *coords]).join(_windows(rows, keys, spaces, coords, theiler), [*keys, "rid"])
        own = {s: F.size(F.filter(f"__w_{s}", lambda w: w < F.col("radius"))) for s in spaces}
        queries = met.withColumn("radius", _beyond_window(F.col("near"), F.col("__w"), k))
        queries = queries.select(*keys, F.col("rid").alias("qid"), *coords, F.lit(1).cast("long").alias("m"), "cell", "radius", *(F.coalesce(own[s], F.lit(0)).cast("long").alias(f"own_{s}") for s in spaces))
        parts = queries.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / PLANNED).alias("__parts"))
        queries = queries.join(parts, [*keys, "cell"]).withColumn("home", F.xxhash64("cell", F.pmod(F.xxhash64("qid"), F.col("__parts")))).drop("cell", "__parts")
    else:
        radius = cells.kth_distance(F.col("near"), k + 1)
        queries = placed.select(*keys, "qid", *coords, "m", F.col("cell").alias("home"), radius.alias("radius"), *((radius > 0).cast("long").alias(f"own_{s}") for s in spaces))
    queries = kept(queries, "queries")
    counts = None
    for s, cs in spaces.items():
        space = cells.make_space(joint.data.groupBy(*keys, *cs).agg(F.sum("m").alias("m")), keys, cs, cell_rows * (cells.LINE if len(cs) == 1 else 1))
        found = cells.range_parts(space, queries.where("radius is not null").withColumnRenamed("radius", "r"), "home").withColumn("space", F.lit(s))
        counts = found if counts is None else counts.unionByName(found)
    met = queries.join(counts.groupBy(*keys, "qid").agg(*(F.sum(F.when(F.col("space") == s, F.col("n"))).alias(f"__n_{s}") for s in spaces)), [*keys, "qid"], "left")
    return rows, met.select(*keys, "qid", *coords, "m", "radius", *(F.coalesce(F.col(f"__n_{s}") - F.col(f"own_{s}"), F.lit(0)).cast("long").alias(f"n_{s}") for s in spaces))


def neighbour_counts(points: DataFrame, keys: Sequence[str], spaces: dict[str, Sequence[str]], k: int, theiler: int = 0, cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """keys, rid, radius, and n_<space> for each space, by cells (maximum norm).

    ``points`` has the keys, rid and the coordinates; the joint space is all coordinates.
    Points of a group that has none at the k-th place have no radius and count none.
    """
    rows, found = _counted(points, keys, spaces, k, theiler, cell_rows)
    names = [*keys, "rid", "radius", *(f"n_{s}" for s in spaces)]
    if theiler:
        return found.withColumnRenamed("qid", "rid").select(*names)
    coords = [c for c in rows.columns if c not in (*keys, "rid")]
    return rows.join(found, [*keys, *coords]).select(*names)


def ksg_by_cells(points: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), name: str = "mi", *, k: int = 4, theiler: int = 0, cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """keys, name: the estimate of each group from the counts of its cells (algorithm 1, maximum norm); a group spreads over tasks."""
    spaces = {"xz": [*x, *z], "yz": [*y, *z], "z": list(z)} if z else {"x": list(x), "y": list(y)}
    found = _counted(points, keys, spaces, k, theiler, cell_rows)[1]
    if z:
        value = psi(F.col("n_z") + 1) - psi(F.col("n_xz") + 1) - psi(F.col("n_yz") + 1)
    else:
        value = -psi(F.col("n_x") + 1) - psi(F.col("n_y") + 1)
    of_group = found.groupBy(*keys).agg((F.sum(value * F.col("m")) / F.sum("m")).alias("__v"), F.sum("m").alias("__n"), F.count_if(F.col("radius").isNull()).alias("__short"))
    total = psi(F.lit(k)) + F.col("__v") + (F.lit(0.0) if z else psi(F.col("__n")))
    checked = F.when(F.col("__short") > 0, F.raise_error(F.lit(f"points are too few for k={k} and a Theiler window of {theiler}"))).otherwise(total)
    return of_group.select(*keys, checked.cast("double").alias(name))


#: Points of a group up to which comparing all of them in one task costs less than dealing them to cells.
SMALL_GROUP = 4_096


def _noisy(points: DataFrame, columns: Sequence[str], noise: float, seed: int) -> DataFrame:
    """Normal noise that follows from the seed, the row and the column, to part ties."""
    own = points
    for j, c in enumerate(columns):
        u = [(F.pmod(F.xxhash64("rid", F.lit(seed), F.lit(2 * j + b)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1)) for b in (0, 1)]
        own = own.withColumn(c, F.col(c) + noise * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1]))
    return own


def ksg_by_group(points: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), name: str = "mi", *, small_group: int = SMALL_GROUP, noise: float = 0.0, seed: int = 0, normalise: bool = False, **options) -> DataFrame:
    """One estimate per group of ``keys``: by comparing all of a group's points in a task up to ``small_group`` of them, by cells beyond; the values are the same.

    Algorithm 2 and the Euclidean norm are by comparing all points at any size.
    """
    columns = list(dict.fromkeys([*x, *y, *z]))
    own = points.select(*keys, "rid", *(F.col(c).cast("double").alias(c) for c in columns))
    for c in columns if normalise else ():
        own = standardise(own, keys, c, ddof=0)
    own = kept(_noisy(own, columns, noise, seed) if noise else own, "points")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in points.schema.fields if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        value = ksg(pdf[list(x)].to_numpy(), pdf[list(y)].to_numpy(), pdf[list(z)].to_numpy() if z else None, **options)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, name: [value]})

    def by_kernel(some: DataFrame) -> DataFrame:
        return some.groupBy(*keys).applyInPandas(run, f"{kinds}{name} double")

    if options.get("algorithm", 1) != 1 or options.get("metric", "chebyshev") != "chebyshev":
        return by_kernel(own)
    sizes = own.groupBy(*keys).agg(F.count("*").alias("__n"))
    least, most = sizes.agg(F.min("__n"), F.max("__n")).first()
    if (most or 0) <= small_group:
        return by_kernel(own)
    few = {c: v for c, v in options.items() if c in ("k", "theiler")}
    if least > small_group:
        return ksg_by_cells(own, keys, x, y, z, name, **few)
    sized = beside(own, sizes, keys)
    return by_kernel(sized.where(F.col("__n") <= small_group).drop("__n")).unionByName(ksg_by_cells(sized.where(F.col("__n") > small_group).drop("__n"), keys, x, y, z, name, **few))


def ais_by_process(series: DataFrame, past: int, **options) -> DataFrame:
    """proc, ais: I(last ``past`` values; current value) of each process of a series (proc, repl, sample, value)."""
    embedded, lags = series.select("proc", "repl", "sample", F.col("value").alias("y")), []
    for lag in range(1, past + 1):
        lags.append(f"h{lag}")
        earlier = series.select("proc", "repl", (F.col("sample") + lag).alias("sample"), F.col("value").alias(lags[-1]))
        embedded = embedded.join(earlier, ["proc", "repl", "sample"])
    points = embedded.withColumn("rid", F.col("repl").cast("long") * (1 << 32) + F.col("sample"))
    return ksg_by_group(points, ["proc"], lags, ["y"], name="ais", **options)
