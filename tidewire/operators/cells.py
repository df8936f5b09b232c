"""Nearest neighbours and range counts over cells of about equal counts.

The distinct points of a group are cut into cells by nested quantiles, one coordinate
after the other, until no cell has much more than ``CELL_ROWS`` of them; a point that
many rows share is one point with a weight, so no value is too frequent to be cut out.
A cell's box is the extent of its points.

The k-th neighbour is bounded by the points of the own cell; only cells whose box the
bound reaches are asked further (a ring around the point, most often nothing).  A
range count takes the whole count of every cell whose box lies inside the range, and
asks the cells that its edge cuts; on a line these are the two ends, and what lies
between comes from prefix sums of the cells' counts.  A cell on a line is searched and
not compared, so it may be large, and its questions many.  A cell that is asked very often
is copied, so that its questions are spread over tasks.  Work grows with the number of
points times the cells' size, never with the square of a group, and one group spreads
over as many tasks as it has cells.

Boxes of groups with more than one cell go to every task; there are about
``MOST_CELLS`` at most, as cells get larger beyond.  Where ranges end exactly on points
(the k-th neighbour does so in one coordinate), comparisons are of the same rounded
differences that comparing all pairs would use, so results are equal to it, ties
included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.sources.shared import kept

#: Points of a cell, about; cells of all groups, about, at most; parts in a cut; rounds of cuts.
CELL_ROWS, MOST_CELLS, PARTS, MOST_CUTS = 512, 1 << 17, 64, 9
#: Questions to a copy of a cell; distances that a task holds at once; cuts up to which they are broadcast.
ASKED, AT_ONCE, FEW_CUTS = 8_192, 1 << 20, 20_000
#: On a line: how much larger cells are, questions to a copy of a cell, queries that a task plans together, about.
LINE, LINE_ASKED, LINE_PLANNED = 64, 1 << 17, 1 << 16

Box = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # cells, lowest and highest coordinates, counts


@dataclass(frozen=True)
class Space:
    """keys, cell, coordinates, m (and what else the points had) as a table, and the boxes of groups of several cells."""

    data: DataFrame
    keys: tuple[str, ...]
    coords: tuple[str, ...]
    boxes: dict[tuple, Box]


def _cut(rows: DataFrame, keys: Sequence[str], coord: str, left: int, each: int) -> DataFrame | None:
    """One more cut of the cells that have over ``each`` points; None if there is none."""
    shares = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    sketch = rows.groupBy(*keys, "cell").agg(F.count("*").alias("__n"), F.percentile_approx(coord, shares, F.lit(10_000)).alias("__all")).where(F.col("__n") > each)
    parts = F.least(F.lit(PARTS), F.ceil(F.pow(F.col("__n") / each, F.lit(1.0 / left))).cast("int"))
    # of the cuts at 1/64, 2/64, ... those nearest to 1/parts, 2/parts, ...
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("__all", F.floor(i * PARTS / parts).cast("int"))))
    found = sketch.select(*keys, "cell", cuts.alias("__cuts")).cache()
    many = found.count()
    if not many:
        return None
    met = rows.join(F.broadcast(found) if many <= FEW_CUTS else found, [*keys, "cell"], "left")
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(coord))), F.lit(0))
    return met.withColumn("cell", F.col("cell") * PARTS + F.when(F.col("__cuts").isNull(), 0).otherwise(below)).drop("__cuts")


def make_space(points: DataFrame, keys: Sequence[str], coords: Sequence[str], cell_rows: int = CELL_ROWS) -> Space:
    """Cells over points that are distinct in (keys, coords), with the weight m."""
    rows = kept(points.withColumn("cell", F.lit(0).cast("long")), "points")
    each = max(cell_rows, rows.count() // MOST_CELLS)
    for turn in range(MOST_CUTS):
        more = _cut(rows, keys, coords[turn % len(coords)], len(coords) - turn % len(coords), each)
        if more is None:
            break
        rows = kept(more, "cells")
    ends = [f(c).alias(f"{n}{i}") for i, c in enumerate(coords) for n, f in (("low", F.min), ("high", F.max))]
    each_cell = rows.groupBy(*keys, "cell").agg(*ends, F.sum("m").alias("m"))
    several = rows.where("cell > 0")  # a group's only cell is cell 0
    if keys:
        each_cell = each_cell.join(several.select(*keys).distinct(), list(keys), "left_semi")
    found = each_cell.collect() if not several.isEmpty() else []
    grouped: dict[tuple, list] = {}
    for r in found:
        grouped.setdefault(tuple(r[c] for c in keys), []).append(r)
    boxes = {}
    for key, own in grouped.items():
        low, high = (np.array([[r[f"{n}{i}"] for i in range(len(coords))] for r in own]) for n in ("low", "high"))
        order = np.lexsort((low[:, 0],))
        boxes[key] = (np.array([r["cell"] for r in own])[order], low[order], high[order], np.array([r["m"] for r in own])[order])
    return Space(rows, tuple(keys), tuple(coords), boxes)


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maximum-norm distance of points to the nearest of a box (0 inside): points x boxes."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        np.maximum(out, np.maximum(low[None, :, j] - x[:, None, j], x[:, None, j] - high[None, :, j]), out=out)
    return out


def _reach(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maximum-norm distance to the farthest corner of a box."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        np.maximum(out, np.maximum(np.abs(x[:, None, j] - low[None, :, j]), np.abs(x[:, None, j] - high[None, :, j])), out=out)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.abs(a[:, None, 0] - b[None, :, 0])
    for j in range(1, a.shape[1]):
        np.maximum(out, np.abs(a[:, None, j] - b[None, :, j]), out=out)
    return out


def _nearby(box: Box, low: np.ndarray, high: np.ndarray, radius: float) -> np.ndarray:
    """Boxes that come within a radius of a box."""
    _, lows, highs, _ = box
    apart = np.maximum(lows - high[None, :], low[None, :] - highs).max(axis=1)
    return np.flatnonzero(apart <= radius)


def nearest_in(x: np.ndarray, points: np.ndarray, weights: np.ndarray, need: int, below: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per row of x: distances and weights of the nearest points, as many as together weigh ``need``, and the last distance (inf if they don't)."""
    near, many, bound = [], [], np.full(len(x), np.inf)
    step = max(1, AT_ONCE // max(1, len(points)))
    few = min(need, len(points))
    for at in range(0, len(x), step):
        d = distances(x[at : at + step], points)
        first = np.argpartition(d, few - 1, axis=1)[:, :few] if few < len(points) else np.tile(np.arange(len(points)), (len(d), 1))
        own = np.take_along_axis(d, first, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        own, w = np.take_along_axis(own, order, axis=1), weights[np.take_along_axis(first, order, axis=1)]
        total = np.cumsum(w, axis=1)
        ends = (total < need).sum(axis=1)  # the first place at which enough is together
        for i in range(len(d)):
            end = min(ends[i] + 1, few)
            if below is not None:
                end = min(end, int(np.searchsorted(own[i], below[at + i], side="left")))
            near.append(own[i, :end])
            many.append(w[i, :end])
            if ends[i] < few:
                bound[at + i] = own[i, ends[i]]
    return near, many, bound


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _matrix(table: pa.Table, coords: Sequence[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in coords], axis=1)


def _repeated(table: pa.Table, keys: Sequence[str], n: int) -> list[pa.Array]:
    """The group's keys for n rows."""
    return [pa.repeat(table[c][0], n).cast(table.schema.field(c).type) for c in keys]


def _searching(space: Space, need: int) -> Callable:
    keys, coords, boxes = space.keys, space.coords, space.boxes

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        x, home = _matrix(table, coords), table["cell"][0].as_py()
        near, many, bound = nearest_in(x, x, table["m"].to_numpy(), need)
        names = [*keys, "cell", "qid", *coords, "bound", "near", "many"]
        own = [*_repeated(table, keys, len(x)), pa.nulls(len(x), pa.int64()), table["qid"], *(table[c] for c in coords), pa.array(bound), _lists(near, pa.float64()), _lists(many, pa.int64())]
        yield from pa.table(own, names).combine_chunks().to_batches()
        box = boxes.get(tuple(table[c][0].as_py() for c in keys))
        if box is None:
            return
        cells, lows, highs, _ = box
        which = _nearby(box, x.min(axis=0), x.max(axis=0), float(bound.max()))
        which = which[cells[which] != home]
        step = max(1, AT_ONCE // max(1, len(which)))
        for at in range(0, len(x), step):
            q, c = np.nonzero(_gap(x[at : at + step], lows[which], highs[which]) < bound[at : at + step, None])
            if len(q):
                q += at
                asked = table.take(pa.array(q))
                rows = [*_repeated(table, keys, len(q)), pa.array(cells[which[c]]), asked["qid"], *(asked[k] for k in coords), pa.array(bound[q]), pa.nulls(len(q), pa.list_(pa.float64())), pa.nulls(len(q), pa.list_(pa.int64()))]
                yield from pa.table(rows, names).combine_chunks().to_batches()

    return search


def _answering(space: Space, need: int) -> Callable:
    keys, coords = space.keys, space.coords

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        is_point = pa.compute.is_null(table["qid"])
        points, asked = table.filter(is_point), table.filter(pa.compute.invert(is_point))
        if not asked.num_rows:
            return
        near, many, _ = nearest_in(_matrix(asked, coords), _matrix(points, coords), points["m"].to_numpy(), need, asked["bound"].to_numpy())
        rows = [*_repeated(table, keys, len(near)), asked["qid"], _lists(near, pa.float64()), _lists(many, pa.int64())]
        yield from pa.table(rows, [*keys, "qid", "near", "many"]).combine_chunks().to_batches()

    return answer


def _met(space: Space, asks: DataFrame, kernel: Callable, schema: StructType | str) -> DataFrame:
    """Questions with the points of the cell that they are asked; cells that are asked often in copies."""
    by = [*space.keys, "cell"]
    copies = asks.groupBy(*by).agg(F.ceil(F.count("*") / (LINE_ASKED if len(space.coords) == 1 else ASKED)).cast("int").alias("copies"))
    points = space.data.select(*by, *space.coords, "m").join(copies, by).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = asks.join(copies, by).withColumn("copy", F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int")).drop("copies")
    return dealt.unionByName(points, allowMissingColumns=True).groupBy(*by, "copy").applyInArrow(kernel, schema)


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in columns)


def nearest(space: Space, need: int) -> DataFrame:
    """keys, qid, near: (distance, weight) of each point's nearest, itself among them, until they weigh ``need`` together.

    The table of the space has a column qid that numbers the points.
    """
    own = _kinds(space.data, space.keys)
    places = "".join(f"{c} double, " for c in space.coords)
    found = kept(space.data.groupBy(*space.keys, "cell").applyInArrow(_searching(space, need), f"{own}cell long, qid long, {places}bound double, near array<double>, many array<long>"), "near")
    asks = found.where("cell is not null").drop("near", "many")
    answers = _met(space, asks, _answering(space, need), f"{own}qid long, near array<double>, many array<long>")
    both = found.where("cell is null").select(*space.keys, "qid", "near", "many").unionByName(answers)
    lists = both.select(*space.keys, "qid", F.arrays_zip(F.col("near").alias("d"), F.col("many").alias("m")).alias("near"))
    return lists.groupBy(*space.keys, "qid").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))


def kth_distance(near: Column, need: Column | int) -> Column:
    """The distance at which the weights of a sorted list reach ``need``."""
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(None).cast("double").alias("r"))
    need = F.lit(need) if isinstance(need, int) else need
    return F.aggregate(near, start, lambda a, e: F.struct((a["t"] + e["m"]).alias("t"), F.when((a["t"] < need) & (a["t"] + e["m"] >= need), e["d"]).otherwise(a["r"]).alias("r")))["r"]


def edge_cells(box: Box, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the cells inside each range |x - p| < r, and (query, cell) of those that its edge cuts."""
    cells, lows, highs, counts = box
    if x.shape[1] > 1:
        which = _nearby(box, x.min(axis=0), x.max(axis=0), float(r.max(initial=0.0)))
        inside, asked = np.zeros(len(x), dtype=np.int64), []
        step = max(1, AT_ONCE // max(1, len(which)))
        for at in range(0, len(x), step):
            own, limit = x[at : at + step], r[at : at + step, None]
            whole = _reach(own, lows[which], highs[which]) < limit
            inside[at : at + step] = whole @ counts[which]
            q, c = np.nonzero(~whole & (_gap(own, lows[which], highs[which]) < limit))
            asked.append(np.stack([q + at, which[c]], axis=1))
        asked = np.concatenate(asked) if asked else np.zeros((0, 2), dtype=np.int64)
        return inside, asked[:, 0], asked[:, 1]
    x, low, high = x[:, 0], lows[:, 0], highs[:, 0]
    # cells on a line are in order; what the rounding of x - r and x + r misses is a step or two
    first = np.searchsorted(high, x - r, side="right")
    while (back := (first > 0) & (x - high[np.maximum(first - 1, 0)] < r)).any():
        first -= back
    while (on := (first < len(high)) & ~(x - high[np.minimum(first, len(high) - 1)] < r)).any():
        first += on
    last = np.searchsorted(low, x + r, side="left") - 1
    while (on := (last < len(low) - 1) & (low[np.minimum(last + 1, len(low) - 1)] - x < r)).any():
        last += on
    while (back := (last >= 0) & ~(low[np.maximum(last, 0)] - x < r)).any():
        last -= back
    upto = np.concatenate([[0], np.cumsum(counts)])
    some = first <= last
    f, t = np.where(some, first, 0), np.where(some, last, 0)
    cut_f = some & ~((x - low[f] < r) & (high[f] - x < r))
    cut_t = some & (f != t) & ~((x - low[t] < r) & (high[t] - x < r))
    inside = np.where(some, upto[t + 1] - upto[f], 0) - np.where(cut_f, counts[f], 0) - np.where(cut_t, counts[t], 0)
    return inside, np.concatenate([np.flatnonzero(cut_f), np.flatnonzero(cut_t)]), np.concatenate([f[cut_f], t[cut_t]])


def _planning(space: Space) -> Callable:
    keys, coords, boxes = space.keys, space.coords, space.boxes

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        x, r = _matrix(table, coords), table["r"].to_numpy()
        box = boxes.get(tuple(table[c][0].as_py() for c in keys))
        inside, q, cell = (np.zeros(len(x), dtype=np.int64), np.arange(len(x)), np.zeros(len(x), dtype=np.int64)) if box is None else edge_cells(box, x, r)
        if box is not None:
            cell = box[0][cell]
        names = [*keys, "cell", "qid", *coords, "r", "n"]
        own = [*_repeated(table, keys, len(x)), pa.nulls(len(x), pa.int64()), table["qid"], *(table[c] for c in coords), table["r"], pa.array(inside, pa.int64())]
        asked = table.take(pa.array(q))
        rows = [*_repeated(table, keys, len(q)), pa.array(cell, pa.int64()), asked["qid"], *(asked[c] for c in coords), asked["r"], pa.nulls(len(q), pa.int64())]
        for part in (own, rows):
            yield from pa.table(part, names).combine_chunks().to_batches()

    return plan


def closer_on_line(x: np.ndarray, r: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Weight of the points p with |x - p| < r, by search."""
    order = np.argsort(p, kind="stable")
    p, upto = p[order], np.concatenate([[0], np.cumsum(m[order])])
    out, finite = np.zeros(len(x), dtype=np.int64), np.isfinite(x) & np.isfinite(r)
    for k in np.flatnonzero(~finite):
        out[k] = (np.abs(x[k] - p) < r[k]) @ m[order]
    x, r, end = x[finite], r[finite], len(p) - 1
    # what the rounding of x - r and x + r misses is a step or two
    first = np.searchsorted(p, x - r, side="right")
    while (back := (first > 0) & (x - p[np.maximum(first - 1, 0)] < r)).any():
        first -= back
    while (on := (first <= end) & ~(x - p[np.minimum(first, end)] < r)).any():
        first += on
    last = np.searchsorted(p, x + r, side="left")
    while (on := (last <= end) & (p[np.minimum(last, end)] - x < r)).any():
        last += on
    while (back := (last > 0) & ~(p[np.maximum(last - 1, 0)] - x < r)).any():
        last -= back
    out[finite] = upto[np.maximum(last, first)] - upto[first]
    return out


def _counting(space: Space) -> Callable:
    keys, coords = space.keys, space.coords

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        is_point = pa.compute.is_null(table["qid"])
        points, asked = table.filter(is_point), table.filter(pa.compute.invert(is_point))
        x, p, m, r = _matrix(asked, coords), _matrix(points, coords), points["m"].to_numpy(), asked["r"].to_numpy()
        step, n = max(1, AT_ONCE // max(1, len(p))), []
        if len(coords) == 1:
            n.append(closer_on_line(x[:, 0], r, p[:, 0], m))
        for at in range(0, len(x) if len(coords) > 1 else 0, step):
            n.append((distances(x[at : at + step], p) < r[at : at + step, None]) @ m)
        rows = [*_repeated(table, keys, len(x)), asked["qid"], pa.array(np.concatenate(n) if n else np.zeros(0, dtype=np.int64), pa.int64())]
        yield from pa.table(rows, [*keys, "qid", "n"]).combine_chunks().to_batches()

    return count


def range_parts(space: Space, queries: DataFrame, home: str) -> DataFrame:
    """keys, qid, n: parts of the weight of the points closer than r to each query (keys, qid, coordinates, r).

    Queries that share ``home`` are near each other, and few enough for a task; on a line
    they needn't be near.
    """
    own = _kinds(space.data, space.keys)
    places = "".join(f"{c} double, " for c in space.coords)
    near = F.col(home)
    if len(space.coords) == 1:
        near = F.pmod(F.xxhash64("qid"), F.lit(1 + queries.count() // LINE_PLANNED))
    planned = kept(queries.select(*space.keys, near.alias("home"), "qid", *space.coords, "r").groupBy(*space.keys, "home").applyInArrow(_planning(space), f"{own}cell long, qid long, {places}r double, n long"), "ranges")
    answers = _met(space, planned.where("cell is not null").drop("n"), _counting(space), f"{own}qid long, n long")
    return planned.where("cell is null").select(*space.keys, "qid", "n").unionByName(answers)


def range_counts(space: Space, queries: DataFrame, home: str) -> DataFrame:
    """keys, qid, n: weight of the points closer than r to each query (keys, qid, coordinates, r), see ``range_parts``."""
    return range_parts(space, queries, home).groupBy(*space.keys, "qid").agg(F.sum("n").alias("n"))
