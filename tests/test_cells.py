import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import cells, knn

KIND = "g int, rid long, x double, y double, z double"


def rows(n, kind, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 1] += 0.5 * x[:, 0]
    if kind == "ties":
        x = np.round(x * 3) / 3
    if kind == "hot":  # a third are one point, and more share a coordinate
        x[: n // 3] = x[0]
        x[n // 3 : n // 2, 0] = 0.25
    if kind == "zeros":
        x[::2, 0] = 0.0
        x[1::4, 0] = -0.0
        x[::3, 1:] = 0.0
    return x


@pytest.mark.parametrize(("kind", "theiler"), [("hot", 0), ("ties", 3), ("zeros", 0)])
def test_equals_comparing_all_pairs(spark, kind, theiler):
    data = {g: rows(n, kind, g) for g, n in ((0, 40), (1, 400))}
    df = spark.createDataFrame([(g, i, *map(float, r)) for g, x in data.items() for i, r in enumerate(x)], KIND)
    found = knn.neighbour_counts(df, ["g"], {"xz": ["x", "z"], "yz": ["y", "z"], "z": ["z"]}, 4, theiler, cell_rows=32)
    got = {(r["g"], r["rid"]): (r["radius"], r["n_xz"], r["n_yz"], r["n_z"]) for r in found.collect()}
    want = {}
    for g, x in data.items():
        radius, counts, _ = knn.neighbours(x[:, [0, 2, 1]], 4, [x[:, [0, 2]], x[:, [1, 2]], x[:, [2]]], theiler=theiler)
        want |= {(g, i): (radius[i], *(c[i] for c in counts)) for i in range(len(x))}
    assert got == want


@pytest.mark.parametrize("z", [[], ["z"]])
def test_estimates_are_the_same_by_cells_and_by_comparing_all(spark, z):
    data = {g: rows(n, "ties", g) for g, n in ((0, 250), (1, 60))}
    df = spark.createDataFrame([(g, i, *map(float, r)) for g, x in data.items() for i, r in enumerate(x)], KIND)
    want = {g: knn.ksg(x[:, 0], x[:, 1], x[:, 2] if z else None, k=3) for g, x in data.items()}
    for small in (0, 100):
        got = {r["g"]: r["mi"] for r in knn.ksg_by_group(df, ["g"], ["x"], ["y"], z, k=3, small_group=small).collect()}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_noise_and_normalising_do_not_hang_on_the_path(spark):
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows(200, "ties"))], KIND)
    own = [knn.ksg_by_group(df, ["g"], ["x"], ["y"], k=3, small_group=small, noise=1e-3, seed=5, normalise=True).first()["mi"] for small in (0, 1_000)]
    assert abs(own[0] - own[1]) < 1e-9


def test_points_too_few(spark):
    df = spark.createDataFrame([(0, i, float(i), float(i), 0.0) for i in range(4)], KIND)
    found = knn.neighbour_counts(df, ["g"], {"x": ["x"], "y": ["y"]}, 4).collect()
    assert len(found) == 4 and all(r["radius"] is None and r["n_x"] == r["n_y"] == 0 for r in found)
    with pytest.raises(Exception, match="too few"):
        knn.ksg_by_cells(df, ["g"], ["x"], ["y"], k=4).collect()
    assert knn.neighbour_counts(df.limit(0), ["g"], {"x": ["x"], "y": ["y"]}, 4).count() == 0


def test_cells_have_about_equal_counts_whatever_is_tied(spark):
    for kind in ("hot", "zeros"):
        x = rows(4_000, kind)
        df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], KIND)
        space = cells.make_space(df.groupBy("g", "x", "y", "z").agg(F.count("*").alias("m")), ["g"], ["x", "y", "z"], 100)
        sizes = [r["count"] for r in space.data.groupBy("cell").count().collect()]
        distinct = len(np.unique(x + 0.0, axis=0))
        assert sum(sizes) == distinct and max(sizes) <= 200 and len(sizes) <= 12 * max(1, distinct // 100)
        _, low, high, count = space.boxes[0,]
        assert count.sum() == 4_000 and (low <= high).all()


@pytest.mark.parametrize("seed", range(25))
def test_edges_on_a_line(seed):
    """Ranges that end on points, in numbers whose sums round."""
    rng = np.random.default_rng(seed)
    p = np.unique(np.round(rng.normal(size=80), int(rng.integers(1, 4))) * rng.choice([1.0, 0.1, 1e6]))
    cuts = np.unique([0, *rng.integers(0, len(p), 9), len(p)])
    parts = [p[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    box = (np.arange(len(parts)), np.array([[q[0]] for q in parts]), np.array([[q[-1]] for q in parts]), np.array([len(q) for q in parts]))
    x = rng.choice(p, 200)
    r = np.abs(x - rng.choice(p, 200))
    inside, q, cell = cells.edge_cells(box, x[:, None], r)
    for i in range(200):
        asked = cell[q == i].tolist()
        assert len(asked) == len(set(asked)) <= 2
        assert inside[i] + sum((np.abs(x[i] - parts[c]) < r[i]).sum() for c in asked) == (np.abs(x[i] - p) < r[i]).sum()


def test_counts_on_a_line_equal_comparing_all(spark, monkeypatch):
    """Several cells on a line, each asked by search, in copies."""
    monkeypatch.setattr(cells, "LINE_ASKED", 300)
    monkeypatch.setattr(cells, "LINE_PLANNED", 500)
    rng = np.random.default_rng(4)
    p = np.unique(np.round(rng.normal(size=3_000), 3)) * 0.1
    m = rng.integers(1, 5, len(p))
    x = rng.choice(p, 2_000)
    r = np.where(np.arange(2_000) % 9 == 0, 0.0, np.abs(x - rng.choice(p, 2_000)))
    points = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(p, m, strict=True)], "g int, x double, m long")
    queries = spark.createDataFrame([(0, i, float(a), float(b), 0) for i, (a, b) in enumerate(zip(x, r, strict=True))], "g int, qid long, x double, r double, home int")
    space = cells.make_space(points, ["g"], ["x"], 100)
    assert len(space.boxes[0,][0]) > 5
    got = {q["qid"]: q["n"] for q in cells.range_counts(space, queries, "home").collect()}
    assert got == {i: int((np.abs(x[i] - p) < r[i]) @ m) for i in range(2_000)}


def test_a_cell_on_a_line_is_searched(monkeypatch):
    """Ranges that end on points, rounded sums and what isn't finite; no matrix of all distances."""
    monkeypatch.setattr(cells, "distances", None)
    rng = np.random.default_rng(7)
    for scale in (1.0, 0.1, 1e6):
        p = np.append(np.unique(np.round(rng.normal(size=500), 2)) * scale, [np.inf, -np.inf])
        x = np.append(rng.choice(p, 2_000), [np.inf, 0.0, 0.5])
        with np.errstate(invalid="ignore"):
            r = np.abs(x - rng.choice(p, len(x)))
            m = rng.integers(1, 9, len(p))
            want = [int((np.abs(a - p) < b) @ m) for a, b in zip(x, r, strict=True)]
            assert cells.closer_on_line(x, r, p, m).tolist() == want


def test_cells_on_a_line_grow_few(spark):
    """Cells of a line hold many points: what is planned and asked doesn't come in as many groups as the joint space has cells."""
    df = spark.createDataFrame([(0, i, float(i), float(i * 7919 % 20_011), 0.0) for i in range(20_000)], KIND)
    seen, make = [], cells.make_space

    def spy(*args):
        seen.append(make(*args))
        return seen[-1]

    cells.make_space = spy
    try:
        found = knn.neighbour_counts(df, ["g"], {"x": ["x"], "y": ["y"]}, 4, cell_rows=64)
    finally:
        cells.make_space = make
    many = [sum(len(b[0]) for b in s.boxes.values()) for s in seen]
    assert many[0] > 200 and max(many[1:]) < 10
    assert found.count() == 20_000
