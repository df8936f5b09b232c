"""Partial information decomposition of discrete variables, in bits.

Probabilities come from grouped counts; what is solved per target is a table of
joint symbols, so the solvers run on small arrays.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache
from itertools import chain, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.discrete import pmf
from tidewire.operators.embedding import column, lag_embed
from tidewire.operators.permutation import Surrogates, permuted
from tidewire.operators.significance import check_n_perm, p_value

Antichain = tuple[tuple[int, ...], ...]


def _log2(a: np.ndarray) -> np.ndarray:
    return np.log2(np.where(a > 0, a, 1))


def _information(joint: np.ndarray) -> float:
    """Mutual information of the two axes of a table."""
    a, b = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
    return float((joint * (_log2(joint) - _log2(a * b))).sum())


def _conditional(q: np.ndarray) -> float:
    """I(T; S1 | S2) of q[t, s1, s2]."""
    z, xz, yz = q.sum(axis=(0, 1), keepdims=True), q.sum(axis=1, keepdims=True), q.sum(axis=0, keepdims=True)
    return float((q * (_log2(q) + _log2(z) - _log2(xz) - _log2(yz))).sum())


def closest_to_unique(p: np.ndarray, sweeps: int = 300, tolerance: float = 1e-12) -> np.ndarray:
    """The table with the (t, s1) and (t, s2) margins of p[t, s1, s2] that has the least I(T; S1 | S2).

    Tables of these margins differ by exchanges of mass around rectangles of (s1, s2)
    at one t.  With (t, s2) fixed, the least information is the largest H(T | S1, S2),
    which is concave along every exchange; each is taken to its best point by halving
    on the slope, in turn, until a sweep gains nothing.
    """
    a, b, t = p.sum(axis=2), p.sum(axis=1), p.sum(axis=(1, 2))
    q = a[:, :, None] * b[:, None, :] / np.where(t > 0, t, 1)[:, None, None]
    moves = [(k, i, j, x, y) for k in range(len(p)) for i, j in combinations(np.flatnonzero(a[k]), 2) for x, y in combinations(np.flatnonzero(b[k]), 2)]
    sums = q.sum(axis=0)

    def slope(k: int, i: int, j: int, x: int, y: int, e: float) -> float:
        grow = ((q[k, i, x] + e) / (sums[i, x] + e), (q[k, j, y] + e) / (sums[j, y] + e))
        shrink = ((q[k, i, y] - e) / (sums[i, y] - e), (q[k, j, x] - e) / (sums[j, x] - e))
        return math.log(shrink[0]) + math.log(shrink[1]) - math.log(grow[0]) - math.log(grow[1])

    before = _conditional(q)
    for _ in range(sweeps):
        for k, i, j, x, y in moves:
            low, high = -min(q[k, i, x], q[k, j, y]), min(q[k, i, y], q[k, j, x])
            if high - low < 1e-15:
                continue
            for _ in range(50):
                e = (low + high) / 2
                if not low < e < high:
                    break
                if slope(k, i, j, x, y, e) > 0:
                    low = e
                else:
                    high = e
            e = (low + high) / 2
            for u, v, sign in ((i, x, e), (j, y, e), (i, y, -e), (j, x, -e)):
                q[k, u, v] = max(0.0, q[k, u, v] + sign)
                sums[u, v] = q[:, u, v].sum()
        now = _conditional(q)
        if before - now < tolerance:
            break
        before = now
    return q


def duality_gap(p: np.ndarray, q: np.ndarray, rounds: int = 50) -> float:
    """By how much the information of q[t, s1, s2] can exceed the least that p's margins allow, at most.

    For any numbers a[t, s1] and b[t, s2] with sum over t of 2**(a + b) <= 1 at every
    (s1, s2), the mean of a + b over p is a lower bound of -H(T | S1, S2).  They are taken
    from the conditional probabilities of q, which add up so at the best table, and moved
    by s1 and s2 alone until the sums fit.
    """
    sums = q.sum(axis=0)
    rest = _log2(q) - _log2(sums)
    n, m = sums.shape
    a, b = np.zeros((len(q), n)), np.zeros((len(q), m))
    rows, columns = np.indices((n, m))
    for t in range(len(q)):
        weight = np.sqrt(q[t]).ravel()
        design = np.zeros((n * m, n + m))
        design[np.arange(n * m), rows.ravel()] = weight
        design[np.arange(n * m), n + columns.ravel()] = weight
        found = np.linalg.lstsq(design, weight * rest[t].ravel(), rcond=None)[0]
        a[t], b[t] = found[:n], found[n:]
    own, other = p.sum(axis=2), p.sum(axis=1)
    here, there = own > 0, other > 0  # elsewhere no table has mass
    total = np.where(here[:, :, None] & there[:, None, :], 2.0 ** (a[:, :, None] + b[:, None, :]), 0).sum(axis=0)
    z = np.where(total > 0, _log2(total), -np.inf)
    move, also = np.zeros(n), np.zeros(m)
    for _ in range(rounds):
        top = (z + also[None, :]).max(axis=1)
        move = np.where(np.isfinite(top), -top, 0)
        top = (z + move[:, None]).max(axis=0)
        also = np.where(np.isfinite(top), -top, 0)
    bound = float((own * (a + move)).sum() + (other * (b + also)).sum())
    return max(0.0, float((q * rest).sum()) - bound)


def two_source(p: np.ndarray) -> dict[str, float]:
    """Unique, shared and synergistic information of p[t, s1, s2]; ``gap`` bounds the error of each."""
    q = closest_to_unique(p)
    unique1, unique2 = max(0.0, _conditional(q)), max(0.0, _conditional(q.transpose(0, 2, 1)))
    total, in_q = _information(p.reshape(len(p), -1)), _information(q.reshape(len(q), -1))
    return {"unq_s1": unique1, "unq_s2": unique2, "shd_s1_s2": _information(p.sum(axis=2)) - unique1, "syn_s1_s2": max(0.0, total - in_q), "num_err": float(max(np.abs(q.sum(axis=2) - p.sum(axis=2)).max(), np.abs(q.sum(axis=1) - p.sum(axis=1)).max())), "gap": duality_gap(p, q)}


@cache
def lattice(n: int) -> tuple[tuple[Antichain, ...], tuple[tuple[int, ...], ...]]:
    """The antichains of non-empty sets of n sources, and those below each.

    One antichain is below another if every set of the latter holds a set of the former.
    """
    if n not in (2, 3, 4):
        raise RuntimeError("there are 2 to 4 sources")
    sets = list(chain.from_iterable(combinations(range(1, n + 1), k) for k in range(1, n + 1)))
    inside = {(a, b) for a in sets for b in sets if set(a) <= set(b)}
    found: list[Antichain] = [()]
    for s in sets:
        found += [(*chosen, s) for chosen in found if not any((c, s) in inside or (s, c) in inside for c in chosen)]
    nodes = sorted(found[1:], key=lambda a: (len(a), a))
    below = tuple(tuple(k for k, b in enumerate(nodes) if b != a and all(any((y, x) in inside for y in b) for x in a)) for a in nodes)
    return tuple(nodes), below


def shared_exclusions(symbols: np.ndarray, p: np.ndarray) -> tuple[tuple[Antichain, ...], np.ndarray, np.ndarray]:
    """Pointwise informative and misinformative atoms: rows of ``symbols`` are (s1, ..., sn, t) with probability p."""
    n = symbols.shape[1] - 1
    nodes, below = lattice(n)
    same = symbols[:, None, :] == symbols[None, :, :]
    agree = {s: same[:, :, [i - 1 for i in s]].all(axis=2) for a in nodes for s in a}
    plus, minus = np.empty((len(p), len(nodes))), np.empty((len(p), len(nodes)))
    target = (same[:, :, n] * p).sum(axis=1)
    for k, a in enumerate(nodes):
        any_set = np.any([agree[s] for s in a], axis=0)
        plus[:, k] = -np.log2((any_set * p).sum(axis=1))
        minus[:, k] = -np.log2((any_set & same[:, :, n]) @ p / target)
    for k in sorted(range(len(nodes)), key=lambda k: len(below[k])):
        for j in below[k]:
            plus[:, k] -= plus[:, j]
            minus[:, k] -= minus[:, j]
    return nodes, plus, minus


def sources_frame(series: DataFrame, target: int, sources: Sequence[int], lags: Sequence[int] | None = None) -> DataFrame:
    """s1, s2, ..., t: the sources at their lags (1 unless given) and the target now."""
    lags = list(lags) if lags is not None else [1] * len(sources)
    if len(lags) != len(sources):
        raise RuntimeError("there is one lag for each source")
    if target in sources:
        raise RuntimeError("the target is among the sources")
    most = max([*lags, 0])
    wide = lag_embed(series, [(target, 0), *zip(sources, lags, strict=True)], most)
    return wide.select(*(F.col(column((p, lag))).cast("int").alias(f"s{k + 1}") for k, (p, lag) in enumerate(zip(sources, lags, strict=True))), F.col(column((target, 0))).cast("int").alias("t"))


_TWO = "unq_s1 double, unq_s2 double, shd_s1_s2 double, syn_s1_s2 double, num_err double, gap double"


def decompose_two(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The two-source decomposition of the rows (s1, s2, t) of each group of ``keys``."""
    table = pmf(rows, ["s1", "s2", "t"], keys)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = [np.unique(pdf[c], return_inverse=True)[1] for c in ("t", "s1", "s2")]
        p = np.zeros([c.max() + 1 for c in codes])
        p[tuple(codes)] = pdf["p"]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in keys}, **two_source(p)}])

    own = table.withColumn("__one", F.lit(0)).groupBy(*keys or ["__one"])
    return own.applyInPandas(solve, kinds + _TWO)


def decompose(rows: DataFrame, n_sources: int, keys: Sequence[str] = (), pointwise: bool = False) -> DataFrame:
    """keys, (symbols,) alpha, pi_plus, pi_minus, pi of the shared-exclusions decomposition."""
    names = [f"s{k + 1}" for k in range(n_sources)]
    table = pmf(rows, [*names, "t"], keys)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keys)
    schema = kinds + ("symbols array<int>, " if pointwise else "") + "alpha string, pi_plus double, pi_minus double, pi double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, p = pdf[[*names, "t"]].to_numpy(), pdf["p"].to_numpy()
        nodes, plus, minus = shared_exclusions(symbols, p)
        label = ["".join("{" + "".join(map(str, s)) + "}" for s in a) for a in nodes]
        own = {c: pdf[c].iloc[0] for c in keys}
        if pointwise:
            return pd.DataFrame([{**own, "symbols": [int(v) for v in s], "alpha": label[k], "pi_plus": plus[r, k], "pi_minus": minus[r, k], "pi": plus[r, k] - minus[r, k]} for r, s in enumerate(symbols) for k in range(len(nodes))])
        return pd.DataFrame([{**own, "alpha": label[k], "pi_plus": p @ plus[:, k], "pi_minus": p @ minus[:, k], "pi": p @ (plus[:, k] - minus[:, k])} for k in range(len(nodes))])

    return table.withColumn("__one", F.lit(0)).groupBy(*keys or ["__one"]).applyInPandas(solve, schema)


def shared_exclusions_two(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The averages for two sources without Python: windows over the table of joint symbols."""
    table = pmf(rows, ["s1", "s2", "t"], keys)

    def margin(*columns: str):
        return F.sum("p").over(Window.partitionBy(*keys, *columns))

    either, either_t = margin("s1") + margin("s2") - margin("s1", "s2"), margin("s1", "t") + margin("s2", "t") - F.col("p")
    t = margin("t")
    plus = {"{1}{2}": -F.log2(either), "{1}": -F.log2(margin("s1")), "{2}": -F.log2(margin("s2")), "{12}": -F.log2(margin("s1", "s2"))}
    minus = {"{1}{2}": -F.log2(either_t / t), "{1}": -F.log2(margin("s1", "t") / t), "{2}": -F.log2(margin("s2", "t") / t), "{12}": -F.log2(F.col("p") / t)}
    wide = table.select(*keys, "p", *(v.alias(f"{sign}{k}") for sign, vs in (("+", plus), ("-", minus)) for k, v in vs.items()))
    atoms = []
    for sign in "+-":
        c = {k: F.col(f"`{sign}{k}`") for k in plus}
        atoms.append({"{1}{2}": c["{1}{2}"], "{1}": c["{1}"] - c["{1}{2}"], "{2}": c["{2}"] - c["{1}{2}"], "{12}": c["{12}"] - c["{1}"] - c["{2}"] + c["{1}{2}"]})
    each = F.array(*(F.struct(F.lit(k).alias("alpha"), atoms[0][k].alias("a"), atoms[1][k].alias("b")) for k in plus))
    return wide.select(*keys, "p", F.explode(each).alias("e")).groupBy(*keys, F.col("e.alpha").alias("alpha")).agg(F.sum(F.col("p") * F.col("e.a")).alias("pi_plus"), F.sum(F.col("p") * F.col("e.b")).alias("pi_minus"), F.sum(F.col("p") * (F.col("e.a") - F.col("e.b"))).alias("pi"))


def analyse_network(series: DataFrame, targets: Sequence[int], sources: Sequence[Sequence[int]], lags: Sequence[Sequence[int]] | None = None, method: str = "two_source") -> DataFrame:
    """The decomposition of each target with its sources (and lags), in one frame keyed by target.

    ``method`` is two_source (exactly two sources) or shared_exclusions (two to four).
    """
    if len(targets) != len(sources) or (lags is not None and len(lags) != len(targets)):
        raise RuntimeError("there is one list of sources (and of lags) for each target")
    if method not in ("two_source", "shared_exclusions"):
        raise RuntimeError(f"unknown method {method!r}")
    out = None
    for k, (target, own) in enumerate(zip(targets, sources, strict=True)):
        if method == "two_source" and len(own) != 2:
            raise RuntimeError("a two-source decomposition has two sources")
        rows = sources_frame(series, target, own, lags[k] if lags is not None else None)
        found = decompose_two(rows) if method == "two_source" else decompose(rows, len(own))
        found = found.select(F.lit(target).alias("target"), F.lit(",".join(map(str, own))).alias("sources"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def against_surrogates(series: DataFrame, target: int, sources: Sequence[int], n_perm: int = 500, alpha: float = 0.05, seed: int = 1, lags: Sequence[int] | None = None) -> DataFrame:
    """atom, value, pval, significant: unique terms against permuted sources of their own, shared and synergistic ones against a permuted target.

    All permutations are decomposed in one grouped job.
    """
    check_n_perm(n_perm, alpha)
    most = max([*(lags or [1] * len(sources)), 0])
    embedding = [(target, 0), *zip(sources, lags or [1] * len(sources), strict=True)]
    names = dict(zip(map(column, embedding), ("t", "s1", "s2"), strict=True))
    wide = lag_embed(series, embedding, most)
    rows = wide.select("repl", "sample", *(F.col(c).cast("int").alias(n) for c, n in names.items())).cache()
    n = rows.agg(F.max("sample")).first()[0] - most + 1
    observed = decompose_two(rows.drop("repl", "sample")).select("unq_s1", "unq_s2", "shd_s1_s2", "syn_s1_s2")
    draws = Surrogates(n, n_perm, seed, offset=most)
    tables = None
    for under, atoms in (("s1", ["unq_s1"]), ("s2", ["unq_s2"]), ("t", ["shd_s1_s2", "syn_s1_s2"])):
        moved = permuted(rows, [under], draws).select("perm", "s1", "s2", "t")
        each = F.array(*(F.struct(F.lit(a).alias("atom"), F.col(a).alias("s")) for a in atoms))
        part = decompose_two(moved, ["perm"]).select("perm", F.explode(each).alias("e")).select("perm", "e.*")
        tables = part if tables is None else tables.unionByName(part)
    each = F.array(*(F.struct(F.lit(a).alias("atom"), F.col(a).alias("value")) for a in observed.columns))
    met = tables.join(observed.select(F.explode(each).alias("e")).select("e.*"), "atom")
    tested = met.groupBy("atom", "value").agg(p_value(F.col("value"), F.col("s")).alias("pval"))
    return tested.withColumn("significant", F.col("pval") < alpha)
