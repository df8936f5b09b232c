"""History dependence of spike trains: embeddings, estimators, time scales.

Symbols come from spikes: each spike is dealt to the windows that hold it, bins are
counted, and a window's symbol has a bit for each bin with more spikes than the
bin's median.  Windows without any spike are known by their number.  What estimators
get are counts of symbols, at most 2 ** (d + 1) rows per embedding.  All embeddings of
a grid are counted in one pass over the spikes, and estimators run in one task for
each process and embedding, or each replicate of a bootstrap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import beside, uniform
from tidewire.functions.special import digamma
from tidewire.sources.shared import kept


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x), float, len(x))


@dataclass(frozen=True)
class Embedding:
    """Past range in seconds, number of bins, and exponent of their growth."""

    past_range: float
    bins: int
    scaling: float = 0.0

    @property
    def first_bin(self) -> float:
        """Size of the bin next to the response."""
        return self.past_range / sum(10 ** ((self.bins - i) * self.scaling) for i in range(1, self.bins + 1))

    def delimiters(self, step: float) -> list[float]:
        """Ends of the bins and of the response, from the window's begin."""
        sizes = [self.first_bin * 10 ** ((self.bins - i) * self.scaling) for i in range(1, self.bins + 1)]
        ends = np.cumsum([*sizes, step])
        return [float(e) for e in ends]


def embeddings(past_ranges: Sequence[float], bins: Sequence[int], n_scalings: int = 10, least_first_bin: float = 0.005, least_step: float = 0.01) -> list[Embedding]:
    """The grid of embeddings: per range and number of bins, scalings from 0 up to where the first bin gets too small."""
    out = []
    for t in past_ranges:
        for d in bins:
            if d == 1:
                out.append(Embedding(t, 1))
                continue
            if Embedding(t, d).first_bin < least_first_bin:
                continue
            low, high = 0.0, 10.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if Embedding(t, d, mid).first_bin >= least_first_bin else (low, mid)
            step = max(least_step, low / max(1, n_scalings - 1))
            out += [Embedding(t, d, round(k * step, 12)) for k in range(n_scalings) if k * step <= low + 1e-12]
    return out


#: Different ends of bins up to which spikes are merged before they are dealt to windows.
MERGED_ENDS = 64


def merged(spikes: DataFrame, ends: Sequence[Sequence[float]], step: float) -> DataFrame:
    """proc, t, m, last: the spikes between the same two ends of bins of all windows as one spike at the first one's time, and the last one's time.

    For each offset x, windows' ends lie at k * step + x, and a spike's class is the last
    k whose end is before it and whether one is at it, by the comparisons that deal spikes
    to windows; so spikes of a class lie in the same bins of the same windows, and there
    are no more classes than steps times offsets, whatever the number of spikes.
    """
    offsets = sorted({0.0, *(x for own in ends for x in own)})
    if len(offsets) > MERGED_ENDS:
        return spikes.select("proc", "t", F.lit(1).cast("long").alias("m"), F.col("t").alias("last"))

    def of(x: float) -> Column:
        q = F.floor((F.col("t") - F.lit(x)) / F.lit(step)).cast("long")
        at, after = (k * F.lit(step) + F.lit(x) for k in (q, q + 1))
        before = q + (F.col("t") > at).cast("long") + (F.col("t") > after).cast("long")
        return before * 2 + ((F.col("t") == at) | (F.col("t") == after)).cast("long")

    found = spikes.groupBy("proc", F.array(*map(of, offsets)).alias("__class")).agg(F.min("t").alias("t"), F.count("*").alias("m"), F.max("t").alias("last"))
    return kept(found.drop("__class"), "merged-spikes")


def grid_symbols(spikes: DataFrame, grid: Sequence[Embedding], step: float = 0.005) -> DataFrame:
    """e (place in the grid), proc, n_windows, k, symbol of the windows whose symbol isn't 0 (spikes: proc, t from 0).

    Spikes between the same ends of bins are merged, and dealt to the windows of every
    embedding in one pass; processes that are shorter than an embedding's window have no
    rows of it.
    """
    ends = [e.delimiters(step) for e in grid]
    plans = F.array(*(F.struct(F.lit(k).alias("e"), F.lit(e.bins).alias("bins"), F.array(*map(F.lit, own)).alias("ends"), F.lit(own[-1]).alias("length")) for k, (e, own) in enumerate(zip(grid, ends, strict=True))))
    own = merged(spikes, ends, step)
    last = own.groupBy("proc").agg(F.max("last").alias("__last"))
    met = beside(own, last, ["proc"]).select("proc", "t", "m", "__last", F.explode(plans).alias("p")).select("proc", "t", "m", "p.*", F.floor((F.col("__last") - F.col("p.length")) / step).cast("long").alias("n_windows"))
    first = F.greatest(F.floor((F.col("t") - F.col("length")) / step) - 1, F.lit(0))
    end = F.least(F.floor(F.col("t") / step) + 1, F.col("n_windows") - 1)
    dealt = met.where((F.col("n_windows") > 0) & (first <= end)).select("e", "proc", "n_windows", "t", "m", "bins", "ends", "length", F.explode(F.sequence(first.cast("long"), end.cast("long"))).alias("k"))
    begin = F.col("k") * F.lit(step)
    inside = dealt.where((F.col("t") >= begin) & (F.col("t") < begin + F.col("length")))
    place = F.least(F.size(F.filter("ends", lambda x: F.col("t") > begin + x)), F.col("bins"))
    keys = ["e", "proc", "bin"]
    found = inside.groupBy("e", "proc", "n_windows", "bins", "k", place.alias("bin")).agg(F.sum("m").alias("c"))
    # exact medians of counts, windows without spikes in a bin counting as 0
    histogram = found.groupBy(*keys, "n_windows", "c").agg(F.count("*").alias("m"))
    own = Window.partitionBy(*keys)
    zeros = F.col("n_windows") - F.sum("m").over(own)
    upto = zeros + F.sum("m").over(own.orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    ranked = histogram.withColumn("upto", upto).withColumn("zeros", zeros)

    def at(rank: Column) -> Column:
        return F.when(F.col("zeros") >= rank, F.lit(0)).otherwise(F.min(F.when(F.col("upto") >= rank, F.col("c"))))

    n = F.col("n_windows")
    medians = ranked.groupBy(*keys, "n_windows", "zeros").agg(((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median")).select(*keys, "median")
    bits = beside(found, medians, keys).where(F.col("c") > F.col("median"))
    return bits.groupBy("e", "proc", "n_windows", "k").agg(F.sum(F.pow(F.lit(2.0), F.col("bins") - F.col("bin"))).cast("long").alias("symbol"))


def symbols(spikes: DataFrame, e: Embedding, step: float = 0.005) -> DataFrame:
    """proc, n_windows, k, symbol of one embedding's windows whose symbol isn't 0."""
    return grid_symbols(spikes, [e], step).drop("e")


def grid_counts(found: DataFrame) -> DataFrame:
    """e, proc, symbol, n of what ``grid_symbols`` gives, with the windows whose symbol is 0."""
    return _with_rest(found.groupBy("e", "proc", "n_windows", "symbol").agg(F.count("*").alias("n")), ["e", "proc"], "n_windows")


def symbol_counts(spikes: DataFrame, e: Embedding, step: float = 0.005) -> DataFrame:
    """proc, symbol, n, with the windows whose symbol is 0."""
    counts = symbols(spikes, e, step).groupBy("proc", "n_windows", "symbol").agg(F.count("*").alias("n"))
    return _with_rest(counts, ["proc"], "n_windows")


def _with_rest(counts: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """keys, symbol, n: the counts, and per group one more row of symbol 0 for what they lack of ``total``."""
    own = Window.partitionBy(*keys)
    rest = F.col(total) - F.sum("n").over(own)
    first = F.row_number().over(own.orderBy("symbol")) == 1
    rows = F.array(F.struct(F.col("symbol").cast("long").alias("symbol"), F.col("n").cast("long").alias("n")), F.struct(F.lit(0).cast("long").alias("symbol"), F.col("__rest").cast("long").alias("n")))
    marked = counts.withColumn("__rest", F.when(first, rest).otherwise(0))
    return marked.select(*keys, F.explode(rows).alias("__row")).select(*keys, "__row.symbol", "__row.n").where("n > 0")


def plug_in(counts: DataFrame, keys: Sequence[str] = ("proc",)) -> DataFrame:
    """keys, mi (nats), r: I(past; response) and its share of the response's entropy, from symbol counts."""
    kinds = F.array(F.struct(F.lit("now").alias("kind"), (F.col("symbol") % 2).alias("s")), F.struct(F.lit("past").alias("kind"), F.shiftright("symbol", 1).alias("s")), F.struct(F.lit("joint").alias("kind"), F.col("symbol").alias("s")))
    dealt = counts.select(*keys, "n", F.explode(kinds).alias("k")).groupBy(*keys, "k.kind", "k.s").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "kind"))
    rows = dealt.withColumn("p", share).groupBy(*keys)
    h = {kind: -F.sum(F.when(F.col("kind") == kind, F.col("p") * F.log("p"))) for kind in ("now", "past", "joint")}
    met = rows.agg(*(x.alias(f"__{kind}") for kind, x in h.items()))
    mi = F.col("__now") + F.col("__past") - F.col("__joint")
    return met.select(*keys, mi.alias("mi"), F.when(F.col("__now") > 0, mi / F.col("__now")).otherwise(0.0).alias("r"))


def entropy_of_counts(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def nsb_entropy(n: np.ndarray, states: int) -> float:
    """Nemenman-Shafee-Bialek entropy (nats) of counts over ``states`` possible symbols.

    The mean entropy at each concentration beta is weighted by the evidence and by
    the prior that is flat in the expected entropy, over a grid of log beta.
    """
    n = np.asarray(n, dtype=float)
    n = n[n > 0]
    total = n.sum()
    values, times = np.unique(n, return_counts=True)
    u = np.linspace(-18, 14, 1_601)
    beta = np.exp(u)
    h = 1e-4
    evidence = _lgamma(states * beta) - _lgamma(total + states * beta) + sum(m * (_lgamma(v + beta) - _lgamma(beta)) for v, m in zip(values, times, strict=True))

    def flat(b: np.ndarray) -> np.ndarray:
        return digamma(states * b + 1) - digamma(b + 1)

    slope = (flat(beta * (1 + h)) - flat(beta * (1 - h))) / (2 * h)  # d xi / d log beta
    weight = np.maximum(slope, 0) * np.exp(evidence - evidence.max())
    mean = digamma(total + states * beta + 1) - sum(m * (v + beta) / (total + states * beta) * digamma(v + beta + 1) for v, m in zip(values, times, strict=True))
    mean -= (states - len(n)) * beta / (total + states * beta) * digamma(beta + 1)
    return float((weight * mean).sum() / weight.sum()) if weight.sum() > 0 else entropy_of_counts(n)


def _split(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    past: dict[int, int] = {}
    now = np.zeros(2)
    for s, n in counts.items():
        past[s >> 1] = past.get(s >> 1, 0) + n
        now[s & 1] += n
    return np.array(list(counts.values())), np.array(list(past.values())), now


def plug_in_of(counts: dict[int, int]) -> tuple[float, float]:
    joint, past, now = _split(counts)
    h = entropy_of_counts(now)
    mi = h + entropy_of_counts(past) - entropy_of_counts(joint)
    return mi, mi / h if h > 0 else 0.0


def nsb_of(counts: dict[int, int], bins: int) -> tuple[float, float]:
    joint, past, now = _split(counts)
    h = entropy_of_counts(now)
    mi = h + nsb_entropy(past, 2**bins) - nsb_entropy(joint, 2 ** (bins + 1))
    return mi, mi / h if h > 0 else 0.0


def bias_term(r_nsb: float, r_plug_in: float) -> float:
    """Bayesian bias criterion: the relative distance of the two estimates."""
    return abs(r_nsb - r_plug_in) / r_nsb if r_nsb > 0 else math.inf


def shuffling_of(counts: dict[int, int], bins: int, seed: int = 1) -> tuple[float, float]:
    """Plug-in estimate less the bias seen on data with bins shuffled given the response."""
    own = [{s >> 1: n for s, n in counts.items() if s & 1 == x} for x in (0, 1)]
    sizes = np.array([sum(c.values()) for c in own], dtype=float)
    h = entropy_of_counts(sizes)
    mi, _ = plug_in_of(counts)
    rng = np.random.default_rng(seed)
    correction = 0.0
    for c, size in zip(own, sizes, strict=True):
        if not size:
            continue
        words, weight = np.array(list(c)), np.array(list(c.values()))
        code = np.zeros(int(size), dtype=np.int64)
        independent = 0.0
        for b in range(bins):
            active = int(weight[words >> b & 1 == 1].sum())
            code[rng.choice(int(size), active, replace=False)] += 1 << b
            independent += entropy_of_counts(np.array([active, size - active]))
        correction += size / sizes.sum() * (independent - entropy_of_counts(np.unique(code, return_counts=True)[1]))
    mi = float(mi - correction)
    return mi, mi / h if h > 0 else 0.0


def firing_rate(spikes: DataFrame, bin_size: float = 0.005) -> DataFrame:
    """proc, rate (spikes per second), length, and h_spiking (nats) of activity in bins."""
    spans = spikes.groupBy("proc").agg(F.count("*").alias("n"), F.max("t").alias("length"))
    active = spikes.groupBy("proc").agg(F.count_distinct(F.floor(F.col("t") / bin_size)).alias("active"))
    met = spans.join(active, "proc").withColumn("p", F.col("active") / (F.floor(F.col("length") / bin_size) + 1))
    q = 1 - F.col("p")
    return met.select("proc", (F.col("n") / F.col("length")).alias("rate"), "length", (-F.col("p") * F.log("p") - F.when(q > 0, q * F.log(q)).otherwise(0.0)).alias("h_spiking"))


def auto_information(spikes: DataFrame, bin_size: float, most_delays: int) -> DataFrame:
    """proc, delay, r: 2 - H(now, now + delay) / H(now) of binned activity, delays in bins; 0 where the activity never changes."""
    bins = spikes.select("proc", F.floor(F.col("t") / bin_size).cast("long").alias("b")).distinct()
    size = spikes.groupBy("proc").agg((F.floor(F.max("t") / bin_size) + 1).alias("n_bins"))
    active = bins.groupBy("proc").agg(F.count("*").alias("n1")).join(size, "proc")
    earlier = bins.select("proc", "b", F.explode(F.sequence(F.lit(1), F.lit(most_delays))).alias("delay"))
    later = bins.select("proc", F.col("b").alias("b2"))
    both = earlier.join(later, (earlier.proc == later.proc) & (F.col("b") + F.col("delay") == F.col("b2"))).groupBy(earlier.proc.alias("proc"), "delay").agg(F.count("*").alias("n11"))
    first = earlier.join(size, "proc").where(F.col("b") + F.col("delay") < F.col("n_bins")).groupBy("proc", "delay").agg(F.count("*").alias("a"))
    second = earlier.where(F.col("b") >= F.col("delay")).groupBy("proc", "delay").agg(F.count("*").alias("c"))
    grid = active.select("proc", "n1", "n_bins", F.explode(F.sequence(F.lit(1), F.lit(most_delays))).alias("delay"))
    met = grid.join(both, ["proc", "delay"], "left").join(first, ["proc", "delay"], "left").join(second, ["proc", "delay"], "left").fillna(0, ["n11", "a", "c"])

    def term(n: Column, total: Column) -> Column:
        return F.when(n > 0, -(n / total) * F.log(n / total)).otherwise(0.0)

    m = (F.col("n_bins") - F.col("delay")).cast("double")
    joint = term(F.col("n11"), m) + term(F.col("a") - F.col("n11"), m) + term(F.col("c") - F.col("n11"), m) + term(m - F.col("a") - F.col("c") + F.col("n11"), m)
    n_bins = F.col("n_bins").cast("double")
    own = term(F.col("n1"), n_bins) + term(n_bins - F.col("n1"), n_bins)
    return met.select("proc", "delay", F.when(own > 0, 2 - F.try_divide(joint, own)).otherwise(0.0).alias("r"))


def temporal_depth(max_r: dict[float, float], sd: float = 0.0) -> float:
    """The shortest past range whose dependence reaches the largest less one standard deviation."""
    limit = max(max_r.values()) - sd
    return min(t for t, r in max_r.items() if r >= limit)


def information_timescale(max_r: dict[float, float], r_tot: float, least_range: float = 0.01) -> float:
    """Mean of the ranges between steps, weighted by the gains in dependence that don't exceed r_tot."""
    ends = np.array(sorted(max_r))
    begins = np.concatenate([[0.0], ends[:-1]])
    r = np.array([max_r[t] for t in ends])
    counted = r <= r_tot
    best = np.maximum.accumulate(np.where(counted, r, -np.inf))
    before = np.concatenate([[0.0], np.maximum(best[:-1], 0)])
    gain = np.where(counted, np.maximum(r - before, 0), 0)
    late = begins >= least_range
    if not late.any() or gain[late].sum() == 0:
        return 0.0
    middle = (begins[late] + ends[late]) / 2 - begins[late][0]
    return float(middle @ gain[late] / gain[late].sum())


def averaged_r_tot(max_r: dict[float, float], depth: float, sd: float = 0.0) -> float:
    """Mean dependence from the depth on to where it falls below the threshold."""
    limit, kept = max(max_r.values()) - sd, []
    for t in sorted(max_r):
        if t >= depth:
            if max_r[t] < limit:
                break
            kept.append(max_r[t])
    return float(np.mean(kept))


def bootstrap_counts(found: DataFrame, n_boot: int, block: int | DataFrame, seed: int = 1) -> DataFrame:
    """boot, proc, symbol, n: symbols of windows drawn in blocks; ``found`` is what ``symbols`` gives.

    ``block`` is the number of windows in a block, or a table (proc, block).  Each block
    of a replicate begins at a keyed place; a window's uses are counted by joining block
    begins with the windows in their range, cut into block-sized cells.
    """
    sizes = found.groupBy("proc").agg(F.max("n_windows").alias("n_windows"))
    sizes = sizes.withColumn("block", F.lit(block)) if isinstance(block, int) else sizes.join(block.select("proc", "block"), "proc")
    size = F.col("block")
    replicates = sizes.select("proc", "n_windows", "block", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot"))
    begins = replicates.select("proc", "n_windows", "block", "boot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_windows") / size).cast("int") - 1)).alias("j"))
    start = F.floor(uniform(seed, "proc", "boot", "j") * F.greatest(F.col("n_windows") - size + 1, F.lit(1))).cast("long")
    length = F.least(size, F.col("n_windows") - F.col("j") * size)
    dealt = begins.select("proc", "boot", "block", start.alias("s"), length.alias("len"))
    cells = dealt.select("proc", "boot", "s", "len", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("s") + F.col("len") - 1) / size))).alias("cell"))
    windows = beside(found, sizes.select("proc", "block"), ["proc"]).select("proc", "symbol", "k", F.floor(F.col("k") / size).alias("cell"))
    used = cells.join(windows, ["proc", "cell"]).where((F.col("k") >= F.col("s")) & (F.col("k") < F.col("s") + F.col("len")))
    totals = dealt.groupBy("proc", "boot").agg(F.sum("len").alias("total"))
    counts = used.groupBy("proc", "boot", "symbol").agg(F.count("*").alias("n")).join(totals, ["proc", "boot"])
    return _with_rest(counts, ["proc", "boot"], "total")


def interval(estimate: float, boots: Sequence[float], by_sd: bool = True, low: float = 2.5, high: float = 97.5) -> tuple[float, float]:
    """Two population standard deviations around the estimate, or percentiles."""
    if by_sd:
        return estimate - 2 * float(np.std(boots)), estimate + 2 * float(np.std(boots))
    return float(np.percentile(boots, low)), float(np.percentile(boots, high))


@dataclass
class HistoryResult:
    process: int
    method: str
    temporal_depth: float
    timescale: float
    r_tot: float
    r_tot_interval: tuple[float, float]
    best: Embedding
    max_r: dict[float, float] = field(default_factory=dict)


def _estimator(bins: dict[int, int], keys: Sequence[str], seed: int) -> Callable:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(own["symbol"].tolist(), own["n"].tolist(), strict=True))
        d = bins[int(own["e"].iloc[0])]
        plain, nsb, shuffled = plug_in_of(counts)[1], nsb_of(counts, d)[1], shuffling_of(counts, d, seed)[1]
        return pd.DataFrame([[*(own[k].iloc[0] for k in keys), plain, nsb, bias_term(nsb, plain), shuffled]], columns=[*keys, "plug_in", "nsb", "bias", "shuffling"])

    return run


def estimates(counts: DataFrame, grid: Sequence[Embedding], keys: Sequence[str] = ("e", "proc"), seed: int = 1) -> DataFrame:
    """keys, plug_in, nsb, bias (between the two), shuffling: the dependences of symbol counts, a group of keys in a task.

    ``counts`` has the keys, e, symbol and n: a group is at most 2 ** (d + 1) rows.  Without
    an NSB estimate above 0 the bias is infinite.
    """
    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    out = ", ".join([*(f"{k} {types[k]}" for k in keys), "plug_in double", "nsb double", "bias double", "shuffling double"])
    return counts.groupBy(*keys).applyInPandas(_estimator({k: e.bins for k, e in enumerate(grid)}, list(keys), seed), out)


_RESULT = "proc int, temporal_depth double, timescale double, r_tot double, r_low double, r_high double, e int, max_r map<double,double>"


def _scales(least_range: float) -> Callable:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        """Of one process: the best dependence of each past range, and the bootstraps of the best range."""
        max_r = dict(sorted(zip(own["past_range"].tolist(), own["r"].tolist(), strict=True)))
        top = own.sort_values(["r", "past_range"], ascending=[False, True]).iloc[0]
        boots = [] if own["boots"].iloc[0] is None else sorted(own["boots"].iloc[0])
        depth = temporal_depth(max_r, float(np.std(boots)) if boots else 0.0)
        r_tot = max_r[depth]
        low, high = interval(r_tot, boots) if boots else (r_tot, r_tot)
        return pd.DataFrame([[int(top["proc"]), depth, information_timescale(max_r, r_tot, least_range), r_tot, low, high, int(top["e"]), max_r]], columns=["proc", "temporal_depth", "timescale", "r_tot", "r_low", "r_high", "e", "max_r"])

    return run


def optimised(spikes: DataFrame, grid: Sequence[Embedding], method: str = "shuffling", step: float = 0.005, tolerance: float = 0.05, n_boot: int = 0, seed: int = 1, least_range: float = 0.01) -> DataFrame:
    """proc, temporal_depth, timescale, r_tot, r_low, r_high, e (the best embedding's place in the grid), max_r (by past range).

    Ties go to the earlier embedding and the shorter range.  With ``bbc``, embeddings
    whose bias reaches the tolerance are left out, and processes without any other have
    no row.
    """
    if method not in ("shuffling", "bbc"):
        raise ValueError(f"unknown method {method!r}")
    found = grid_symbols(spikes, grid, step)
    if n_boot:  # read again by the bootstraps
        found = kept(found, "history-symbols")
    column = "nsb" if method == "bbc" else "shuffling"
    scored = estimates(grid_counts(found), grid, seed=seed)
    if method == "bbc":
        scored = scored.where(F.col("bias") < tolerance)
    ranges = F.element_at(F.array(*(F.lit(float(e.past_range)) for e in grid)), F.col("e") + 1)
    better = F.struct(F.col(column).alias("r"), (-F.col("e")).alias("first"))
    best = scored.groupBy("proc", ranges.alias("past_range")).agg(F.max(better).alias("b")).select("proc", "past_range", F.col("b.r").alias("r"), (-F.col("b.first")).alias("e"))
    if not n_boot:
        return best.withColumn("boots", F.lit(None).cast("array<double>")).groupBy("proc").applyInPandas(_scales(least_range), _RESULT)
    top = best.groupBy("proc").agg(F.max(F.struct("r", (-F.col("past_range")).alias("near"), "e")).alias("b")).select("proc", F.col("b.e").alias("e"))
    chosen = beside(found, top, ["proc", "e"])
    blocks = firing_rate(spikes, step).select("proc", F.greatest(F.lit(1), (1 / (F.col("rate") * step)).cast("int")).alias("block"))
    drawn = beside(bootstrap_counts(chosen.drop("e"), n_boot, blocks, seed), top, ["proc"])
    boots = estimates(drawn, grid, ("proc", "boot"), seed).groupBy("proc").agg(F.collect_list(column).alias("boots"))
    return best.join(boots, "proc", "left").groupBy("proc").applyInPandas(_scales(least_range), _RESULT)


def optimise(spikes: DataFrame, grid: Sequence[Embedding], method: str = "shuffling", step: float = 0.005, tolerance: float = 0.05, n_boot: int = 0, seed: int = 1, least_range: float = 0.01) -> list[HistoryResult]:
    """What ``optimised`` gives, brought to the driver: a result for each process."""
    rows = optimised(spikes, grid, method, step, tolerance, n_boot, seed, least_range).orderBy("proc").collect()
    return [HistoryResult(r["proc"], method, r["temporal_depth"], r["timescale"], r["r_tot"], (r["r_low"], r["r_high"]), grid[r["e"]], dict(r["max_r"])) for r in rows]
