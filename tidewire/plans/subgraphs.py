"""Significant subgraph mining between two groups of graphs.

Graphs are rows (group_id, subject, link_id).  A subgraph is a set of links.  Graphs
with the same links are one pattern with a weight for each group (and, for pairs, a
weight for what both graphs of a pair hold), so counting takes as long for many copies
of a graph as for one.  Sets are enumerated in parts: which of the ``SPLIT`` most
frequent links a set holds names its part, and a part's task gets the patterns that
hold those, with their other links.  A set grows by later links over the patterns that
hold it, and is not grown where too few graphs hold it, as no larger one is held by
more.  Where few links are left, the counts of all their sets come at once from sums
over supersets.  So sets of any size are found, each in one task, and no list of
occurrences is ever made.

Tarone's factor needs the number of sets for each count alone, which tasks sum up.
Westfall and Young's level needs the smallest p-value of each permutation: tasks take a
part and a block of permutations, count each pattern's graphs in the permuted groups
once, and sum these over the patterns of a set.  Sets whose smallest possible p-value is
beyond a first guess of the level are left out, as they can't change a level below it;
where the guess turns out too low, all are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.bijection import MASK, key_number, mixed_number, places_by_key
from tidewire.functions.ranks import numbered
from tidewire.functions.special import binomial_pmf, hypergeometric_pmf, log_factorial, log_hypergeometric
from tidewire.sources.shared import kept

#: Links that name the parts (2**SPLIT tasks at most); sets that a task hands over together; links whose sets are summed at once, at most.
SPLIT, ROWS_AT_ONCE, SUMMED = 6, 1 << 14, 18
#: p-values that a task remembers; its permutations, at most; bits of counts of permuted groups that it holds.
REMEMBERED, PERMS_AT_ONCE, LABEL_BITS = 1 << 23, 500, 1 << 31
#: The first guess of Westfall and Young's level takes so many permutations, and sets of so many links.
GUESS_PERMS, GUESS_LINKS = 400, 2

WEIGHTS = ("a", "b", "both")
DESIGNS, METHODS = ("between", "within"), ("Hommel", "Tarone", "Westfall-Young")


def min_p(design: str, n_a: int, n_b: int, occurrences: int) -> float:
    """The smallest p-value that a subgraph with so many occurrences (discordant pairs) can have."""
    if design == "within":
        return 2 * binomial_pmf(occurrences, occurrences)
    n = n_a + n_b
    ends = (hypergeometric_pmf(min(n_a, occurrences), n, occurrences, n_a), hypergeometric_pmf(max(0, occurrences - n_b), n, occurrences, n_a))
    return 2 * min(ends)


def p_of(design: str, n_a: int, n_b: int, in_a: int, occurrences: int) -> float:
    """Twice the smaller tail.

    Between: Fisher's exact test; with groups of one size a table and its mirror
    images have one value, and the balanced tables of odd counts have 1.  Within:
    McNemar's test, whose left tail is the probability of the count itself.
    """
    if design == "within":
        right = sum(binomial_pmf(k, occurrences) for k in range(in_a, occurrences + 1))
        return 2 * min(right, binomial_pmf(in_a, occurrences))
    n = n_a + n_b
    if n_a == n_b:
        if occurrences > n // 2:
            in_a, occurrences = n_a - in_a, n - occurrences
        in_a = max(in_a, occurrences - in_a)
        if occurrences % 2 and in_a == (occurrences + 1) // 2:
            return 1.0
    left = math.fsum(hypergeometric_pmf(k, n, occurrences, n_a) for k in range(in_a + 1))
    right = 1 - math.fsum(hypergeometric_pmf(k, n, occurrences, n_a) for k in range(in_a))
    return 2 * min(left, right)


def p_values(design: str, n_a: int, n_b: int, total: int) -> np.ndarray:
    """``p_of`` for every in_a from 0 to total (1 for tables that can't be).

    Only counts within sqrt(380 total) of the mean are summed: by Hoeffding's bound
    what lies beyond has less than exp(-760), which is 0 as a double.
    """
    reach = math.isqrt(380 * total) + 2
    if design == "within":
        k = np.arange(max(0, total // 2 - reach), min(total, total // 2 + reach) + 1)
        pmf = np.exp(log_factorial(total) - log_factorial(k) - log_factorial(total - k) - total * math.log(2))
        p = np.zeros(total + 1)
        p[k] = 2 * np.minimum(np.cumsum(pmf[::-1])[::-1], pmf)
        return p
    n = n_a + n_b
    t = min(total, n - total) if n_a == n_b else total
    mean = t * n_a // n
    j = np.arange(max(0, t - n_b, mean - reach), min(n_a, t, mean + reach) + 1)
    pmf = np.exp(log_hypergeometric(j, n, n_a, t))
    p = np.zeros(t + 1)
    p[j] = 2 * np.minimum(np.cumsum(pmf), np.cumsum(pmf[::-1])[::-1])
    if n_a != n_b:
        return p
    if t % 2:
        p[(t + 1) // 2] = 1.0
    k = np.arange(total + 1)
    a = np.clip(n_a - k if total > n // 2 else k, 0, t)
    return p[np.maximum(a, t - a)]


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places starts, starts + 1, ... of spans one after another."""
    return np.arange(lens.sum()) + np.repeat(starts - np.cumsum(lens) + lens, lens)


class _Part:
    """The sets of one part: its patterns as runs of links in ascending places, with their weights (in a, in b, in both graphs of a pair)."""

    def __init__(self, table: pa.Table, design: str, least: int, most_links: int | None) -> None:
        self.design, self.least, self.most_links = design, least, most_links
        self.fixed = np.array(sorted(table["fixed"][0].as_py()), dtype=np.int64)
        self.weights = np.stack([table[c].to_numpy().astype(float) for c in ("a", "b", "both")])  # whole numbers, exact below 2**53
        rest = table["rest"].combine_chunks()
        self.links, self.flat = np.unique(rest.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.lens = np.diff(rest.offsets.to_numpy()).astype(np.int64)

    def counts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """in_a, total and occurrences from sums of weights."""
        a, b, both = np.rint(w).astype(np.int64)
        return (a, a + b, a + b) if self.design == "between" else (a - both, a + b - 2 * both, a + b)

    def grown(self, sums_at_once: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Sets that grow from one: its links, later links, the sets as bits over these (none: a link each), in_a, total, and where not summed at once the patterns of each."""
        in_a, total, held = self.counts(self.weights.sum(axis=1, keepdims=True))
        if held[0] < self.least or self.most_links is not None and len(self.fixed) > self.most_links:
            return
        if len(self.fixed):
            yield self.fixed[:-1], self.fixed[-1:], None, in_a, total, [np.arange(len(self.lens))]
        todo = [(self.fixed, np.arange(len(self.lens)), self.flat, self.lens)]
        while todo:
            own, rows, flat, lens = todo.pop()
            if self.most_links is not None and len(own) >= self.most_links or not len(flat):
                continue
            at = np.repeat(np.arange(len(rows)), lens)
            w = self.weights[:, rows]
            in_a, total, held = self.counts(np.stack([np.bincount(flat, x[at], len(self.links)) for x in w]))
            live = np.flatnonzero(held >= self.least)
            if not len(live):
                continue
            on = held[flat] >= self.least
            flat, at = flat[on], at[on]
            lens = np.bincount(at, minlength=len(rows))
            many = len(live)
            if sums_at_once and many <= SUMMED and (many <= 12 or 1 << many <= 64 * np.exp2(np.minimum(lens, 50)).sum()):
                rank = np.zeros(len(self.links), dtype=np.int64)
                rank[live] = np.arange(many)
                code = np.bincount(at, (1 << rank[flat]).astype(float), len(rows)).astype(np.int64)
                sums = np.stack([np.bincount(code, x, 1 << many) for x in w])
                for k in range(many):
                    view = sums.reshape(3, -1, 2, 1 << k)
                    view[:, :, 0] += view[:, :, 1]
                in_a, total, held = self.counts(sums)
                take = held >= self.least
                take[0] = False
                sets = np.flatnonzero(take)
                if self.most_links is not None:
                    sets = sets[np.bitwise_count(sets) <= self.most_links - len(own)]
                yield own, self.links[live], sets, in_a[sets], total[sets], []
                continue
            order = np.argsort(flat, kind="stable")
            each = np.bincount(flat, minlength=len(self.links))
            groups = [order[e - n : e] for n, e in zip(each[live], np.cumsum(each)[live], strict=True)]
            yield own, self.links[live], None, in_a[live], total[live], [rows[at[g]] for g in groups]
            stop = np.cumsum(lens)
            for k, g in zip(live, groups, strict=True):
                left = stop[at[g]] - g - 1
                todo.append((np.append(own, self.links[k]), rows[at[g]], flat[_spans(g + 1, left)], left))

    def named(self, own: np.ndarray, later: np.ndarray, sets: np.ndarray | None, take: np.ndarray) -> pa.ListArray:
        """Links in ascending order of the sets that are taken."""
        links = np.concatenate([own, later])
        has = np.ones((len(take), len(links)), dtype=bool)
        has[:, len(own) :] = take[:, None] == np.arange(len(later)) if sets is None else sets[take, None] >> np.arange(len(later)) & 1
        order = np.argsort(links)
        has = has[:, order]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has.sum(axis=1))), pa.int32()), pa.array(links[order][np.nonzero(has)[1]], pa.int32()))


class SubgraphMining:
    """Mining of the graphs of two groups, ``a`` (group_id 0) and ``b`` (group_id 1)."""

    def __init__(self, graphs: DataFrame, n_a: int, n_b: int, alpha: float = 0.05, design: str = "between", most_links: int | None = None) -> None:
        if design not in DESIGNS:
            raise ValueError(f"unknown design {design!r}")
        if design == "within" and n_a != n_b:
            raise ValueError("paired groups are of one size")
        self.n_a, self.n_b, self.alpha, self.design, self.most_links = n_a, n_b, alpha, design, most_links
        self.spark: SparkSession = graphs.sparkSession
        by = ["subject"] if design == "within" else ["group_id", "subject"]
        rows = graphs.select("group_id", "subject", F.col("link_id").cast("int").alias("link_id")).distinct()
        people = numbered(rows.select(*by).distinct(), by, "number")
        self.graphs = kept(rows.join(people, by).groupBy("group_id", "number").agg(F.sort_array(F.collect_list("link_id")).alias("links")), "graphs")
        own = self.graphs.select("links", (F.col("group_id") == 0).cast("long").alias("a"), (F.col("group_id") == 1).cast("long").alias("b"), F.lit(0).cast("long").alias("both"))
        if design == "within":
            pairs = self.graphs.groupBy("number").agg(F.max(F.when(F.col("group_id") == 0, F.col("links"))).alias("x"), F.max(F.when(F.col("group_id") == 1, F.col("links"))).alias("y"))
            zero = F.lit(0).cast("long")
            own = own.unionByName(pairs.where("x IS NOT NULL AND y IS NOT NULL").select(F.array_sort(F.array_intersect("x", "y")).alias("links"), zero.alias("a"), zero.alias("b"), F.lit(1).cast("long").alias("both")))
        self.patterns = kept(own.groupBy("links").agg(*(F.sum(c).alias(c) for c in WEIGHTS)), "patterns")

    @property
    def most(self) -> int:
        return self.n_a if self.design == "within" else self.n_a + self.n_b

    def _dealt(self, table: DataFrame) -> DataFrame:
        """``table`` with fixed and rest in place of links: each row in the parts of all subsets of its frequent links."""
        often = self.patterns.select(F.explode("links").alias("l"), (F.col("a") + F.col("b")).alias("n")).groupBy("l").agg(F.sum("n").alias("n"))
        top = F.array(*(F.lit(r[0]) for r in often.orderBy(F.desc("n"), "l").limit(SPLIT).collect())).cast("array<int>")
        empty = F.array(F.array().cast("array<int>"))
        subsets = F.aggregate(F.array_intersect(top, "links"), empty, lambda found, x: F.concat(found, F.transform(found, lambda s: F.concat(s, F.array(x)))))
        return table.withColumn("rest", F.array_except("links", top)).withColumn("fixed", F.explode(subsets)).drop("links")

    def _each_part(self, least: int, kernel: Callable, schema: str) -> DataFrame:
        design, most_links = self.design, self.most_links

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from kernel(_Part(pa.Table.from_batches(batches), design, least, most_links))

        parts = self._dealt(self.patterns).groupBy("fixed", "rest").agg(*(F.sum(c).alias(c) for c in WEIGHTS))
        return parts.groupBy("fixed").applyInArrow(run, schema)

    def _tables(self) -> Callable[[int], tuple[np.ndarray, float]]:
        """p-values by in_a, and the smallest one, for a total; worked out once in a task while they are few."""
        design, n_a, n_b = self.design, self.n_a, self.n_b
        known: dict[int, tuple[np.ndarray, float]] = {}
        held = [0]

        def table(total: int) -> tuple[np.ndarray, float]:
            if total not in known:
                if held[0] + total > REMEMBERED:
                    known.clear()
                    held[0] = 0
                known[total] = p_values(design, n_a, n_b, total), min_p(design, n_a, n_b, total)
                held[0] += total + 1
            return known[total]

        return table

    def counted(self, least: int = 1, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """links, in_a, total, p_value, min_p of the sets with at least ``least`` occurrences (those that ``keep`` takes by p_value and min_p)."""
        tables = self._tables()

        def rows(part: _Part) -> Iterator[pa.RecordBatch]:
            for own, later, sets, in_a, total, _ in part.grown():
                p, low = np.empty(len(total)), np.empty(len(total))
                order = np.argsort(total, kind="stable")
                kinds, starts = np.unique(total[order], return_index=True)
                for t, at in zip(kinds, np.split(order, starts[1:]), strict=True):
                    by_count, low[at] = tables(int(t))
                    p[at] = by_count[in_a[at]]
                take = np.flatnonzero(keep(p, low)) if keep else np.arange(len(total))
                for at in range(0, len(take), ROWS_AT_ONCE):
                    k = take[at : at + ROWS_AT_ONCE]
                    columns = [part.named(own, later, sets, k), *(pa.array(x[k]) for x in (in_a, total, p, low))]
                    yield pa.RecordBatch.from_arrays(columns, ["links", "in_a", "total", "p_value", "min_p"])

        return self._each_part(least, rows, "links array<int>, in_a long, total long, p_value double, min_p double")

    def totals(self, least: int = 1) -> DataFrame:
        """links, in_a, total."""

        def rows(part: _Part) -> Iterator[pa.RecordBatch]:
            for own, later, sets, in_a, total, _ in part.grown():
                for at in range(0, len(total), ROWS_AT_ONCE):
                    k = np.arange(at, min(len(total), at + ROWS_AT_ONCE))
                    yield pa.RecordBatch.from_arrays([part.named(own, later, sets, k), pa.array(in_a[k]), pa.array(total[k])], ["links", "in_a", "total"])

        return self._each_part(least, rows, "links array<int>, in_a long, total long")

    def histogram(self, least: int = 1) -> dict[int, int]:
        """Sets by total."""

        def rows(part: _Part) -> Iterator[pa.RecordBatch]:
            many: dict[int, int] = {}
            for *_, total, _ in part.grown():
                for t, n in zip(*np.unique(total, return_counts=True), strict=True):
                    many[int(t)] = many.get(int(t), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.int64()), pa.array(list(many.values()), pa.int64())], ["total", "n"])

        return {r[0]: r[1] for r in self._each_part(least, rows, "total long, n long").groupBy("total").agg(F.sum("n")).collect()}

    def least_for(self, level: float) -> int:
        """The fewest occurrences with which a p-value can reach ``level``."""
        return next((m for m in range(1, self.most + 1) if min_p(self.design, self.n_a, self.n_b, m) <= level), self.most + 1)

    def tarone_factor(self) -> int:
        """The smallest k such that at most k subgraphs can reach alpha / k."""
        found = [(min_p(self.design, self.n_a, self.n_b, t), n) for t, n in self.histogram(self.least_for(self.alpha)).items()]

        def testable(k: int) -> int:
            return sum(n for p, n in found if p <= self.alpha / k)

        low, high = 1, max(1, testable(1))
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if testable(mid) <= mid else (mid + 1, high)
        return low

    def significant(self, method: str = "Tarone", n_perm: int = 10_000, seed: int = 1) -> DataFrame:
        """links, p_value of the significant subgraphs."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        if method == "Westfall-Young":
            level = self.westfall_young_level(n_perm, seed)
            return self.counted(self.least_for(max(level, 1e-300)), lambda p, low: p <= level).select("links", "p_value")
        k, alpha = self.tarone_factor(), self.alpha
        least = self.least_for(alpha / k)
        if method == "Tarone":
            return self.counted(least, lambda p, low: (low <= alpha / k) & (p * k <= alpha)).select("links", "p_value")
        return hommel(self.counted(least, lambda p, low: low <= alpha / k), k, alpha)

    def westfall_young_level(self, n_perm: int, seed: int) -> float:
        """The largest level at which the smallest p-values of permuted groups reach it in at most alpha of the cases; the first permutation is the groups as they are."""
        guess = self._level(self._smallest(min(n_perm, GUESS_PERMS), seed, self.alpha, GUESS_LINKS), min(n_perm, GUESS_PERMS))[1]
        for most in sorted({min(self.alpha, 2 * guess), self.alpha}):
            level, beyond = self._level(self._smallest(n_perm, seed, most), n_perm)
            if beyond <= most:  # sets left out have larger p-values alone
                break
        return level

    def _level(self, smallest: DataFrame, n_perm: int) -> tuple[float, float]:
        """The level, and the next larger value, which too many permutations reach (infinite: none)."""
        found = smallest.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each permutation at most
        seen, level = 0, 0.0
        for r in found:
            seen += r["n"]
            if seen / n_perm > self.alpha or math.isinf(r["p"]):
                return level, r["p"]
            level = r["p"]
        return level, math.inf

    def _smallest(self, n_perm: int, seed: int, most: float, most_links: int | None = None) -> DataFrame:
        """perm, p: the smallest p-value of each permutation over the sets that can reach ``most`` (infinite: none)."""
        tables, design, n_a, n = self._tables(), self.design, self.n_a, self.n_a + self.n_b
        first_b = self.graphs.where("group_id = 0").agg(F.count("*")).first()[0] if design == "between" else 0
        bounds = [x for x in (most_links, self.most_links) if x is not None]
        most_links, least = min(bounds, default=None), self.least_for(most)
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        blocks = -(-n_perm // max(1, min(PERMS_AT_ONCE, -(-n_perm // tasks))))
        block = -(-n_perm // blocks)

        def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            part = _Part(table, design, least, most_links)
            begin = table["block"][0].as_py() * block
            step = max(1, LABEL_BITS // (64 * max(1, len(part.lens))))
            for at in range(begin, min(n_perm, begin + block), step):
                perms = np.arange(at, min(n_perm, begin + block, at + step))
                best, counts = np.full(len(perms), np.inf), None
                for *_, total, patterns in part.grown(sums_at_once=False):
                    for t, rows in zip(total.tolist(), patterns, strict=True):
                        p, low = tables(t)
                        if low > most:
                            continue
                        if counts is None:
                            counts = _permuted(table, perms, seed, design, n_a, n, first_b)
                        np.minimum(best, p[counts[rows].sum(axis=0)], out=best)
                yield pa.RecordBatch.from_arrays([pa.array(perms, pa.int32()), pa.array(best)], ["perm", "p"])

        dealt = self._numbers().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.repartition(2 * tasks, "fixed", "block").groupBy("fixed", "block").applyInArrow(smallest, "perm int, p double").groupBy("perm").agg(F.min("p").alias("p"))

    def _numbers(self) -> DataFrame:
        """fixed, rest, weights, plus, minus: the patterns of each part with the graphs' numbers.

        Between, graphs of a pattern have their numbers in plus.  Within, a pair counts
        where one graph alone holds a set: for a if it is that of a and not swapped, or
        that of b and swapped.  plus and minus are the pairs whose graph of a (b) holds
        the pattern, and both those whose two graphs do.
        """
        g = self.graphs.select("links", "number", "group_id")
        if self.design == "within":
            pairs = self.graphs.groupBy("number").agg(F.max(F.when(F.col("group_id") == 0, F.col("links"))).alias("x"), F.max(F.when(F.col("group_id") == 1, F.col("links"))).alias("y"))
            g = g.unionByName(pairs.where("x IS NOT NULL AND y IS NOT NULL").select(F.array_sort(F.array_intersect("x", "y")).alias("links"), "number", F.lit(2).alias("group_id")))
        each = [F.collect_list(F.when(F.col("group_id") == k, F.col("number"))).alias(f"n_{c}") for k, c in enumerate(WEIGHTS)]
        per = self._dealt(g).groupBy("fixed", "rest").agg(*each)
        return per.select("*", *(F.size(f"n_{c}").cast("long").alias(c) for c in WEIGHTS))


def _permuted(table: pa.Table, perms: np.ndarray, seed: int, design: str, n_a: int, n: int, first_b: int) -> np.ndarray:
    """Graphs (pairs) of each pattern that are in a after each permutation, from a keyed bijection of all graphs' numbers."""
    out = np.zeros((table.num_rows, len(perms)), dtype=np.int32)
    for c in WEIGHTS:
        numbers = table[f"n_{c}"].combine_chunks()
        lens = np.diff(numbers.offsets.to_numpy())
        units, rows = numbers.flatten().to_numpy(zero_copy_only=False), np.flatnonzero(lens)
        if not len(rows):
            continue
        starts = np.append(0, np.cumsum(lens[rows]))[:-1]
        # graphs of a come first, then what a lacks (graphs without links), then b
        place = np.where(units < first_b, units, units - first_b + n_a) if design == "between" else units
        for k, perm in enumerate(perms.tolist()):
            key = key_number(seed, perm)
            if design == "between":
                in_a = (places_by_key(place, n, key) if perm else place) < n_a
                out[rows, k] += np.add.reduceat(in_a, starts, dtype=np.int32)
            else:  # swapped pairs; what both graphs hold counts for neither
                swapped = (mixed_bits(units, key) if perm else np.zeros(len(units))).astype(np.int32)
                own = {"a": 1 - swapped, "b": swapped, "both": np.full_like(swapped, -1)}[c]
                out[rows, k] += np.add.reduceat(own, starts)
    return out


def mixed_bits(i: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A coin for each number."""
    return mixed_number((mixed_number(key) + i + 1) & MASK) >> 13 & 1


def hommel(found: DataFrame, k: int, alpha: float) -> DataFrame:
    """Hommel's level over the testable subgraphs; reported p-values are scaled by the correction.

    The level is alpha / m for the largest m at which the i-th smallest of the m largest
    p-values is above i alpha / m, for every i.  For the s-th of all n that is
    m (alpha - p) < (n - s) alpha, which also holds for those before the m largest, so
    each p-value below alpha bounds m by itself.
    """
    ranked = numbered(found.select("links", "p_value"), ["p_value", "links"], "s")
    n = ranked.count()
    after = n - 1 - F.col("s")
    bound = F.when(F.col("p_value") < alpha, after * alpha / (alpha - F.col("p_value"))).when((F.col("p_value") == alpha) & (after == 0), F.lit(0.0))
    least = ranked.agg(F.min(bound)).first()[0]
    j = n if least is None else min(n, math.ceil(least) - 1)
    level = alpha / j if j > 0 else alpha
    return ranked.where((F.col("p_value") <= alpha / k) | (F.col("p_value") <= level)).select("links", (F.col("p_value") * alpha / max(level, alpha / k)).alias("p_value"))


def links_of_results(networks: Sequence[DataFrame], group_id: int) -> DataFrame:
    """group_id, subject, and the link (target, source, lag) of inferred networks; ``coded`` numbers the links."""
    out = None
    for k, v in enumerate(networks):
        own = v.select(F.lit(group_id).alias("group_id"), F.lit(k).alias("subject"), "target", "source", "lag")
        out = own if out is None else out.unionByName(own)
    return out


def coded(links: DataFrame, columns: Sequence[str] = ("target", "source", "lag")) -> DataFrame:
    """``links`` with link_id: the rank of the link among all, from 0."""
    order = numbered(links.select(*columns).distinct(), columns, "link_id").withColumn("link_id", F.col("link_id").cast("int"))
    return links.join(order, list(columns))
