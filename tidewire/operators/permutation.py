"""Surrogates by keyed, reproducible permutations.

A permutation sends a sample (or replication) to the place that its value takes; it is
the same for every column, and sample permutations are the same for every replication.
The place is worked out from the index (``functions/bijection.py``): rows are dealt to
their places as they stand, without a map, a sort or a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.bijection import key_of, with_bijection
from tidewire.functions.scalar import keyed

TYPES = ("random", "circular", "block", "local")


@dataclass(frozen=True)
class Permutation:
    """How samples are permuted: type, and its parameter(s)."""

    type: str = "random"
    max_shift: int | None = None
    block_size: int | None = None
    perm_range: int | None = None

    def check(self, n: int) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown permutation type {self.type!r}")
        if self.type == "circular" and not (self.max_shift and 0 < self.max_shift <= n):
            raise ValueError("a circular shift needs max_shift between 1 and the number of samples")
        if self.type == "block" and not (self.block_size and self.perm_range and 0 < self.block_size <= n and self.perm_range > 1):
            raise ValueError("blocks need block_size and a perm_range of 2 blocks or more")
        if self.type == "local" and not (self.perm_range and 1 < self.perm_range <= n):
            raise ValueError("local shuffles need a perm_range of 2 samples or more")


@dataclass(frozen=True)
class Surrogates:
    """``n_perm`` permutations of n samples (from ``offset`` on) or replications."""

    n: int
    n_perm: int
    seed: int
    how: Permutation = Permutation()
    axis: str = "sample"
    offset: int = 0


def with_place(df: DataFrame, out: str, i: Column, perm: Column, n: int, seed: int, how: Permutation = Permutation()) -> DataFrame:
    """``df`` with the place from 0 on that item i of n takes in a permutation."""
    how.check(n)
    i = i.cast("long")
    div = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    if how.type == "circular":
        return df.withColumn(out, (i + key_of(seed, perm) % how.max_shift + 1) % n)
    if how.type == "random":
        return with_bijection(df, out, i, n, key_of(seed, perm))
    if how.type == "local":
        first = div(i, how.perm_range) * how.perm_range
        own = with_bijection(df.withColumn("__first", first), "__to", i - first, F.least(F.lit(how.perm_range).cast("long"), n - first), key_of(seed, perm, div(i, how.perm_range)))
        return own.withColumn(out, F.col("__first") + F.col("__to")).drop("__first", "__to")
    blocks = -(-n // how.block_size)
    block = div(i, how.block_size)
    first = div(block, how.perm_range) * how.perm_range
    many, key = F.least(F.lit(how.perm_range).cast("long"), F.lit(blocks).cast("long") - first), key_of(seed, perm, div(block, how.perm_range))
    own = with_bijection(df.withColumns({"__block": block, "__first": first}), "__to", block - first, many, key)
    own = own.withColumn("__at", (F.col("__first") + F.col("__to")) * how.block_size + i % how.block_size)
    if short := blocks * how.block_size - n:  # what the last block lacks moves those behind it
        own = with_bijection(own, "__last", many - 1, many, key)
        own = own.withColumn("__at", F.col("__at") - F.when((F.col("__first") + many == blocks) & (F.col("__to") > F.col("__last")), short).otherwise(0))
    return own.withColumn(out, F.col("__at")).drop("__block", "__first", "__to", "__last", "__at")


def sample_map(spark: SparkSession, n: int, n_perm: int, seed: int, how: Permutation = Permutation()) -> DataFrame:
    """perm, i, src: in permutation ``perm``, place i takes the value of src."""
    grid = spark.range(n_perm * n).select(F.call_function("div", F.col("id"), F.lit(n).cast("long")).cast("int").alias("perm"), (F.col("id") % n).cast("int").alias("src"))
    return with_place(grid, "i", F.col("src"), F.col("perm"), n, seed, how).select("perm", F.col("i").cast("int").alias("i"), "src")


def replication_map(spark: SparkSession, n: int, n_perm: int, seed: int) -> DataFrame:
    """perm, i, src over replications."""
    return sample_map(spark, n, n_perm, seed)


def moved(rows: DataFrame, s: Surrogates) -> DataFrame:
    """The rows of every permutation (perm), at their new places."""
    each = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(s.n_perm - 1))))
    placed = with_place(each, "__place", F.col(s.axis) - s.offset, F.col("perm"), s.n, s.seed, s.how)
    return placed.withColumn(s.axis, (F.col("__place") + s.offset).cast("int")).drop("__place")


def permuted(embedded: DataFrame, columns: list[str], s: Surrogates) -> DataFrame:
    """For each permutation, the rows with ``columns`` taken from the rows that were sent to their places."""
    other = "repl" if s.axis == "sample" else "sample"
    return embedded.drop(*columns).join(moved(embedded.select(other, s.axis, *columns), s), [other, s.axis])


def slice_surrogates(series: DataFrame, proc: int, s: Surrogates) -> DataFrame:
    """perm, repl, sample, value of one process under each permutation of samples or replications."""
    own = series.where(F.col("proc") == proc).select("repl", "sample", "value")
    return moved(own, s).select("perm", "repl", "sample", "value")


def with_swapped(df: DataFrame, group: Column, i: Column, perm: Column, n: int, seed: int, dependent: bool) -> DataFrame:
    """``df`` with new_group and new_i: the group (0 or 1) and the place that replication i of a group takes.

    Dependent conditions exchange a replication's two versions by the toss of a coin;
    independent ones deal all 2 n replications anew.
    """
    if dependent:
        toss = F.conv(F.substring(keyed(seed, perm, i), 1, 8), 16, 10).cast("long") % 2
        return df.withColumns({"new_group": F.when(toss == 1, 1 - group).otherwise(group).cast("int"), "new_i": i.cast("int")})
    to = with_bijection(df, "__to", group * n + i, 2 * n, key_of(seed, perm))
    return to.withColumns({"new_group": F.call_function("div", F.col("__to"), F.lit(n).cast("long")).cast("int"), "new_i": (F.col("__to") % n).cast("int")}).drop("__to")


def swapped_replications(spark: SparkSession, n: int, n_perm: int, seed: int, dependent: bool) -> DataFrame:
    """perm, group_id, i, from_group, src: the replication that takes place i of group 0 or 1."""
    div = lambda c, m: F.call_function("div", c, F.lit(m).cast("long"))
    grid = spark.range(n_perm * 2 * n).select(div(F.col("id"), 2 * n).cast("int").alias("perm"), (div(F.col("id"), n) % 2).cast("int").alias("from_group"), (F.col("id") % n).cast("int").alias("src"))
    found = with_swapped(grid, F.col("from_group"), F.col("src"), F.col("perm"), n, seed, dependent)
    return found.select("perm", F.col("new_group").alias("group_id"), F.col("new_i").alias("i"), "from_group", "src")
