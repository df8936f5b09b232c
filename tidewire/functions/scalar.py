"""Scalar transforms over grouped columns: standardising, binning, radix codes, keyed ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.special import EULER_GAMMA


def _by(by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


#: Rows of per-group facts up to which they are broadcast.
FEW_ROWS = 100_000


def beside(df: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-group facts next to their rows.

    Groups (processes) are few against rows, and dealing rows out by them would leave
    a few tasks with everything.  The facts are counted; up to FEW_ROWS they are
    broadcast and the rows stay where they are, beyond that both sides are dealt out.
    """
    facts = facts.cache()
    if not by:
        return df.crossJoin(F.broadcast(facts))  # one row
    return df.join(F.broadcast(facts) if facts.count() <= FEW_ROWS else facts, list(by))


def standardise(df: DataFrame, by: Sequence[str] = ("proc",), value: str = "value", ddof: int = 1) -> DataFrame:
    """z-scores per group; values of a group without spread are centred only."""
    spread = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    facts = df.groupBy(*by).agg(F.avg(value).alias("__mean"), spread.alias("__sd"))
    flat = F.coalesce(F.abs("__sd") < 1e-12, F.lit(True))
    return beside(df, facts, by).withColumn(value, F.when(flat, F.col(value) - F.col("__mean")).otherwise((F.col(value) - F.col("__mean")) / F.col("__sd"))).drop("__mean", "__sd")


def equal_width(df: DataFrame, bins: int, by: Sequence[str] = ("proc",), value: str = "value") -> DataFrame:
    """Bin number of each value between its group's extremes; the largest value is in the last bin."""
    facts = df.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    step = (F.col("__high") - F.col("__low")) / F.lit(float(bins))
    code = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("__low")) / step), F.lit(bins - 1)))
    return beside(df, facts, by).withColumn(value, code.cast("int")).drop("__low", "__high")


#: Approximate quantiles that cut a group into parts for exact ranks.
SPLITS = 64


def _below(value: str, cuts: str) -> Column:
    """The number of ``cuts`` (an array) that lie below the value."""
    return F.size(F.filter(cuts, lambda c: c < F.col(value)))


def rank_values(df: DataFrame, ranks: Sequence[Column], by: Sequence[str], value: str) -> DataFrame:
    """by, cuts: the values at the given ranks (from 1; expressions of the group's row count __n), sorted.

    Approximate quantiles cut each group into parts whose rows are counted; only the
    parts that hold a wanted rank are put in order.  No task sorts a whole group.
    """
    sketch = df.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(k / SPLITS) for k in range(1, SPLITS))), F.lit(10_000)).alias("__splits"), F.count("*").alias("__n"))
    parted = beside(df.select(*by, value), sketch, by).select(*by, value, "__n", _below(value, "__splits").alias("__part"))
    sizes = parted.groupBy(*by, "__part", "__n").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__m")
    wanted = sizes.withColumn("__before", before).select(*by, "__part", "__before", "__m", F.explode(F.array(*ranks)).alias("__rank")).where("__rank > __before and __rank <= __before + __m")
    held = wanted.groupBy(*by, "__part", "__before").agg(F.collect_list("__rank").alias("__ranks"))
    counts = beside(parted, held, [*by, "__part"]).groupBy(*by, "__part", "__before", "__ranks", value).agg(F.count("*").alias("__m"))
    upto = F.col("__before") + F.sum("__m").over(Window.partitionBy(*by, "__part").orderBy(value))
    reached = counts.withColumn("__upto", upto).select(*by, value, F.explode("__ranks").alias("__rank"), "__upto").where("__rank <= __upto")
    cuts = reached.groupBy(*by, "__rank").agg(F.min(value).alias("__cut"))
    return cuts.groupBy(*by).agg(F.sort_array(F.collect_list("__cut")).alias("cuts"))


def max_entropy(df: DataFrame, bins: int, by: Sequence[str] = ("proc",), value: str = "value") -> DataFrame:
    """Bins of about equal counts; equal values share the lower bin.

    Cutoff b is the value at rank floor((b + 1) n / bins), and a value's bin is the
    number of cutoffs below it.
    """
    ranks = [F.floor(F.lit(b + 1) * F.col("__n") / F.lit(float(bins))) for b in range(bins - 1)]
    found = rank_values(df, ranks, by, value).withColumnRenamed("cuts", "__cuts")
    groups = df.select(*by).distinct().join(found, list(by), "left") if by else found
    return beside(df, groups, by).withColumn(value, F.coalesce(_below(value, "__cuts"), F.lit(0)).cast("int")).drop("__cuts")


def radix(columns: Sequence[Column | str], base: int) -> Column:
    """Mixed-radix code, the last column least significant."""
    if base ** len(columns) >= 1 << 63:
        raise ArithmeticError("the code doesn't fit 64 bits")
    return reduce(lambda a, b: a * F.lit(base) + b, [F.col(c).cast("long") if isinstance(c, str) else c.cast("long") for c in columns], F.lit(0).cast("long"))


def keyed(seed: int | str, *columns: Column | str) -> Column:
    """A key for deterministic random orders: md5 of the seed and the columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)))


def uniform(seed: int | str, *columns: Column | str) -> Column:
    """A number in [0, 1) that follows from the key."""
    return F.conv(F.substring(keyed(seed, *columns), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def digamma_table(spark: SparkSession, most: int) -> DataFrame:
    """n, psi for n = 1 to ``most``: psi(n) = -gamma + sum of 1 / i for i < n."""
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    terms = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") == 1, F.lit(-EULER_GAMMA)).otherwise(1.0 / (F.col("id") - 1)).alias("t"))
    return terms.select("n", F.sum("t").over(order).alias("psi"))


def psi(n: Column) -> Column:
    """Digamma of positive numbers as an expression: shifted to 8 and up, then the asymptotic series."""
    shift, y = F.lit(0.0), n.cast("double")
    terms = [F.when(y < 8, 1 / (y + k)).otherwise(0.0) if k == 0 else F.when(y < 8 - k, 1 / (y + k)).otherwise(0.0) for k in range(8)]
    shift = reduce(lambda a, b: a + b, terms)
    z = F.greatest(y, y + F.ceil(F.lit(8.0) - y))
    inv = 1 / (z * z)
    return F.log(z) - 0.5 / z - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132)))) - shift
