"""Plug-in estimators on counts of symbols, in bits.

Rows are counted once per combination of symbols; all margins come from windows
over the counts, so what is dealt out after the first aggregate is as small as the
number of combinations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: Sequence[str], z: Sequence[str]) -> tuple[DataFrame, Column]:
    """Counts of (keys, x, y, z) and the pointwise conditional information of each combination."""
    counts = df.groupBy(*keys, *x, *y, *z).agg(F.count("*").alias("__n"))

    def margin(*columns: str) -> Column:
        return F.sum("__n").over(Window.partitionBy(*keys, *columns)).cast("double")

    n = F.col("__n").cast("double")
    local = F.log2(n * margin(*z) / (margin(*x, *z) * margin(*y, *z)))
    return counts.withColumn("__local", local).withColumn("__total", margin()), n


def cmi(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), keys: Sequence[str] = (), name: str = "cmi") -> DataFrame:
    """Conditional mutual information I(x; y | z) of each group of ``keys``; without z, I(x; y)."""
    counts, n = _counted(df, keys, x, y, z)
    return counts.groupBy(*keys).agg(F.sum(n / F.col("__total") * F.col("__local")).alias(name))


def local_cmi(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), keys: Sequence[str] = (), name: str = "local") -> DataFrame:
    """Each row with its pointwise value; their mean is the estimate."""
    counts, _ = _counted(df, keys, x, y, z)
    columns = [*keys, *x, *y, *z]
    return df.join(counts.select(*columns, F.col("__local").alias(name)), columns)


def entropy(df: DataFrame, x: Sequence[str], keys: Sequence[str] = (), name: str = "h", base: float | None = 2) -> DataFrame:
    """Shannon entropy of the joint symbols of ``x``; in nats where base is None."""
    counts = df.groupBy(*keys, *x).agg(F.count("*").alias("__n")).withColumn("__p", F.col("__n") / F.sum("__n").over(Window.partitionBy(*keys)))
    log = F.log2("__p") if base == 2 else F.log("__p")
    return counts.groupBy(*keys).agg((-F.sum(F.col("__p") * log)).alias(name))


def pmf(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "p") -> DataFrame:
    """Relative frequency of each combination."""
    counts = df.groupBy(*keys, *columns).agg(F.count("*").alias("__n"))
    return counts.select(*keys, *columns, (F.col("__n") / F.sum("__n").over(Window.partitionBy(*keys))).alias(name))


def pair_table(series: DataFrame, lags: Sequence[int] = (1,)) -> DataFrame:
    """source, target, lag, and x (source past), y (target now), w (target past at lag 1): all ordered pairs of processes.

    Values are dealt once to the time steps that use them; pairs are made from the
    values that meet at a step, without a join.
    """
    dealt = series.select("proc", "repl", "sample", "value", F.explode(F.array(*(F.lit(k) for k in sorted({0, 1, *lags})))).alias("lag"))
    steps = dealt.groupBy("repl", (F.col("sample") + F.col("lag")).alias("sample")).agg(F.collect_list(F.struct("proc", "lag", "value")).alias("all"))
    now = steps.select("repl", "sample", "all", F.explode(F.filter("all", lambda e: e["lag"] == 0)).alias("y"))
    own = now.withColumn("w", F.filter("all", lambda e: (e["proc"] == F.col("y.proc")) & (e["lag"] == 1))).where(F.size("w") > 0)
    past = own.select("repl", "sample", "y", "w", F.explode(F.filter("all", lambda e: e["lag"].isin(list(lags)) & (e["proc"] != F.col("y.proc")))).alias("x"))
    return past.select(F.col("x.proc").alias("source"), F.col("y.proc").alias("target"), F.col("x.lag").alias("lag"), "repl", "sample", F.col("x.value").alias("x"), F.col("y.value").alias("y"), F.col("w")[0]["value"].alias("w"))


def te_pairs(series: DataFrame, lags: Sequence[int] = (1,)) -> DataFrame:
    """source, target, lag, te: I(source past; target now | target past) of all pairs, in bits."""
    return cmi(pair_table(series, lags), ["x"], ["y"], ["w"], ["source", "target", "lag"], "te")


def mi_pairs(series: DataFrame, lags: Sequence[int] = (1,)) -> DataFrame:
    """source, target, lag, mi."""
    return cmi(pair_table(series, lags), ["x"], ["y"], (), ["source", "target", "lag"], "mi")


def history(series: DataFrame, length: int, tau: int = 1) -> DataFrame:
    """proc, repl, sample, y (now), and h1 ... the past values at lags tau, 2 tau, ..."""
    dealt = series.select("proc", "repl", "sample", "value", F.explode(F.array(*(F.lit(k * tau) for k in range(length + 1)))).alias("lag"))
    rows = dealt.groupBy("proc", "repl", (F.col("sample") + F.col("lag")).alias("sample"))
    names = ["y", *(f"h{k}" for k in range(1, length + 1))]
    wide = rows.agg(*(F.max(F.when(F.col("lag") == k * tau, F.col("value"))).alias(n) for k, n in enumerate(names)))
    return wide.dropna(subset=names)


def ais(series: DataFrame, length: int, tau: int = 1) -> DataFrame:
    """proc, ais: I(own past; now), in bits."""
    return cmi(history(series, length, tau), [f"h{k}" for k in range(1, length + 1)], ["y"], (), ["proc"], "ais")
