"""Lag embedding: the realisations of lagged variables as columns.

Each value is dealt to the rows that use it (its sample plus the lag), and rows are
put together by one aggregate on (repl, sample).  No window over a replication is
needed, so one long replication spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Var = tuple[int, int]
"""A variable: process and lag."""


def column(var: Var) -> str:
    return f"v{var[0]}_{var[1]}"


def lag_embed(series: DataFrame, variables: Sequence[Var], max_lag: int) -> DataFrame:
    """repl, sample, and one column per variable, from sample ``max_lag`` on.

    Row (repl, t) has value (t - lag) of each variable; only complete rows stay.
    """
    variables = sorted(set(variables))
    if not variables:
        raise ValueError("no variables to embed")
    if any(lag > max_lag or lag < 0 for _, lag in variables):
        raise RuntimeError("lags are between 0 and the largest lag")
    # rows end with the series: where no variable is of lag 0, one is embedded for that alone
    bound = variables if any(lag == 0 for _, lag in variables) else [*variables, (variables[0][0], 0)]
    uses: dict[int, list[int]] = {}
    for p, lag in bound:
        uses.setdefault(p, []).append(lag)
    lags = F.lit(None).cast("array<int>")
    for p, own in uses.items():
        lags = F.when(F.col("proc") == p, F.array(*map(F.lit, own))).otherwise(lags)
    dealt = series.where(F.col("proc").isin(list(uses))).select("repl", "proc", "sample", "value", F.explode(lags).alias("lag"))
    rows = dealt.groupBy("repl", (F.col("sample") + F.col("lag")).alias("sample"))
    wide = rows.agg(*(F.max(F.when((F.col("proc") == p) & (F.col("lag") == lag), F.col("value"))).alias(column((p, lag))) for p, lag in bound))
    complete = F.lit(True)
    for v in bound:
        complete = complete & F.col(column(v)).isNotNull()
    return wide.where(complete & (F.col("sample") >= max_lag)).select("repl", "sample", *map(column, variables))


def realisations(series: DataFrame, current_sample: int, indices: Sequence[tuple[int, int]]) -> DataFrame:
    """The embedding of (process, sample) indices seen from ``current_sample``."""
    if any(s > current_sample for _, s in indices):
        raise RuntimeError("an index lies after the current value")
    return lag_embed(series, [(p, current_sample - s) for p, s in indices], current_sample)


def index_to_lag(indices: Sequence[tuple[int, int]], current_sample: int) -> list[Var]:
    if any(s > current_sample or s < 0 for _, s in indices):
        raise IndexError("an index lies outside the past of the current value")
    return [(p, current_sample - s) for p, s in indices]


def lag_to_index(lags: Sequence[Var], current_sample: int) -> list[tuple[int, int]]:
    if any(lag > current_sample or lag < 0 for _, lag in lags):
        raise IndexError("a lag lies outside the past of the current value")
    return [(p, current_sample - lag) for p, lag in lags]
