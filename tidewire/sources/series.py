"""Multi-trial time series as long DataFrames: proc, repl, sample, value."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.scalar import beside, standardise

_NAMES = {"p": "proc", "s": "sample", "r": "repl"}
COLUMNS = ("proc", "repl", "sample", "value")


def array_frame(spark: SparkSession, values: np.ndarray, dim_order: str = "psr") -> DataFrame:
    """An array of one to three dimensions, named by ``dim_order``, as a series; other dimensions are 0."""
    values = np.asarray(values)
    if values.ndim != len(dim_order) or len(set(dim_order)) != len(dim_order) or not set(dim_order) <= set("psr"):
        raise RuntimeError(f"{values.ndim} dimensions can't be named {dim_order!r}")
    places = np.indices(values.shape).reshape(values.ndim, -1).astype("int32")
    columns = {_NAMES[d]: places[k] for k, d in enumerate(dim_order)}
    for missing in set("psr") - set(dim_order):
        columns[_NAMES[missing]] = np.zeros(values.size, dtype="int32")
    columns["value"] = values.ravel()
    return spark.createDataFrame(pd.DataFrame(columns)).select(*COLUMNS)


@dataclass(frozen=True)
class TimeSeries:
    """A series with its sizes; values are standardised per process on request."""

    df: DataFrame

    @classmethod
    def from_array(cls, spark: SparkSession, values: np.ndarray, dim_order: str = "psr", normalise: bool = True) -> TimeSeries:
        df = array_frame(spark, values, dim_order)
        return cls(standardise(df) if normalise else df)

    @classmethod
    def from_frame(cls, df: DataFrame, normalise: bool = True) -> TimeSeries:
        """A DataFrame that has proc, sample and value; replications default to one."""
        if missing := {"proc", "sample", "value"} - set(df.columns):
            raise RuntimeError(f"the series lacks {sorted(missing)}")
        df = df if "repl" in df.columns else df.withColumn("repl", F.lit(0))
        df = df.select(*COLUMNS)
        return cls(standardise(df) if normalise else df)

    @cached_property
    def sizes(self) -> tuple[int, int, int]:
        """Processes, samples, replications."""
        row = self.df.agg(F.max("proc"), F.max("sample"), F.max("repl")).first()
        return (0, 0, 0) if row[0] is None else (row[0] + 1, row[1] + 1, row[2] + 1)

    @property
    def n_processes(self) -> int:
        return self.sizes[0]

    @property
    def n_samples(self) -> int:
        return self.sizes[1]

    @property
    def n_replications(self) -> int:
        return self.sizes[2]

    def n_realisations(self, current_sample: int = 0) -> int:
        return (self.n_samples - current_sample) * self.n_replications

    def slice(self, proc: int, offset: int = 0) -> DataFrame:
        """One process from a sample on."""
        return self.df.where((F.col("proc") == proc) & (F.col("sample") >= offset))

    def to_array(self) -> np.ndarray:
        """(process, sample, replication) on the driver; for small series."""
        out = np.full(self.sizes, np.nan)
        got = self.df.toPandas()
        out[got["proc"], got["sample"], got["repl"]] = got["value"]
        return out


def spike_trains(df: DataFrame) -> DataFrame:
    """proc, t: each process's spike times counted from its first."""
    first = df.groupBy("proc").agg(F.min("t").alias("__first"))
    return beside(df, first, ["proc"]).select("proc", (F.col("t") - F.col("__first")).alias("t"))
