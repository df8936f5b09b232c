"""Ranks over whole tables without a window in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.shared import kept


def numbered(df: DataFrame, columns: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """``df``, whose rows are distinct in ``columns``, with each row's place in their order, from 0.

    Rows are range-partitioned and written; a partition's rows are ranked in it, and
    the counts of those before, a row for each partition, are added.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(n, *columns).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = sorted(dealt.groupBy("__part").agg(F.count("*")).collect())  # a row for each partition
    before, base = 0, []
    for part, many in counts:
        base.append((part, before))
        before += many
    offsets = spark.createDataFrame(base, "__part int, __base long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*columns)) - 1
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__base") + inside).drop("__part", "__base")
