"""Series, spike trains and graphs from the tables events, orders, lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    names = Window.orderBy("event_type")
    types = df.select("event_type").distinct().select("event_type", (F.row_number().over(names) - 1).cast("int").alias("proc"))
    return df.join(F.broadcast(types), "event_type").select("proc", "user_id", "event_id", micros.alias("us"), "value")


def _dense(found: DataFrame, samples: DataFrame) -> DataFrame:
    """Every process at every sample; 0 where it has no event."""
    procs = found.select("proc").distinct()
    grid = procs.crossJoin(samples)  # processes x time steps: the size of the result
    return grid.join(found, ["proc", "repl", "sample"], "left").select("proc", "repl", "sample", F.coalesce("value", F.lit(0.0)).alias("value"))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replication; a process is an event type, a sample an hour, a value the sum of the values."""
    ev = _events(spark, sf_dir)
    bounds = ev.agg(F.min(F.floor(F.col("us") / _HOUR)).alias("first"), F.max(F.floor(F.col("us") / _HOUR)).alias("last"))
    found = ev.groupBy("proc", F.floor(F.col("us") / _HOUR).alias("h")).agg(F.sum("value").alias("value")).crossJoin(bounds)
    found = found.select("proc", F.lit(0).alias("repl"), (F.col("h") - F.col("first")).cast("int").alias("sample"), "value")
    samples = bounds.select(F.lit(0).alias("repl"), F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int"))).alias("sample"))
    return _dense(found, samples)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replication is a day, a sample an hour of it."""
    ev = _events(spark, sf_dir)
    bounds = ev.agg(F.min(F.floor(F.col("us") / (24 * _HOUR))).alias("first"), F.max(F.floor(F.col("us") / (24 * _HOUR))).alias("last"))
    hour = F.floor(F.col("us") / _HOUR)
    found = ev.groupBy("proc", hour.alias("h")).agg(F.sum("value").alias("value")).crossJoin(bounds)
    found = found.select("proc", (F.floor(F.col("h") / 24) - F.col("first")).cast("int").alias("repl"), (F.col("h") % 24).cast("int").alias("sample"), "value")
    days = bounds.select(F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int"))).alias("repl"))
    samples = days.select("repl", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("sample"))
    return _dense(found, samples)


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """proc, t in seconds (not yet counted from the first)."""
    return _events(spark, sf_dir).select("proc", (F.col("us") / 1e6).alias("t"))


def user_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, subject, link_id: the transitions between event types in a user's events; groups by parity of the user."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    steps = _events(spark, sf_dir).select("user_id", "proc", F.lead("proc").over(order).alias("next")).where("next is not null")
    return steps.select((F.col("user_id") % 2).cast("int").alias("group_id"), F.col("user_id").alias("subject"), (F.col("proc") * 5 + F.col("next")).cast("int").alias("link_id")).distinct()


#: Events of a day from which on a user's day counts as busy.
BUSY = 4


def user_day_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, subject, link_id: the transitions between event types within a user's day; busy days are group 0, all others with a transition group 1."""
    day = F.floor(F.col("us") / (24 * _HOUR)).cast("long")
    own = _events(spark, sf_dir).withColumn("subject", F.col("user_id") * 100_000 + day)
    by = Window.partitionBy("subject")
    steps = own.select("subject", "proc", F.lead("proc").over(by.orderBy("us", "event_id")).alias("next"), F.count("*").over(by).alias("many")).where("next is not null")
    return steps.select((F.col("many") < BUSY).cast("int").alias("group_id"), "subject", (F.col("proc") * 5 + F.col("next")).cast("int").alias("link_id")).distinct()


_DAY = 24 * _HOUR


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replication; a sample is a day from the first order to the last.

    0: sum of the prices of the orders placed; 1: quantity shipped; 2: the work of a day,
    what was ordered on the two days before and what is shipped on it, in units of their
    means; 3: quantity shipped on the day and the two before.
    """
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / _DAY)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(day("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("value"))
    bounds = orders.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(day("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("value"))
    found = orders.withColumn("proc", F.lit(0)).unionByName(lines.withColumn("proc", F.lit(1)))
    found = found.crossJoin(bounds).where("d BETWEEN first AND last").select("proc", F.lit(0).alias("repl"), (F.col("d") - F.col("first")).cast("int").alias("sample"), "value")
    samples = bounds.select(F.lit(0).alias("repl"), F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int"))).alias("sample"))
    flow = _dense(found, samples)
    means = flow.groupBy().agg(*(F.avg(F.when(F.col("proc") == p, F.col("value"))).alias(f"m{p}") for p in (0, 1)), F.max("sample").alias("end"))
    # process, days later, process that it adds to
    adds = [(0, 1, 2), (0, 2, 2), (1, 0, 2), (1, 0, 3), (1, 1, 3), (1, 2, 3)]
    each = F.explode(F.filter(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(a, ("of", "later", "to"), strict=True))) for a in adds)), lambda e: e["of"] == F.col("proc")))
    share = F.when(F.col("e.to") == 3, F.col("value")).when(F.col("proc") == 0, F.col("value") / F.col("m0")).otherwise(F.col("value") / F.col("m1"))
    made = flow.crossJoin(F.broadcast(means)).withColumn("e", each).select(F.col("e.to").alias("proc"), "repl", (F.col("sample") + F.col("e.later")).alias("sample"), share.alias("value"), "end")
    sums = made.where("sample <= end").groupBy("proc", "repl", "sample").agg(F.sum("value").alias("value"))
    return flow.unionByName(sums)
