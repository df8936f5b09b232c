"""Results as DataFrames: adjacency, delays, unions, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.plans.inference import StorageResult, TargetResult

_VARIABLES = "target int, source int, lag int, stat double, pval double"
WEIGHTS = ("max_te_lag", "max_p_lag", "vars_count", "binary")


def variables_frame(spark: SparkSession, results: Sequence[TargetResult]) -> DataFrame:
    """target, source, lag, stat, pval of every selected source variable."""
    rows = [(r.target, v[0], v[1], st, p) for r in results for v, st, p in zip(r.selected_vars_sources, r.selected_sources_stat, r.selected_sources_pval, strict=True)]
    return spark.createDataFrame(rows, _VARIABLES)


def targets_frame(spark: SparkSession, results: Sequence[TargetResult]) -> DataFrame:
    kind = "target int, sources_tested array<int>, selected_vars_target array<struct<proc:int,lag:int>>, omnibus_stat double, omnibus_pval double, omnibus_sign boolean"
    return spark.createDataFrame([(r.target, r.sources_tested, [tuple(v) for v in r.selected_vars_target], r.omnibus_stat, float(r.omnibus_pval), bool(r.omnibus_sign)) for r in results], kind)


def storage_frame(spark: SparkSession, results: Sequence[StorageResult]) -> DataFrame:
    kind = "process int, selected_vars array<struct<proc:int,lag:int>>, ais double, ais_pval double, ais_sign boolean"
    return spark.createDataFrame([(r.process, [tuple(v) for v in r.selected_vars], float(r.ais), float(r.ais_pval), bool(r.ais_sign)) for r in results], kind)


def delays(variables: DataFrame, criterion: str = "max_te") -> DataFrame:
    """source, target, lag: that of the largest statistic or the smallest p-value of the link; ties take the smaller lag."""
    if criterion not in ("max_te", "max_p"):
        raise RuntimeError(f"unknown criterion {criterion!r}")
    order = [F.desc("stat"), F.col("lag")] if criterion == "max_te" else [F.col("pval"), F.col("lag")]
    best = Window.partitionBy("target", "source").orderBy(*order)
    return variables.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("source", "target", "lag")


def adjacency(variables: DataFrame, weights: str = "max_te_lag") -> DataFrame:
    """source, target, weight."""
    if weights not in WEIGHTS:
        raise RuntimeError(f"unknown weights {weights!r}")
    if weights in ("max_te_lag", "max_p_lag"):
        return delays(variables, weights.removesuffix("_lag")).withColumnRenamed("lag", "weight")
    own = F.count("*").cast("int") if weights == "vars_count" else F.lit(1)
    return variables.groupBy("source", "target").agg(own.alias("weight"))


def edge_list(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source", "target")


def add_edge_list(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges of ``more`` replace those between the same nodes."""
    return edges.join(more, ["source", "target"], "left_anti").unionByName(more)


def target_sources(variables: DataFrame) -> DataFrame:
    """target, sources (distinct, sorted)."""
    return variables.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def combine(*parts: Sequence[TargetResult]) -> list[TargetResult]:
    """The union of partial results; a target may be in one part only."""
    out = [r for part in parts for r in part]
    if len({r.target for r in out}) < len(out):
        raise RuntimeError("a target is in more than one part")
    return sorted(out, key=lambda r: r.target)


def union_of_networks(*variables: DataFrame) -> DataFrame:
    """target, source, lag: every link variable of any network once."""
    out = variables[0].select("target", "source", "lag")
    for other in variables[1:]:
        out = out.unionByName(other.select("target", "source", "lag"))
    return out.distinct()


def source_graph(variables: DataFrame, target: int) -> DataFrame:
    """Edges from (process, lag) variables to the target's current value, with statistic and p-value."""
    own = variables.where(F.col("target") == target)
    return own.select(F.struct(F.col("source").alias("proc"), "lag").alias("src"), F.struct(F.col("target").alias("proc"), F.lit(0).alias("lag")).alias("dst"), "stat", "pval")


def write_brain_net(edges: DataFrame, coordinates: Sequence[Sequence[float]], path: str, labels: Sequence[str] | None = None, colors: Sequence[float] | None = None, sizes: Sequence[float] | None = None) -> None:
    """``path``.node (x y z colour size label) and ``path``.edge (matrix) for a brain network viewer."""
    n = len(coordinates)
    labels = [str(x).replace(" ", "") for x in labels] if labels is not None else [str(k) for k in range(n)]
    colors, sizes = colors or [1] * n, sizes or [1] * n
    if not len(labels) == len(colors) == len(sizes) == n or any(len(c) != 3 for c in coordinates):
        raise RuntimeError("nodes, coordinates, labels, colours and sizes differ in number")
    weight = {(r["source"], r["target"]): r["weight"] for r in edges.collect()}  # a viewer's network
    with open(f"{path}.node", "w") as f:
        f.writelines("\t".join(map(str, [*coordinates[k], colors[k], sizes[k], labels[k]])) + "\n" for k in range(n))
    with open(f"{path}.edge", "w") as f:
        f.writelines("\t".join(str(weight.get((a, b), 0)) for b in range(n)) + "\n" for a in range(n))
