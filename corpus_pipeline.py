"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of the documents.  Between stages the rows are written.

Defined cases, in every stage: null texts count as empty; rows without an id take part,
are never removed as near copies and are told apart by their text only where copies are
exact; rows that repeat an id and a text are one row after the second stage; columns
beyond those of the documents, whatever their names, are handed through to the last
stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import exact, mixing, packing, quality, simhash
from tidewire.llm.common import bounded_batches, free_name, id_residue, table, written
from tidewire.llm.queries import MIX_WEIGHTS

#: Documents whose score is below are rejected.
QUALITY_CUT = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    bounded_batches(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(id_residue("doc_id", 5) != 0))
    score = free_name(docs, "__tw_score")
    return quality.with_quality(docs, model, out_col=score, cut=QUALITY_CUT).where(F.col(score) >= QUALITY_CUT).drop(score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest id of each group of equal texts."""
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component of similar texts (five words, similarity 0.8 or more)."""
    return simhash.near_dedup(docs, simhash.SIMILAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents at the rates that bring the languages' tokens to their weights; none is repeated."""
    return mixing.mixed(docs, MIX_WEIGHTS, most=1.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses the classifier's fit, the fingerprints or the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
