"""Bounded samples of labelled rows, dealt by a hash of the id.

Defined cases: rows without an id or a label are never sampled; an id counts once per
label, however many rows repeat it; of texts that share an id the one that sorts first
stands for all; labels are as many as the rows have, none is left out for being rare;
an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels whose counts are broadcast, at most; more are joined.
FEW_LABELS = 100_000


def class_sample(rows: DataFrame, id_col: str, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` ids of each label with their rows (all of labels with fewer rows).

    Rows whose hashed id falls below the label's share stay, so no sort or shuffle of
    rows is needed and the sample doesn't depend on partitions.  The share is of rows,
    so ids that many rows repeat make the sample smaller, never larger.
    """
    own = rows.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    counts = own.groupBy(label).agg(F.count("*").alias("__tw_n"))
    if counts.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        counts = F.broadcast(counts)
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return own.join(counts, label).where(unit < F.lit(float(per_class)) / F.col("__tw_n")).select(*rows.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """text, label (0 or 1) of a bounded sample of labelled rows.

    The labels are sampled first; about twice ``per_label`` ids and labels are what
    is broadcast, so no text is dealt out to find its label.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    sample = class_sample(rows, "id", "label", per_label).distinct()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label")
