"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none and all runs in one
    process, as in tests; on a cluster that names none there is no folder to share.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
    own = os.path.join(tempfile.gettempdir(), "tidewire-shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes of an Arrow batch, about: 10,000 rows with texts or sets of shingles would be tens of MB, in an executor's JVM and in its Python workers.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most BATCH_BYTES, unless it names a size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_residue(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds at most ``most_bytes`` of text, or one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: ASCII letters in lower case, all other bytes unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The separators of words: space and 0x09 to 0x0D.
IS_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or what follows from it, as the name of no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
