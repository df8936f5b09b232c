"""Tables that cut lineage, written below ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where the session names none and runs in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
    own = os.path.join(tempfile.gettempdir(), "tidewire-shared")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written in the shared folder and read again: lineage ends there, and rows stay where they were dealt."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
