"""Readers and writers of series, spike times and results."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.series import TimeSeries


def read_series(spark: SparkSession, path: str, form: str = "parquet", normalise: bool = True, **columns: str) -> TimeSeries:
    """A table with proc, sample, value (and repl); other names are given as proc="...", and so on."""
    kinds = "proc int, repl int, sample int, value double"
    df = spark.read.parquet(path) if form == "parquet" else spark.read.schema(kinds).csv(path, header=True) if form == "csv" else spark.read.schema(kinds).json(path) if form == "json" else spark.read.orc(path)
    for want, have in columns.items():
        df = df.withColumnRenamed(have, want)
    return TimeSeries.from_frame(df, normalise)


def read_array(spark: SparkSession, path: str, dim_order: str = "psr", normalise: bool = True) -> TimeSeries:
    """A .npy array."""
    return TimeSeries.from_array(spark, np.load(path, allow_pickle=False), dim_order, normalise)


#: MATLAB's numeric kinds by their numbers in files of version 5 to 7 and of version 4 (fixed values).
_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_KINDS_4 = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}
_MATRIX, _COMPRESSED = 14, 15


def _elements(data: bytes, end: str) -> Iterator[tuple[int, bytes]]:
    """Kind and content of each element of a version 5 file or of a matrix in it."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{end}II", data, at)
        if kind >> 16:  # a short element holds its content in its head
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == _COMPRESSED else -size % 8)


def _matrices(data: bytes, end: str) -> Iterator[tuple[str, np.ndarray]]:
    """Name and values of each real numeric matrix."""
    for kind, content in _elements(data, end):
        if kind == _COMPRESSED:
            yield from _matrices(zlib.decompress(content), end)
        if kind != _MATRIX:
            continue
        flags, dims, name, *parts = _elements(content, end)
        what = struct.unpack_from(f"{end}I", flags[1])[0]
        if what & 0xFF in _CLASSES and not what & 0x800 and parts:
            values = np.frombuffer(parts[0][1], end + _KINDS[parts[0][0]]).astype(_CLASSES[what & 0xFF])
            yield name[1].decode(), values.reshape(np.frombuffer(dims[1], f"{end}i4"), order="F")


def _matrices_4(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    at = 0
    while at + 20 <= len(data):
        end = "<" if struct.unpack_from("<I", data, at)[0] < 5_000 else ">"
        kind, rows, columns, complex_, name = struct.unpack_from(f"{end}5I", data, at)
        of = np.dtype(end + _KINDS_4[kind // 10 % 10])
        begin = at + 20 + name
        size = rows * columns * of.itemsize
        if kind % 10 == 0 and not complex_:
            yield data[at + 20 : begin - 1].decode(), np.frombuffer(data[begin : begin + size], of).astype(of.newbyteorder("=")).reshape((rows, columns), order="F")
        at = begin + size * (2 if complex_ else 1)


def read_matlab(path: str, name: str) -> np.ndarray:
    """A real numeric array in a MATLAB file of any version; version 7.3 (HDF5) needs h5py, which the engine doesn't ship."""
    with open(path, "rb") as f:
        data = f.read()
    if b"\x89HDF" in (data[:4], data[512:516]):
        try:
            import h5py
        except ImportError as e:
            raise RuntimeError("MATLAB v7.3 files need h5py") from e
        with h5py.File(path) as f:
            return np.asarray(f[name]).T
    later = data[126:128] in (b"IM", b"MI")
    for found, values in _matrices(data[128:], "<" if data[126:128] == b"IM" else ">") if later else _matrices_4(data):
        if found == name:
            return values
    raise KeyError(name)


def read_trials(spark: SparkSession, path: str, struct: str, normalise: bool = True) -> tuple[TimeSeries, list[str], np.ndarray, int]:
    """Trials, channel labels, time stamps and sampling rate of an electrophysiology struct in a MATLAB v7.3 file."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("MATLAB v7.3 files need h5py") from e
    with h5py.File(path) as f:
        own = f[struct]
        trials = np.stack([np.asarray(f[r]).T for r in np.asarray(own["trial"]).ravel()], axis=2)
        labels = ["".join(map(chr, np.asarray(f[r]).ravel())) for r in np.asarray(own["label"]).ravel()]
        stamps = np.asarray(f[np.asarray(own["time"]).ravel()[0]]).ravel()
        rate = int(np.asarray(own["fsample"]).ravel()[0])
    return TimeSeries.from_array(spark, trials, "psr", normalise), labels, stamps, rate


def read_spikes(spark: SparkSession, path: str, proc: int = 0) -> DataFrame:
    """proc, t of a text file with one time per line."""
    return spark.read.text(path).select(F.lit(proc).alias("proc"), F.col("value").cast("double").alias("t")).where("t is not null")


def load_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def save_json(values: dict, path: str) -> None:
    """Arrays and numpy numbers become lists and numbers; keys are sorted."""
    plain = {k: v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v for k, v in values.items()}
    with open(path, "w") as f:
        json.dump(plain, f, sort_keys=True, indent=1)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)
