"""Exact deduplication by Grace hashing.

Map side, each task folds its rows into an open-addressing table that compares
complete contents, and hands on one row per distinct text, so that a group of
copies, however large, leaves a task as one row.  The reduce side deals those
rows by digest and runs the Grace scheme: when a table outgrows its memory it is
cut into spill files by further digest bits, and each file is folded in turn.
Documents then meet their class by digest in a join whose large partitions Spark
can split.  Should two different texts share a digest, their rows meet by digest
and whole text.

Defined cases: null text counts as empty; empty texts are equal to one another;
the row with the largest ``doc_id`` stays, a null id counting as smaller than any
other (``exact_groups`` marks all rows of a group of null ids as kept, which their
ids don't tell apart); rows that repeat an id and a text get the same answer.  Of
rows that share the id and the text that stay, ``exact_dedup`` keeps the one whose
other columns, as JSON, sort first.  An empty table gives no rows; other columns are
ignored by ``exact_groups`` and handed through, whatever their names, by
``exact_dedup``.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import texts, written

#: Bytes of distinct content that a table may hold before it is handed on or spilled.
TABLE_BYTES = 96 << 20
_FANOUT_BITS = 4
_HEAD = "<Q?qqqi"

_DIGESTS: dict[str, tuple[Callable[[bytes], bytes], Callable]] = {
    "sha256": (lambda b: hashlib.sha256(b).digest(), lambda c: F.unhex(F.sha2(c, 256))),
    # a weak digest, for tests of what happens on collisions
    "crc32": (lambda b: zlib.crc32(b).to_bytes(8, "big"), lambda c: F.unhex(F.lpad(F.hex(F.crc32(c)), 16, "0"))),
}


class ContentTable:
    """Open addressing with linear probing; equality is that of the whole content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.rows: list[list] = []  # hash, content, digest, largest id (None: no row has one), count, count of the largest id
        self.bytes = 0

    def add(self, h: int, content: bytes, digest: bytes, top: int | None, count: int, tops: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[1] == content:
                row[4] += count
                if row[3] == top:
                    row[5] += tops
                elif row[3] is None or (top is not None and top > row[3]):
                    row[3], row[5] = top, tops
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([h, content, digest, top, count, tops])
        self.bytes += len(content) + 160
        if 2 * len(self.rows) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            at = row[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def drain(self) -> list[list]:
        rows, self.rows = self.rows, []
        self.slots, self.bytes = [-1] * 1024, 0
        return rows


def _read(path: str, digest: Callable[[bytes], bytes]) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(struct.calcsize(_HEAD)):
            h, known, top, count, tops, n = struct.unpack(_HEAD, head)
            content = f.read(n)
            yield h, content, digest(content), top if known else None, count, tops
    os.unlink(path)


def grace(rows: Iterable[tuple], digest: Callable[[bytes], bytes], folder: str, most: int, level: int = 0) -> Iterator[list[list]]:
    """Fold ``rows`` (hash, content, digest, top id, count, count of the top id); yields lists of folded rows.

    All rows of one hash come in one list.  Buckets are cut by the hash's high bits,
    four per level; when the 64 bits are used up, equal hashes are folded in memory.
    """
    held, files = ContentTable(), None

    def spill() -> None:
        for row in held.drain():
            f = files[row[0] >> (64 - _FANOUT_BITS * (level + 1)) & (1 << _FANOUT_BITS) - 1]
            f.write(struct.pack(_HEAD, row[0], row[3] is not None, row[3] or 0, row[4], row[5], len(row[1])) + row[1])

    for row in rows:
        held.add(*row)
        if held.bytes > most and _FANOUT_BITS * (level + 1) <= 64:
            if files is None:
                made = [tempfile.mkstemp(dir=folder) for _ in range(1 << _FANOUT_BITS)]
                files, paths = [os.fdopen(fd, "wb") for fd, _ in made], [path for _, path in made]
            spill()
    if files is None:
        yield held.drain()
        return
    spill()
    for f in files:
        f.close()
    for path in paths:
        yield from grace(_read(path, digest), digest, folder, most, level + 1)


_FOLDED = "digest binary, content binary, top long, n long, tops long"
_CLASSES = "digest binary, class_content binary, keep_id long, group_size long, keep_rows long, n_classes int"


def _folder(digest_name: str, most: int) -> Callable:
    digest = _DIGESTS[digest_name][0]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable()

        def out() -> pa.RecordBatch:
            rows = held.drain()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5))],
                ["digest", "content", "top", "n", "tops"],
            )

        for batch in batches:
            for top, content in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                d = digest(content)
                held.add(int.from_bytes(d[:8], "big"), content, d, top, 1, 1)
                if held.bytes > most:
                    yield out()
        if held.rows:
            yield out()

    return fold


def _reducer(digest_name: str, most: int) -> Callable:
    digest = _DIGESTS[digest_name][0]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for d, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield int.from_bytes(d[:8], "big"), rest[0], d, *rest[1:]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            for folded in grace(rows(batches), digest, folder, most):
                classes = Counter(r[2] for r in folded)
                for at in range(0, len(folded), 10_000):
                    part = folded[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[2] for r in part], pa.binary()),
                            pa.array([r[1] if classes[r[2]] > 1 else None for r in part], pa.binary()),
                            *(pa.array([r[k] for r in part], pa.int64()) for k in (3, 4, 5)),
                            pa.array([classes[r[2]] for r in part], pa.int32()),
                        ],
                        ["digest", "class_content", "keep_id", "group_size", "keep_rows", "n_classes"],
                    )

    return reduce


def _classes(own: DataFrame, digest: str, table_bytes: int) -> DataFrame:
    """One row per distinct text of ``own`` (id, text), written."""
    return written(own.mapInArrow(_folder(digest, table_bytes), _FOLDED).repartition("digest").mapInArrow(_reducer(digest, table_bytes), _CLASSES), "exact-classes")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: str = "sha256", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary).

    ``digest`` picks the join key; ``table_bytes`` bounds a task's content table.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = _DIGESTS[digest][1]
    classes = _classes(own, digest, table_bytes).drop("keep_rows")
    whole = own.select("doc_id", key(F.col("text").cast("binary")).alias("digest"))
    met = whole.join(classes.where("n_classes = 1").drop("class_content", "n_classes"), "digest")
    shared = classes.where("n_classes > 1")
    if not shared.isEmpty():
        both = own.withColumn("digest", key(F.col("text").cast("binary"))).withColumn("class_content", F.col("text").cast("binary"))
        met = met.unionByName(both.join(shared.drop("n_classes"), ["digest", "class_content"]).drop("class_content", "text"))
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: str = "sha256", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group.

    Rows meet their class in one join; only rows that repeat the id and the text that
    stay are dealt out once more.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = _classes(own, digest, table_bytes).select(*(F.col(c).alias(f"__tw_{c}") for c in ("digest", "class_content", "keep_id", "keep_rows", "n_classes")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__tw_row"), _DIGESTS[digest][1](F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__tw_digest"))
    of = F.col("__tw_row").getField
    content = F.coalesce(of(text_col), F.lit("")).cast("binary")
    meets = F.col("__tw_n_classes") == 1
    if not classes.where(~meets).isEmpty():
        meets = meets | (content == F.col("__tw_class_content"))
    met = rows.join(classes, "__tw_digest").where(meets & of(id_col).cast("long").eqNullSafe(F.col("__tw_keep_id")))
    once = met.where("__tw_keep_rows = 1").select("__tw_row")
    if not classes.where("__tw_keep_rows > 1").isEmpty():
        others = [of(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (id_col, text_col)]
        first = F.min_by("__tw_row", F.to_json(F.struct(*others)) if others else F.lit(0))
        many = met.where("__tw_keep_rows > 1").groupBy("__tw_digest", F.col("__tw_class_content")).agg(first.alias("__tw_row"))
        once = once.unionByName(many.select("__tw_row"))
    return once.select("__tw_row.*")
