"""Best-fit packing planned on the histogram of lengths.

Texts are tokenised once, cut into pieces of at most the capacity, and the pieces'
lengths counted.  The plan is best-fit decreasing over those counts: it is made of
runs of sequences that are filled alike, so its size depends on the capacity and
not on the corpus.  A piece's rank within its length (a bucket's offset and the
place in the bucket) leads it to its planned slot.  A length has as many buckets as
its count asks for, so that a frequent length is spread over many tasks, and there are
at most ``BUCKETS`` + ``capacity`` of them, a row of offsets each.

Defined cases: null texts count as empty; an empty text is its end token alone;
rows that repeat an id or a text, and rows without an id, are packed each on their
own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.common import pieces as parts
from tidewire.llm.common import written

CAPACITY = 1_024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length that are ranked together: as many as give BUCKETS buckets, BUCKET_PIECES at least.
BUCKETS = 1 << 17
BUCKET_PIECES = 1 << 10
#: UTF-8 lead bytes from here on begin characters from U+0580 on.
_RARE_FROM = 0xD6


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    Texts of Latin, Greek and Cyrillic letters without special tokens go through
    tiktoken with the same vocabulary, which gives the same ids several times as
    fast; all others go through tokenizers.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            found = json.load(f)
        self.special = [t["content"] for t in found.get("added_tokens", ())]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
        ranks = {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        raw = text.encode()
        if (not text.isascii() and bool((np.frombuffer(raw, np.uint8) >= _RARE_FROM).any())) or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: whole ones behind a first one that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, turn = Encoder(path), 0
        for batch in batches:
            for part in parts(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    turn += 1
                    for k, (at, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes()), turn))
                own = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "turn"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, offset).

    Pieces of the length with ranks from first to end take consecutive sequences.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # by space left: runs of sequences (first, how many)
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = min((r for r in room if r >= length), default=capacity)
            if space in room and room[space]:
                first, many = room[space].pop()
                if not room[space]:
                    del room[space]
            else:
                first, many = sequences, -(-left // (capacity // length))
                sequences += many
            fit = space // length
            used, each = (min(many, left // fit), fit) if left >= fit else (1, left)
            for k in range(each):
                out.append((length, rank, rank + used, first, capacity - space + k * length))
                rank += used
            left -= used * each
            if space > each * length:
                room.setdefault(space - each * length, []).append((first, used))
            if many > used:
                if first + many == sequences and space == capacity:
                    sequences = first + used  # sequences that were only just begun
                else:
                    room.setdefault(space, []).append((first + used, many - used))
    return out


def tokenised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and turn, a number that repeated rows differ in."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    return own.mapInArrow(_tokenise(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, turn long")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES, **options) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    found = written(tokenised(docs, capacity=capacity, **options), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").agg(F.count("*")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first_rank long, end_rank long, first_sequence long, offset long")
    each = max(bucket_pieces, -(-sum(counts.values()) // BUCKETS))
    buckets = {n: -(-many // each) for n, many in counts.items()}
    of_length = F.split(F.lit(",".join(str(buckets.get(n, 1)) for n in range(capacity + 1))), ",").cast("array<long>")[F.col("length").cast("int")]
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "turn"), of_length))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "turn")
    ranked = found.withColumn("place", F.row_number().over(place) - 1).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("place"))
    met = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
