"""Byte-level BPE through a sentencepiece model that is written from the ranks.

A rank file (base64 token, rank) becomes a sentencepiece BPE model without training:
byte b is the character U+0100 + b, a token is the piece of its bytes' characters,
its score is the negative rank, and the normaliser changes nothing.  The model's
best-scored merge is then the merge of lowest rank, and its ids are the ranks.  Texts
are split by the pattern into pre-tokens, each of which is encoded on its own; one
that is a token as a whole is that token.  Decoding maps ids to pieces and the pieces'
characters back to bytes.

Defined cases: a null text counts as empty and has no ids; control characters, text
that looks like a special token, and characters of any script are ordinary text; a
text of any length is encoded whole, as a bounded number of pre-tokens at a time;
rows that repeat an id or a text, and rows without an id, are encoded each on their
own; a tie between merges goes to the left one; null ids decode to no bytes, an id
that the vocabulary doesn't hold raises; an empty table gives no rows; columns beyond
those named, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pieces

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that are split at once; a longer text is split a quarter as many pre-tokens at a time.
AT_ONCE = 1 << 20
#: Pre-tokens that a task remembers, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 1 << 23
#: Bytes of decoded text that a task hands over together, or one row.
OUT_BYTES = 4 << 20
#: A piece's kind and a model's type in sentencepiece's file format (fixed values).
NORMAL, UNKNOWN, BPE = 1, 2, 2
_BYTE_OF = {0x100 + b: b for b in range(256)}


def mapped(raw: bytes) -> str:
    """Each byte as the character 0x100 above it."""
    return raw.decode("latin-1").translate(_CHARACTER_OF)


_CHARACTER_OF = {b: c for c, b in _BYTE_OF.items()}


def unmapped(piece: str) -> bytes:
    return piece.translate(_BYTE_OF).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol buffer: varint, 32-bit float, or bytes behind their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one more piece behind them is the unknown one."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))) or {bytes([b]) for b in range(256)} - ranks.keys():
        raise ValueError("ranks have to be 0, 1, ... and hold every single byte")
    if len(by_rank) > 1 << 24:
        raise ValueError("scores are floats, which tell at most 2**24 ranks apart")
    own = [_field(1, mapped(token).encode()) + _field(2, -float(rank)) + _field(3, NORMAL) for token, rank in by_rank]
    own.append(_field(1, b"<unk>") + _field(2, -float(len(by_rank))) + _field(3, UNKNOWN))
    as_it_is = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, no white space removed or escaped
    return b"".join(_field(1, piece) for piece in own) + _field(2, _field(3, BPE)) + _field(3, as_it_is)


class Codec:
    """Encodes and decodes with a serialised model."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern)
        self.tokens = [unmapped(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.whole = {token: struct.pack("<i", i) for i, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, parts: set[str]) -> None:
        """Ids of pre-tokens that aren't known yet, by one call of the model."""
        new = [p for p in parts if p not in self.known]
        raw = [p.encode() for p in new]
        rest = [b for b in raw if b not in self.whole]
        found = iter(self.model.encode([mapped(b) for b in rest], num_threads=1)) if rest else iter(())
        for p, b in zip(new, raw, strict=True):
            if b in self.whole:
                self.known[p] = self.whole[b]
            else:
                ids = next(found)
                self.known[p] = struct.pack(f"<{len(ids)}i", *ids)
        self.held += sum(map(len, new))

    def _forget(self) -> None:
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.known.clear()
            self.held = 0

    def encode(self, *texts: str) -> list[bytes]:
        """Ids of texts, as little-endian 32-bit integers; together they have some MB, or are one text of any length."""
        if len(texts) == 1 and len(texts[0]) > AT_ONCE:
            found, out = (m[0] for m in self.split.finditer(texts[0])), []
            while some := list(itertools.islice(found, AT_ONCE // 4)):
                self._learn(set(some))
                out.append(b"".join(map(self.known.__getitem__, some)))
                self._forget()
            return [b"".join(out)]
        parts = [self.split.findall(t) for t in texts]
        self._learn(set().union(*parts))
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        self._forget()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            raise ValueError("an id below 0")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def rust_pattern(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` as Unicode's white space, which is what they are for the rank files' splitter; Python adds U+001C to U+001F."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _encoding(model: bytes, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            for part in pieces(batch, "text", AT_ONCE):
                rows = codec.encode(*(t or "" for t in part.column("text").to_pylist()))
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
                ids = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "ids"])

    return run


def _decoding(model: bytes, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            ids, start, total, raw = batch.column("ids"), 0, 0, []
            for k in range(batch.num_rows + 1):
                if k == batch.num_rows or total > OUT_BYTES:
                    own = batch.slice(start, k - start)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("ids"), pa.array(raw, pa.binary())], ["doc_id", "ids", "raw"])
                    start, total, raw = k, 0, []
                if k < batch.num_rows:
                    raw.append(codec.decode(ids[k].values.to_numpy()) if ids[k].is_valid else b"")
                    total += len(raw[-1])

    return run


def _model(path: str | None) -> bytes:
    """About 1 MB for 50,000 tokens; it is made on the driver, so the executors need no rank file."""
    return serialise(read_ranks(path or public_tokenizers.path(RANKS)))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids: the ids of every text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_encoding(_model(ranks), rust_pattern(pattern)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """doc_id, ids, raw: the bytes that the ids stand for."""
    own = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(_decoding(_model(ranks), "."), "doc_id long, ids array<int>, raw binary")
