"""Substring deduplication by difference-cover anchors.

Let D be a difference cover modulo v: every residue is a difference of two of its
members.  For any two positions some shift below v brings both onto positions whose
residues are in D.  So if two documents share ``window`` words, they share an
aligned run of ``window - v + 1`` words, an anchor, and only anchors at cover
positions are hashed: 6 of 31 positions.

1. Anchors that occur in more than one document are found from 64-bit hashes alone;
   anchors that only collide cost time and decide nothing.
2. Matches are extended from them: a window can be shared only if an anchor in it
   is, so only such windows are looked at, and the smallest document of each is
   found.  Windows are equal when 128 bits of the sha256 of their words are, which no
   two different word sequences are known to share.
3. Words covered by a window that a smaller document has are removed.

Keys go to their bucket packed, a document's together, and what is equal inside a
batch is settled there: one report for the batch goes out, however many documents
share a passage, so a passage that much of the corpus has isn't one task's work.
Answers about anchors come back by hash, those about windows as runs of words, with a
tag of the text where rows share an id.

Defined cases: null texts have no words; texts shorter than a window keep all
words; windows repeated only inside one document stay; rows without an id neither
lose words nor cause others to; rows that share an id don't cause each other to
lose words; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pieces, texts
from tidewire.llm.words import Hasher, Words, mix

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
#: Bytes of text per bucket: a bucket's keys are held by one task, so their number follows the input.
BUCKET_BYTES = 16 << 20
_REPORT, _ANSWER = 0, 1
_RUN = np.dtype([("tag", "<u8"), ("at", "<u4"), ("many", "<u4")])
_ROW = "bucket int, kind int, payload binary"


def _pack(docs: np.ndarray, hashes: np.ndarray) -> bytes:
    """Documents (sorted) with their hashes: count, ids, how many each, hashes."""
    ids, first = np.unique(docs, return_index=True)
    each = np.diff([*first, len(docs)])
    return np.array([len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + each.astype("<i8").tobytes() + hashes.astype("<u8").tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    ids = np.frombuffer(payload, "<i8", n, 8)
    each = np.frombuffer(payload, "<i8", n, 8 + 8 * n)
    return np.repeat(ids, each), np.frombuffer(payload, "<u8", -1, 8 + 16 * n)


def _once(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) in that order."""
    order = np.lexsort((docs, hashes))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def _split(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes, the first place and the length of each run."""
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
    return first, np.diff([*first, len(hashes)])


def _sent(docs: np.ndarray, hashes: np.ndarray, settled: np.ndarray, report: np.ndarray, buckets: int, turn: int) -> pa.RecordBatch:
    """Reports to the bucket of their hash, and what the batch has settled to a bucket in turn."""
    rows = []
    d, h = docs[report], hashes[report]
    b = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((h, d, b))
    d, h, b = d[order], h[order], b[order]
    first, count = _split(b)
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        rows.append((int(b[a]), _REPORT, _pack(d[a : a + n], h[a : a + n])))
    if settled.any():
        d, h = docs[settled], hashes[settled]
        order = np.lexsort((h, d))
        rows.append((turn % buckets, _ANSWER, _pack(d[order], h[order])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


@dataclass
class Windows:
    """Windows by document, tag of its text and first word; ``keys`` (two lanes each) are left out where they have served."""

    docs: np.ndarray
    tags: np.ndarray
    at: np.ndarray
    keys: np.ndarray | None

    def __getitem__(self, which: np.ndarray) -> Windows:
        return Windows(self.docs[which], self.tags[which], self.at[which], None if self.keys is None else self.keys[which])

    def pack(self) -> bytes:
        """Sorted by document and tag: counts of groups and lanes, then ids, tags and sizes of groups, first words, keys."""
        new = np.ones(len(self.docs), dtype=bool)
        new[1:] = (self.docs[1:] != self.docs[:-1]) | (self.tags[1:] != self.tags[:-1])
        first = np.flatnonzero(new)
        head = np.array([len(first), 0 if self.keys is None else 2], "<i8").tobytes()
        groups = self.docs[first].astype("<i8").tobytes() + self.tags[first].astype("<u8").tobytes() + np.diff([*first, len(new)]).astype("<i8").tobytes()
        return head + groups + self.at.astype("<u4").tobytes() + (b"" if self.keys is None else self.keys.astype("<u8").tobytes())

    @staticmethod
    def unpack(payload: bytes) -> Windows:
        n, lanes = np.frombuffer(payload, "<i8", 2).tolist()
        each = np.frombuffer(payload, "<i8", n, 16 + 16 * n)
        docs, tags = (np.repeat(np.frombuffer(payload, kind, n, 16 + 8 * n * k), each) for k, kind in enumerate(("<i8", "<u8")))
        at = np.frombuffer(payload, "<u4", len(docs), 16 + 24 * n)
        keys = np.frombuffer(payload, "<u8", -1, 16 + 24 * n + 4 * len(docs)).reshape(-1, lanes) if lanes else None
        return Windows(docs, tags, at, keys)

    @staticmethod
    def joined(parts: list[Windows]) -> Windows:
        keys = None if any(p.keys is None for p in parts) else np.concatenate([np.zeros((0, 2), dtype=np.uint64), *(p.keys for p in parts)])
        of = lambda name, kind: np.concatenate([np.zeros(0, dtype=kind), *(getattr(p, name) for p in parts)])
        return Windows(of("docs", np.int64), of("tags", np.uint64), of("at", np.uint32), keys)


def by_key(found: Windows) -> tuple[Windows, np.ndarray]:
    """Windows in the order of keys and documents, and whether each one's document is the smallest with its key."""
    found = found[np.lexsort((found.at, found.tags, found.docs, found.keys[:, 1], found.keys[:, 0]))]
    new = np.ones(len(found.docs), dtype=bool)
    new[1:] = (found.keys[1:] != found.keys[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    least = np.repeat(found.docs[first], np.diff([*first, len(new)]))
    return found, found.docs == least


def window_keys(w: Words, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits of the sha256 of the words (joined by one space) of the window from each word of ``at`` on."""
    data, sha256 = memoryview(w.data), hashlib.sha256
    spans = zip(w.starts[at].tolist(), w.ends[at + window - 1].tolist(), strict=True)
    return np.frombuffer(b"".join([sha256(data[a:b]).digest()[:16] for a, b in spans]), "<u8").reshape(-1, 2)


def cover_positions(w: Words) -> np.ndarray:
    """Words at which an anchor begins: the residue of the place in its text is in the cover."""
    place = np.arange(len(w)) - w.first[w.doc]
    return np.flatnonzero(np.isin(place % PERIOD, COVER))


def _anchors(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    at = cover_positions(w)
    at = at[w.within(at, length)]
    return at, w.hashes(at, length)


def _anchor_map(buckets: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, turn = Hasher(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                w = Words(texts(part.column("text")), hasher)
                at, h = _anchors(w, window - PERIOD + 1)
                docs, h = _once(part.column("doc_id").to_numpy(zero_copy_only=False)[w.doc[at]], h)
                first, count = _split(h)
                many = np.repeat(count > 1, count)
                ends = np.zeros(len(h), dtype=bool)  # of what many documents share, the first and last document speak for all
                ends[first] = ends[first + count - 1] = True
                turn += 1
                yield _sent(docs, h, many, ends, buckets, turn * 7919 + (int(docs[0]) if len(docs) else 0))

    return run


def text_tags(own: list[bytes]) -> np.ndarray:
    """Tells apart the texts of rows that share an id."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def _windows_sent(found: Windows, least: np.ndarray, buckets: int, turn: int) -> pa.RecordBatch:
    """Windows of smallest documents to the bucket of their key; the others, which the batch has settled, to a bucket in turn."""
    rows = []
    report = found[least]
    bucket = (report.keys[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((report.at, report.tags, report.docs, bucket))
    report, bucket = report[order], bucket[order]
    for a, n in zip(*(x.tolist() for x in _split(bucket)), strict=True):
        rows.append((int(bucket[a]), _REPORT, report[np.arange(a, a + n)].pack()))
    rest = Windows(found.docs[~least], found.tags[~least], found.at[~least], None)
    if len(rest.docs):
        rows.append((turn % buckets, _ANSWER, rest[np.lexsort((rest.at, rest.tags, rest.docs))].pack()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])


def _window_map(buckets: int, window: int) -> Callable:
    length = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, turn = Hasher(), 0
        for batch in batches:
            for part in pieces(batch, "text"):
                own = texts(part.column("text"))
                w = Words(own, hasher)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                at, h = _anchors(w, length)
                shared = np.zeros(len(at), dtype=bool)
                begin = np.searchsorted(at, w.first)
                for d, told in enumerate(part.column("found").to_pylist()):
                    mine = slice(begin[d], begin[d + 1])
                    shared[mine] = np.isin(h[mine], np.frombuffer(told, "<u8"))
                # a window from s on holds the anchors that begin in [s, s + PERIOD); one must be shared
                known = np.zeros(len(w) + 1, dtype=np.int64)
                known[at[shared] + 1] = 1
                known = np.cumsum(known)
                s = np.arange(len(w))
                s = s[w.within(s, window)]
                s = s[known[s + PERIOD] > known[s]]
                tags = text_tags(own)
                found, least = by_key(Windows(ids[w.doc[s]], tags[w.doc[s]], (s - w.first[w.doc[s]]).astype(np.uint32), window_keys(w, s, window)))
                turn += 1
                yield _windows_sent(found, least, buckets, turn * 7919 + (int(ids[0]) if len(ids) else 0))

    return run


def _place(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _reduce(buckets: int) -> Callable:
    """Per anchor, answer the documents that share it, packed by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]) for kind in (_REPORT, _ANSWER)}
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                docs, hashes = _unpack(payload)
                held[kind][0].append(docs)
                held[kind][1].append(hashes)
        docs, hashes = _once(*map(np.concatenate, held.pop(_REPORT)))
        first, count = _split(hashes)
        told = np.repeat(count > 1, count)
        docs = np.concatenate([docs[told], *held[_ANSWER][0]])
        hashes = np.concatenate([hashes[told], *held[_ANSWER][1]])
        if not len(docs):
            return
        place = _place(docs, buckets)
        order = np.lexsort((hashes, docs, place))
        place, docs, hashes = place[order], docs[order], hashes[order]
        for a, n in zip(*(x.tolist() for x in _split(place)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(place[a])], pa.int32()), pa.array([_pack(docs[a : a + n], hashes[a : a + n])], pa.binary())], ["bucket", "payload"])

    return run


def _reduce_windows(buckets: int) -> Callable:
    """Tell documents their windows that smaller documents have, packed by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Windows]] = {_REPORT: [], _ANSWER: []}
        for batch in batches:
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                held[kind].append(Windows.unpack(payload))
        found, least = by_key(Windows.joined(held.pop(_REPORT)))
        rest = Windows.joined([Windows(found.docs[~least], found.tags[~least], found.at[~least], None), *held[_ANSWER]])
        place = _place(rest.docs, buckets)
        order = np.lexsort((rest.at, rest.tags, rest.docs, place))
        place, rest = place[order], rest[order]
        for a, n in zip(*(x.tolist() for x in _split(place)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(place[a])], pa.int32()), pa.array([rest[np.arange(a, a + n)].pack()], pa.binary())], ["bucket", "payload"])

    return run


def _gather_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's windows as runs (tag, first word of the first window, windows), in one row."""
    found = Windows.joined([Windows.unpack(payload) for batch in batches for payload in batch.column("payload").to_pylist()])
    found = found[np.lexsort((found.at, found.tags, found.docs))]
    new = np.ones(len(found.docs), dtype=bool)
    new[1:] = (found.docs[1:] != found.docs[:-1]) | (found.tags[1:] != found.tags[:-1]) | (found.at[1:] > found.at[:-1] + 1)
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(new))[: len(run)] - 1
    runs = np.zeros(len(run), dtype=_RUN)
    runs["tag"], runs["at"], runs["many"] = found.tags[run], found.at[run], found.at[last] - found.at[run] + 1
    docs = found.docs[run]
    first, count = _split(docs)
    for k in range(0, len(first), 2_000):
        part = list(zip(first[k : k + 2_000].tolist(), count[k : k + 2_000].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in part], pa.int64()), pa.array([runs[a : a + n].tobytes() for a, n in part], pa.binary())], ["doc_id", "found"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's answers from all buckets as one row."""
    got = [_unpack(payload) for batch in batches for payload in batch.column("payload").to_pylist()]
    if not got:
        return
    docs, hashes = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    first, count = _split(docs)
    for k in range(0, len(first), 2_000):
        part = list(zip(first[k : k + 2_000].tolist(), count[k : k + 2_000].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in part], pa.int64()), pa.array([hashes[a : a + n].astype("<u8").tobytes() for a, n in part], pa.binary())], ["doc_id", "found"])


def _final(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                own = texts(part.column("text"))
                w = Words(own)
                tags = text_tags(own)
                n, removed, digests, kept_texts = [], [], [], []
                for d, found in enumerate(part.column("found").to_pylist()):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    keep = None
                    if found:
                        runs = np.frombuffer(found, _RUN)
                        runs = runs[runs["tag"] == tags[d]]
                        delta = np.zeros(b - a + 1, dtype=np.int64)
                        np.add.at(delta, runs["at"], 1)
                        np.add.at(delta, runs["at"] + runs["many"].astype(np.int64) - 1 + window, -1)
                        keep = np.cumsum(delta)[:-1] == 0
                    kept = w.joined(d, keep)
                    n.append(b - a)
                    removed.append(0 if keep is None else int((~keep).sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode())
                out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_texts if with_text else digests, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_shared(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces; or the sha256 of that)."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    some = own.where("doc_id is not null and text is not null")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def told(sent: DataFrame, reduce: Callable, gather: Callable) -> DataFrame:
        """doc_id, found: what is told to a document."""
        back = sent.repartition(buckets, "bucket").mapInArrow(reduce, "bucket int, payload binary")
        return back.repartition(buckets, "bucket").mapInArrow(gather, "doc_id long, found binary")

    shared = told(some.mapInArrow(_anchor_map(buckets, window), _ROW), _reduce(buckets), _gather)
    # Both joins deal out the same rows, so Spark shuffles the texts once for the two.  The merge join brings
    # documents in the order of their ids, so that a task that runs again makes the same batches.
    near = some.hint("merge").join(shared, "doc_id")
    covered = told(near.select("doc_id", "text", "found").mapInArrow(_window_map(buckets, window), _ROW), _reduce_windows(buckets), _gather_windows)
    met = some.hint("merge").join(covered, "doc_id", "left").select("doc_id", "text", "found")
    rest = own.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast("binary").alias("found"))
    kind = "doc_id long, n_words long, n_removed long, kept string"
    return met.mapInArrow(_final(window, with_text), kind).unionByName(rest.mapInArrow(_final(window, with_text), kind))
