"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has a bit for each bit of its shingles' hashes, set if most shingles
have it set.  Postings are keyed by bytes and their positions.  A posting list of
one positional byte would hold a fixed share of the corpus, so lists are kept for
triples of positions; with 8 bytes and at most 4 differing bits at least 4 bytes
are equal, and the 20 triples used meet every set of 4 positions, so no link is
lost.  Within a list the equal positional bytes of pairs are tallied, pairs that
reach the minimum are verified on all bits, and a list gives spanning links only:
a search goes from node to node and compares each with the nodes not reached yet,
so that a group of n copies gives n - 1 links and never all pairs.  A very long
list is dealt out once more by one further equal byte, which the tally guarantees.

Similar texts (five words, Jaccard similarity 0.8) have 256 bits in the same index.
There equal bytes are likely and not guaranteed, so lists are kept for pairs of
positions, 48 of them, which meet every set of 9 of the 32 positions.  What the index
links is compared on whole sets of shingles, and the pairs that it leaves are found by
an exact join of the shingles, see ``jaccard``: none is lost, no dissimilar one linked.

Defined cases: texts with fewer words than a shingle have one shingle, the whole
sequence; texts without words, and null texts, have fingerprint zero and are linked
like any other; rows without an id are not linked; rows that share an id are one
document; repeated rows have equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER, bounded_batches, pieces, texts, written
from tidewire.llm.components import components
from tidewire.llm.jaccard import _each_set, similar_links
from tidewire.llm.words import Words, mix

SEED = 42
#: Lists longer than this are split by one further byte before nodes are compared.
LONG_LIST = 20_000
#: Lists up to this long are searched only if any two of their nodes compare, and pairs that are compared at once.
SHORT_LIST, PAIRS_AT_ONCE = 256, 1 << 16
#: Nodes that are looked at to find long lists, and keys of these that are broadcast, at most.
SAMPLE_NODES, FEW_KEYS = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Near:
    """What is linked: words in a shingle, 64-bit parts of a fingerprint, differing bits at most, equal bytes at least."""

    shingle: int
    parts: int
    most_bits: int
    least_bytes: int

    @property
    def keys(self) -> list[tuple[int, ...]]:
        """The positions whose bytes make a key."""
        return turan_triples() if self.parts == 1 else turan_pairs(8 * self.parts)


def turan_triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions hold one.

    Positions are in three classes A, B, C of 3, 3 and 2; taken are the triples
    within a class and those with two positions of one class and one of the next.
    """
    own = [(0, 1, 2), (3, 4, 5), (6, 7)]
    where = {p: c for c, members in enumerate(own) for p in members}
    out = []
    for t in combinations(range(8), 3):
        count = [sum(where[p] == c for p in t) for c in range(3)]
        if 3 in count or any(count[c] == 2 and count[(c + 1) % 3] == 1 for c in range(3)):
            out.append(t)
    return out


def turan_pairs(positions: int) -> list[tuple[int, int]]:
    """The pairs within classes of four positions: any set with more positions than there are classes holds one."""
    return [pair for first in range(0, positions, 4) for pair in combinations(range(first, first + 4), 2)]


#: The contract: 4-word shingles, 64 bits, at most 4 of them different.
EXACT = Near(shingle=4, parts=1, most_bits=4, least_bytes=4)
#: Words in a shingle where the Jaccard similarity of the shingles decides.
SIMILAR = 5
#: Fingerprints of sets of shingles that are likely similar: at 0.8, arccos(8 / 9) / pi of 256 bits, 39 in the mean, differ.
LIKELY = Near(shingle=SIMILAR, parts=4, most_bits=56, least_bytes=4)

_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def fingerprints_of(batch: list[bytes], shingle: int, parts: int) -> np.ndarray:
    """One row of ``parts`` unsigned 64-bit numbers per text."""
    n = len(batch)
    w = Words([t.translate(LOWER) for t in batch])
    counts = np.diff(w.first)
    many = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n), many)
    begin = np.concatenate([[0], np.cumsum(many)])
    at = w.first[doc] + np.arange(len(doc)) - begin[doc]
    last = np.minimum(at + shingle, w.first[doc + 1]) - 1
    data, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[s:e], SEED) for s, e in zip(w.starts[at].tolist(), w.ends[last].tolist(), strict=True)), np.uint64, len(doc))
    return majorities(h, doc, many, parts)


def majorities(h: np.ndarray, doc: np.ndarray, many: np.ndarray, parts: int) -> np.ndarray:
    """The bits that over half of each text's ``many`` hashes have set; ``h`` are the hashes of the texts ``doc``."""
    n = len(many)
    out = np.zeros((n, parts), dtype=np.uint64)
    for part in range(parts):
        if part:
            h = mix(h ^ np.uint64(0xA0761D6478BD642F))
        for byte in range(8):
            seen = np.bincount(doc * 256 + (h >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64), minlength=n * 256).reshape(n, 256)
            bits = 2 * (seen @ _BITS) > many[:, None]
            for bit in range(8):
                out[:, part] |= bits[:, bit].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprint(near: Near) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                f = fingerprints_of(texts(part.column("text")), near.shingle, near.parts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(f[:, k]) for k in range(near.parts))], ["doc_id", *(f"f{k}" for k in range(near.parts))])

    return run


def fingerprints(docs: DataFrame, near: Near, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and the fingerprint's parts as f0, f1, ..."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprint(near), "doc_id long, " + ", ".join(f"f{k} long" for k in range(near.parts)))


def _compare(a: np.ndarray, b: np.ndarray, near: Near) -> np.ndarray:
    """Whether fingerprints (rows of parts) share enough positional bytes and differ in few enough bits."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(len(x), -1) == 0).sum(axis=1)
    out = shared >= near.least_bytes
    out[out] = np.bitwise_count(x[out]).sum(axis=1, dtype=np.int64) <= near.most_bits
    return out


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def span(nodes: np.ndarray, f: np.ndarray, near: Near) -> list[np.ndarray]:
    """Spanning links (u, v, differing bits) of the components of one list, each from the node that reached the other."""
    links = []
    order = np.argsort(nodes, kind="stable")
    nodes, f = nodes[order], f[order]
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            k = todo.pop()
            hit = _compare(f[rest], f[k], near)
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                todo += new.tolist()
                links.append(np.stack([np.full(len(new), nodes[k]), nodes[new], _bits(f[new], f[k])]))
    return links


def _met(cut: np.ndarray, size: np.ndarray, f: np.ndarray, near: Near) -> np.ndarray:
    """Whether any two nodes of each list compare; lists that aren't short pass."""
    out = size > SHORT_LIST
    for n in np.unique(size[(size > 1) & ~out]).tolist():
        i, j = np.triu_indices(n, 1)
        of = np.flatnonzero(size == n)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(of), step):
            first = cut[of[k : k + step], None]
            out[of[k : k + step]] = _compare(f[(first + i).ravel()], f[(first + j).ravel()], near).reshape(len(first), -1).any(axis=1)
    return out


def _link(near: Near) -> Callable:
    columns = ["key", "node", *(f"f{k}" for k in range(near.parts))]
    own = len(near.keys[0])

    def lists(rows: np.ndarray) -> np.ndarray:
        """Links of whole lists; rows are sorted by key."""
        key, node, f = rows[0], rows[1], np.ascontiguousarray(rows[2:].T).view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff([*cut, len(key)])
        two = cut[size == 2]
        good = two[_compare(f[two], f[two + 1], near)] if len(two) else two
        links = [np.stack([np.minimum(node[good], node[good + 1]), np.maximum(node[good], node[good + 1]), _bits(f[good], f[good + 1])])]
        cut, size = cut[size > 2], size[size > 2]
        met = _met(cut, size, f, near)
        for a, n in zip(cut[met].tolist(), size[met].tolist(), strict=True):
            if n <= LONG_LIST or near.least_bytes <= own:  # where the key's bytes are all that is guaranteed, no further one is
                links += span(node[a : a + n], f[a : a + n], near)
                continue
            each = f[a : a + n].view(np.uint8).reshape(n, -1)
            for position in range(each.shape[1]):
                if (each[:, position] == each[0, position]).all():
                    continue  # a position of the key, or of all the list
                by = np.argsort(each[:, position], kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(each[by, position])) + 1):
                    links += span(node[a : a + n][part], f[a : a + n][part], near)
            same = (each == each[0]).all(axis=0).sum()
            if same >= near.least_bytes:  # all pairs reach the tally without a further byte
                links += span(node[a : a + n], f[a : a + n], near)
        return np.concatenate(links, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(columns), 0), dtype=np.int64)
        for batch in batches:
            held = np.hstack([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])])
            if not held.shape[1]:
                continue
            whole = int(np.searchsorted(held[0], held[0, -1]))  # the last list may go on
            if whole:
                found = lists(held[:, :whole])
                held = held[:, whole:]
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["u", "v", "bits"])
        if held.shape[1] > 1:
            found = lists(held)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["u", "v", "bits"])

    return run


def _long_keys(keyed: DataFrame, n: int) -> DataFrame | None:
    """Keys whose lists are longer than LONG_LIST, by a sample of the nodes; the sample decides on speed, never on links."""
    if n <= LONG_LIST:
        return None
    share = min(1.0, SAMPLE_NODES / n)
    unit = F.pmod(F.xxhash64("node", F.lit(31)), F.lit(1 << 30))
    seen = keyed.where(unit < F.lit(int(share * (1 << 30)))).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, LONG_LIST * share))
    # lists of LONG_LIST nodes and more: at most 20 n / LONG_LIST in truth, and no more than the sample has rows
    return written(seen.select("key"), "long-lists")


def near_links(nodes: DataFrame, near: Near) -> DataFrame:
    """Spanning links (u, v, bits that differ) between nodes (node, f0, ...).

    A long list is dealt out once more by one further equal byte, which the tally
    guarantees, so that it isn't one task's work.
    """
    parts = [f"f{k}" for k in range(near.parts)]
    byte = [F.shiftrightunsigned(f"f{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255)) for p in range(8 * near.parts)]

    def key(t: int, positions: tuple[int, ...]) -> Column:
        out = F.lit(t).cast("long")
        for p in positions:
            out = F.shiftleft(out, 8).bitwiseOR(byte[p])
        return F.shiftleft(out, 16)

    def further(p: int) -> Column:
        """The key with the byte at p; null where p is one of the key's own positions."""
        return F.when(F.col("own").bitwiseAND(F.lit(1 << p).cast("long")) == 0, F.col("key").bitwiseOR(F.lit((p + 1) << 8).cast("long")).bitwiseOR(byte[p]))

    keys = [F.struct(key(t, positions).alias("key"), F.lit(sum(1 << p for p in positions)).cast("long").alias("own")) for t, positions in enumerate(near.keys)]
    postings = nodes.select(F.explode(F.array(*keys)).alias("e"), "node", *parts).select("e.key", "e.own", "node", *parts)
    if near.least_bytes > len(near.keys[0]) and (long := _long_keys(postings.select("key", "node"), nodes.count())) is not None:
        if long.count() <= FEW_KEYS:
            long = F.broadcast(long)
        met = postings.join(long.withColumn("long", F.lit(True)), "key", "left")
        postings = met.select(F.explode(F.when(F.col("long"), F.array_compact(F.array(*(further(p) for p in range(len(byte)))))).otherwise(F.array("key"))).alias("key"), "node", *parts)
    return postings.select("key", "node", *parts).repartition("key").sortWithinPartitions("key").mapInArrow(_link(near), "u long, v long, bits long")


def near_components(docs: DataFrame, near: Near = EXACT, **columns: str) -> DataFrame:
    """doc_id, f0, ..., component_id (the smallest doc_id reachable, itself included)."""
    parts = [f"f{k}" for k in range(near.parts)]
    found = written(fingerprints(docs, near, **columns), "fingerprints")
    nodes = found.where("doc_id is not null").groupBy(*parts).agg(F.min("doc_id").alias("node"))
    of_node = components(near_links(nodes, near))
    classes = nodes.join(of_node, "node", "left").select(*(F.bitwise_not(p).alias(f"n{p}") for p in parts), F.coalesce("component", "node").alias("component_id"))
    # keyed by the inverted parts, so that both sides are dealt for this join and Spark can split a frequent fingerprint
    rows = found.select("doc_id", *parts, *(F.bitwise_not(p).alias(f"n{p}") for p in parts))
    return rows.join(classes, [f"n{p}" for p in parts], "left").select("doc_id", *parts, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def likely_pairs(nodes: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) that the index links: each node b that was reached, with the nearest and with the smallest node that reached it."""
    reached = near_links(nodes, near).groupBy("v").agg(F.min(F.struct("bits", "u")).alias("nearest"), F.min("u").alias("least"))
    return reached.select(F.explode(F.array_distinct(F.array("nearest.u", "least"))).alias("a"), F.col("v").alias("b"))


def _set_fingerprints(near: Near) -> Callable:
    """Columns of id, node and fingerprint of each set of shingles."""

    def rows_of(ids: pa.Array, sets: list[np.ndarray], nodes: np.ndarray) -> list:
        many = np.fromiter(map(len, sets), np.int64, len(sets))
        h = np.concatenate([np.zeros(0, dtype=np.int64), *sets]).view(np.uint64)
        f = majorities(h, np.repeat(np.arange(len(sets)), many), many, near.parts).view(np.int64)
        return [ids, nodes, *(np.ascontiguousarray(f[:, k]) for k in range(near.parts))]

    return rows_of


def set_nodes(own: DataFrame, near: Near) -> DataFrame:
    """doc_id, node and fingerprint (f0, ...) of the set of shingles of each row of ``own`` (doc_id, text); equal sets are one node."""
    columns = ["doc_id", "node", *(f"f{k}" for k in range(near.parts))]
    return own.mapInArrow(_each_set(near.shingle, columns, _set_fingerprints(near)), ", ".join(f"{c} long" for c in columns))


def similar_components(docs: DataFrame, near: Near = LIKELY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over similarities of 0.8 or more), of rows with an id.

    Pairs come from the fingerprints' index; ``similar_links`` compares their whole sets
    and adds the links that the index leaves.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = written(set_nodes(own, near), "sets")
    parts = [f"f{k}" for k in range(near.parts)]
    nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.min(p).alias(p) for p in parts)), "nodes")
    pairs = written(likely_pairs(nodes.select("node", *parts), near), "likely")
    links = written(similar_links(own, found.select("doc_id", "node"), near.shingle, pairs).distinct(), "links")
    ends = links.join(nodes.select(F.col("node").alias("u"), F.col("least").alias("lu")), "u").join(nodes.select(F.col("node").alias("v"), F.col("least").alias("lv")), "v")
    # a document with several texts is one: its nodes are linked by its id
    own_links = found.join(nodes.select("node", "least"), "node").where("doc_id <> least").select(F.col("least").alias("u"), F.col("doc_id").alias("v"))
    of_doc = components(ends.select(F.col("lu").alias("u"), F.col("lv").alias("v")).unionByName(own_links))
    return found.select("doc_id").distinct().join(of_doc.select(F.col("node").alias("doc_id"), "component").distinct(), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = SIMILAR, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the smallest id; rows without an id stay."""
    found = similar_components(docs, replace(LIKELY, shingle=shingle), id_col=id_col, text_col=text_col)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
