"""Near-duplicates by the exact Jaccard similarity of word shingles: pairs that fingerprints
link (``simhash``) are verified, and a join by prefixes finds what they leave.

A text is the set of its shingles' 64-bit hashes (``Words.sequence_hashes``; the hashes
decide, shingles aren't compared beyond them), and texts with equal sets are one node.  All sets are put in one order, shingles that are frequent in a sample last
(the sample decides on speed, never on results).  Two sets of similarity 0.8 or more
share at least ``wanted`` hashes among the first ``prefix`` of each, so postings are
kept for prefixes only and no link is lost.  Nodes that are in enough lists with
others to have a similar set at all are candidates; all that follows is about these.

1. Fingerprints: the pairs that their index links are verified.
2. Stars: in each list the node of smallest hash is paired with one node of each other
   component, each node keeps the partner it met in most lists, and the pairs are
   verified.  What is left of groups of copies falls together here, at one pair for each node.
3. Rest: pairs of different components are counted over the lists, and those that share
   enough are verified.  A list with very many such pairs is a meeting instead: whole
   sets are compared in one place, by a search that goes from node to node and compares
   each with the nodes not reached yet.

To verify a pair, parity sketches are compared first: bits in which they differ are
members that only one set has, so too many of them prove that the sets aren't similar.
Whole sets are compared for what is left, and every link is a similarity of 0.8 or more.

Defined cases: texts with fewer words than a shingle have one shingle, the whole
sequence; texts without words, and null texts, have the empty set and are one node;
rows without an id are not linked; rows that share an id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER, pieces, texts, written
from tidewire.llm.components import components
from tidewire.llm.words import Words

#: Documents and hashes that decide which shingles count as frequent.
SAMPLE_DOCS = 20_000
MOST_FREQUENT = 100_000
#: Rounds of stars.
STARS = 2
#: Lists with up to this many pairs of different components for each member give counted pairs.
PAIRS_EACH = 48
#: Pairs that a task holds at once, about.
PAIRS_HELD = 1 << 16
#: Candidates whose ids are broadcast to the texts, at most.
FEW_CANDIDATES = 1 << 20


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with ``shared`` common members have a Jaccard similarity of 0.8 or more."""
    return 9 * shared >= 4 * (a + b)


def wanted(n: np.ndarray) -> np.ndarray:
    """Common hashes in the prefixes of similar sets, the smaller of both sets' numbers."""
    return 1 + n // 8


def prefix(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - -(-4 * n // 5) + wanted(n))


def shingle_sets(batch: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    w = Words([t.translate(LOWER) for t in batch])
    values, out = w.word_values(), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if a == b:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        size = min(shingle, b - a)
        out.append(np.unique(w.sequence_hashes(values, np.arange(a, b - size + 1), size).view(np.int64)))
    return out


def _each_set(shingle: int, names: list[str], rows_of: Callable) -> Callable:
    """rows_of(ids, sets, nodes) gives the columns of one piece of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = shingle_sets(texts(part.column("text")), shingle)
                nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows_of(part.column("doc_id"), sets, nodes)], names)

    return run


def _postings(frequent: np.ndarray, rank: np.ndarray) -> Callable:
    def rows_of(ids: pa.Array, sets: list[np.ndarray], nodes: np.ndarray) -> list:
        keys = [np.zeros(0, dtype=np.int64)]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        first = prefix(sizes)
        for s, n in zip(sets, first.tolist(), strict=True):
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                s = s[np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")]
            keys.append(s[:n])
        return [np.concatenate(keys), np.repeat(nodes, first), np.repeat(sizes, first)]

    return rows_of


def _whole_lists(columns: list[str], lists: Callable, names: list[str]) -> Callable:
    """Call ``lists`` with whole lists of rows that are sorted by the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(columns)
            key = batch.column(0).to_numpy(zero_copy_only=False)
            whole = int(np.searchsorted(key, key[-1]))  # the last list may go on
            if held and (whole or held[-1].column(0)[-1].as_py() != key[0]):
                yield from lists(pa.Table.from_batches([*held, batch.slice(0, whole)]), names)
                held = []
            elif whole:
                yield from lists(pa.Table.from_batches([batch.slice(0, whole)]), names)
            held.append(batch.slice(whole))
        if held:
            yield from lists(pa.Table.from_batches(held), names)

    return run


def _distinct(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of key, node, ... without repeated members, and each list's first place and length."""
    columns = [table.column(c).to_numpy() for c in range(table.num_columns)]
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    columns = [c[new] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
    return columns, cut, np.diff([*cut, len(columns[0])])


def _shared(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The members of lists with more than one."""
    columns, _, size = _distinct(table)
    many = np.repeat(size > 1, size)
    yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], names)


def _cross(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counted pairs of different components (a, b, many, least); members of lists with too many (meeting, node, null, null)."""
    (key, node, n, component), cut, size = _distinct(table)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def counted() -> Iterator[pa.RecordBatch]:
        u, v = np.concatenate(us), np.concatenate(vs)
        us.clear()
        vs.clear()
        near = similar(np.minimum(n[u], n[v]), n[u], n[v])
        u, v = u[near], v[near]
        a, b = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
        pair = pa.table({"a": a, "b": b, "least": wanted(np.minimum(n[u], n[v])), "many": np.ones(len(u), dtype=np.int64)})
        found = pair.group_by(["a", "b", "least"]).aggregate([("many", "sum")]).rename_columns({"many_sum": "many"}).select(names)
        yield from found.combine_chunks().to_batches()

    held = 0
    for first, length in zip(cut.tolist(), size.tolist(), strict=True):
        own = component[first : first + length]
        by, counts = np.unique(own, return_counts=True)
        if len(by) == 1:
            continue
        if (length**2 - int((counts**2).sum())) // 2 > PAIRS_EACH * length:
            members = node[first : first + length]
            meeting = np.full(length, xxhash.xxh64_intdigest(members.tobytes()), dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(meeting), pa.array(members), pa.nulls(length, pa.int64()), pa.nulls(length, pa.int64())], names)
            continue
        largest = by[counts.argmax()]
        inside = np.flatnonzero(own == largest)
        outside = np.flatnonzero(own != largest)  # few, or the list would be a meeting
        i, j = np.triu_indices(len(outside), 1)
        apart = own[outside[i]] != own[outside[j]]
        us.append(first + outside[i[apart]])
        vs.append(first + outside[j[apart]])
        held += len(us[-1])
        step = max(1, PAIRS_HELD // len(outside))
        for at in range(0, len(inside), step):
            some = inside[at : at + step]
            us.append(first + np.repeat(some, len(outside)))
            vs.append(first + np.tile(outside, len(some)))
            held += len(us[-1])
            if held >= PAIRS_HELD:
                yield from counted()
                held = 0
    if us:
        yield from counted()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the members by their low bits; about eight bits a member, a power of two of bytes."""
    size = 8 << max(0, (max(len(s), 1) - 1).bit_length())
    odd = np.bincount(s.view(np.uint64) % np.uint64(size), minlength=size) & 1 if len(s) else np.zeros(size, dtype=np.int64)
    return np.packbits(odd.astype(np.uint8))


def may_be_similar(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> bool:
    """False if the sketches prove that the sets aren't similar: similar ones differ in at most (a + b) / 9 members."""
    while len(a) > len(b):
        a = a.reshape(2, -1)[0] ^ a.reshape(2, -1)[1]
    while len(b) > len(a):
        b = b.reshape(2, -1)[0] ^ b.reshape(2, -1)[1]
    return 9 * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= size_a + size_b


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True)
        keep = [may_be_similar(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m) for x, y, n, m in rows]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):  # a copy of one pair at a time
            x, y = np.frombuffer(x.as_py(), "<i8"), np.frombuffer(y.as_py(), "<i8")
            keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def span(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Spanning links of the components of similar sets, each from the node that reached the other."""
    us, vs = [], []
    if len(sets) == 2:
        a, b = sets
        if similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
            return [nodes[0]], [nodes[1]]
        return us, vs
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = int(code.max()) + 1 if len(code) else 0
    rest = np.arange(len(sets))
    built = 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        """Owners by code, of the sets not reached yet."""
        alive = np.zeros(len(sets), dtype=bool)
        alive[rest] = True
        kept = alive[owner]
        by = np.argsort(code[kept], kind="stable")
        return owner[kept][by], np.concatenate([[0], np.cumsum(np.bincount(code[kept], minlength=codes))])

    todo: list[int] = []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        if not built or 2 * len(rest) < built:
            holders, begin = index()
            built = len(rest)
        k = todo.pop()
        own = code[first[k] : first[k + 1]]
        many = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(holders[at], minlength=len(sets))[rest]
        hit = similar(shared, sizes[rest], sizes[k])
        if hit.any():
            new = rest[hit]
            rest = rest[~hit]
            todo += new.tolist()
            us += [nodes[k]] * len(new)
            vs += nodes[new].tolist()
    return us, vs


def _links(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    meeting, node = table.column(0).to_numpy(), table.column(1).to_numpy()
    sets = table.column(2)
    cut = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1]])).tolist()
    us, vs = [], []
    for a, b in zip(cut, [*cut[1:], len(meeting)], strict=True):
        nodes, at = np.unique(node[a:b], return_index=True)  # documents with equal sets are one node
        if len(nodes) > 1:
            u, v = span(nodes, [np.frombuffer(sets[a + i].as_py(), dtype=np.int64) for i in at.tolist()])
            us += u
            vs += v
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names)


def _frequent(own: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are frequent in a sample, and their ranks, the most frequent last."""
    unit = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    every = _each_set(shingle, ["h"], lambda ids, sets, nodes: [np.concatenate([np.zeros(0, dtype=np.int64), *sets])])
    seen = own.where(unit <= F.lit(int((1 << 30) * min(1.0, SAMPLE_DOCS / max(n, 1))))).mapInArrow(every, "h long")
    found = seen.groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h = found["h"].to_numpy()
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written."""

    def beside(rows: DataFrame, side: str, *columns: str) -> DataFrame:
        own = sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{name}_{side}") for c, name in zip(columns, ("sketch", "n") if len(columns) > 1 else ("set",), strict=True)))
        return rows.join(own, side)

    near = beside(beside(pairs.select("a", "b"), "a", "sketch", "n"), "b", "sketch", "n").mapInArrow(_sketched, "a long, b long")
    near = written(near, "near")
    return written(beside(beside(near, "a", "hashes"), "b", "hashes").mapInArrow(_compared, "a long, b long"), "similar")


def _stars(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different components: each node with the leader that it met in most lists."""
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component", "n")
    first = lists.groupBy("key", "component").agg(F.min(own).alias("own"))
    lead = first.groupBy("key").agg(F.min("own").alias("lead"))
    met = first.join(lead, "key").where("own.component <> lead.component AND 9 * least(own.n, lead.n) >= 4 * (own.n + lead.n)")
    counted = met.groupBy(F.col("own.node").alias("b"), F.col("lead.node").alias("a")).agg(F.count("*").alias("many"))
    return counted.groupBy("b").agg(F.max(F.struct("many", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def similar_links(own: DataFrame, found: DataFrame, shingle: int, likely: DataFrame) -> DataFrame:
    """Spanning links (u, v) between the nodes of ``own`` (doc_id, text); ``found`` has doc_id and node, ``likely`` pairs (a, b) of nodes."""
    n = found.count()
    posted = own.mapInArrow(_each_set(shingle, ["key", "node", "n"], _postings(*_frequent(own, n, shingle))), "key long, node long, n long")
    shared = posted.repartition("key").sortWithinPartitions("key").mapInArrow(_whole_lists(["key", "node", "n"], _shared, ["key", "node", "n"]), "key long, node long, n long")
    shared = written(shared, "lists")
    # for the smallest set that can be similar
    enough = F.floor((F.floor((4 * F.col("n") + 4) / 5)) / 8) + 1
    candidates = written(shared.groupBy("node", "n").agg(F.count("*").alias("lists")).where(F.col("lists") >= enough).select("node", "n"), "candidates")
    lists = written(shared.join(candidates.select("node"), "node"), "candidate-lists")
    ids = written(found.join(candidates.select("node"), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "candidate-ids")
    texts_of = own.join(F.broadcast(ids) if ids.count() <= FEW_CANDIDATES else ids, "doc_id")
    every = _each_set(shingle, ["node", "n", "sketch", "hashes"], lambda ids, sets, nodes: [nodes, np.fromiter(map(len, sets), np.int64, len(sets)), [sketch(s).tobytes() for s in sets], [s.tobytes() for s in sets]])
    sets = written(texts_of.mapInArrow(every, "node long, n long, sketch binary, hashes binary").dropDuplicates(["node"]), "sets")
    links = _verified(likely, sets).toDF("u", "v")

    def labelled() -> DataFrame:
        if links.isEmpty():
            return lists.select("key", "node", "n", F.col("node").alias("component"))
        of = components(links).distinct()
        return lists.join(of, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))

    for turn in range(STARS):
        links = links.unionByName(_verified(_stars(labelled(), turn), sets).toDF("u", "v"))
    apart = written(labelled().repartition("key").sortWithinPartitions("key").mapInArrow(_whole_lists(["key", "node", "n", "component"], _cross, ["a", "b", "many", "least"]), "a long, b long, many long, least long"), "cross")
    pairs = apart.where("many is not null").groupBy("a", "b").agg(F.sum("many").alias("many"), F.min("least").alias("least"))
    # pairs that a meeting has counted lists of too don't reach their number here; the meeting compares them itself
    links = links.unionByName(_verified(pairs.where("many >= least"), sets).toDF("u", "v"))
    meetings = apart.where("many is null").select(F.col("a").alias("meeting"), F.col("b").alias("node")).distinct()
    come = sets.select("node", "hashes").join(meetings, "node").select("meeting", "node", "hashes").repartition("meeting").sortWithinPartitions("meeting")
    return links.unionByName(come.mapInArrow(_whole_lists(["meeting", "node", "hashes"], _links, ["u", "v"]), "u long, v long"))
