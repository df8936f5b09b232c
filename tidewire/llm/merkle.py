"""A Merkle manifest of a table: a tree for each group, a tree over their roots, a proof for each row.

Rows are leaves, put in order by a range partitioning on (group, id), and written in
blocks.  A block folds the complete runs of siblings among its own leaves; what is
left are the nodes at its two edges, a few for each level, keyed by (tree, level,
index): a sparse forest.  Forests of neighbouring blocks merge associatively; whenever
all siblings of a run are there, and how many they are follows from the number of the
tree's leaves, the run becomes its parent.  A group's last node becomes a leaf of the
tree over groups, which is folded by the same rule.  ``tree_reduce`` merges the forests
a number of blocks at a time until one node, the root, is left; what the rounds
resolve is kept as a table, as proofs need it (a reduce that ends on the driver would
lose it).  Each block then joins the few runs of its leaves' paths that lie beyond it
and makes its proofs.  No forest, path or group is ever gathered whole: a block has a
bounded number of rows, a round's group some nodes for each level of each block.

A proof is a string of hex digests, the siblings from the leaf to the root, from left
to right; ``position`` and ``leaves`` (in the group), ``group_position`` and ``groups``
say which place the row's own digests have between them.  Digests are sha256 as lower
case hex, and a parent is the digest of its children's hex texts joined.

Defined cases: a null field is ``-``; groups are in bytewise order, null first; within
a group rows are in order of the id, a null id first, rows that repeat an id in order
of their leaf digests, and rows alike in both have neighbouring places; a lone leaf is
its group's root, a lone group's root is the root; texts of any length are hashed in
the JVM; an empty table gives no rows; columns beyond those named are not hashed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewire.llm.common import written

ARITY = 3
#: Leaves of a block, about; blocks whose forests are merged together; proofs that a task hands over together.
BLOCK_ROWS, FAN_IN, PROOFS_AT_ONCE = 100_000, 16, 2_048
#: Hex digits of a digest.
WIDTH = 64
#: The tree over groups, among trees numbered by their group's place.
TOP = -1
_NODES = "block long, tree long, n long, level int, index long, digest string"
#: Names that columns handed through can't have.
_OWN = {"id", "group", "leaf", "turn", "block", "tree", "n", "level", "index", "digest", "first_tree", "first_n", "last_n", "offset", "groups", "position", "leaves", "group_position", "subroot", "root", "proof"}
Node = tuple[int, int, int, int]  # tree, its leaves, level, index


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields: `-` for null, else the bytes of the text, a colon and the text."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def level_sizes(n: int, arity: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, up to its one root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def fold_run(digests: Sequence[str], first: int, n: int, arity: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """Folds neighbouring leaves of a tree of n: per level (first index, digests), and the nodes (level, index, digest) without a parent there."""
    levels, left = [(first, list(digests))], []
    for size in level_sizes(n, arity)[:-1]:
        at, own = levels[-1]
        end = at + len(own)
        low = -(-at // arity)
        high = max(low, -(-end // arity) if end == size else end // arity)
        left += [(len(levels) - 1, i, own[i - at]) for i in range(at, end) if not low <= i // arity < high]
        levels.append((low, [digest_of(own[i * arity - at : min((i + 1) * arity, size) - at]) for i in range(low, high)]))
        if low == high:
            return levels, left
    return levels, left + [(len(levels) - 1, 0, levels[-1][1][0])]


def merge_forest(nodes: dict[Node, str], arity: int, groups: int) -> dict[Node, str]:
    """Resolves all complete runs of a sparse forest in place; returns the nodes that came about.

    A union followed by this is associative and commutative; the empty forest is its unit.
    """
    runs: dict[Node, dict[int, str]] = defaultdict(dict)
    new: dict[Node, str] = {}
    todo = list(nodes.items())
    for (tree, n, level, index), digest in todo:  # grows while runs are resolved
        sizes = level_sizes(n, arity)
        if level == len(sizes) - 1:  # a tree's last node
            if tree == TOP:
                continue
            del nodes[tree, n, level, index]
            parent, value = (TOP, groups, 0, tree), digest
        else:
            parent = (tree, n, level + 1, index // arity)
            run = runs[parent]
            run[index] = digest
            if len(run) < min(arity, sizes[level] - index // arity * arity):
                continue
            value = digest_of(run[i] for i in sorted(run))
            for i in run:
                del nodes[tree, n, level, i]
        nodes[parent] = new[parent] = value
        todo.append((parent, value))
    return new


class Block:
    """The leaves of a block in order, and the trees that they belong to."""

    def __init__(self, table: pa.Table, arity: int) -> None:
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("group", "id", "leaf", "turn")], null_placement="at_start")
        self.arity, self.table = arity, table.take(order).combine_chunks()
        self.leaves = self.table["leaf"].to_pylist()
        self.groups, first_tree, first_n, last_n, offset = (self.table[c][0].as_py() for c in ("groups", "first_tree", "first_n", "last_n", "offset"))
        group = self.table["group"].to_pylist()
        starts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
        self.trees = []  # tree, its leaves, index of the first here, rows from, rows to
        for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            n = first_n if k == 0 else last_n if k == len(starts) - 2 else b - a
            self.trees.append((first_tree + k, n, 0 if k else offset, a, b))
        self.levels, self.left = self._fold()

    def _fold(self) -> tuple[dict[int, list[tuple[int, list[str]]]], list[tuple[Node, str]]]:
        """Per tree its levels, and the nodes that have no parent in the block."""
        levels, left, roots = {}, [], []
        for tree, n, first, a, b in self.trees:
            levels[tree], own = fold_run(self.leaves[a:b], first, n, self.arity)
            if own[-1][0] == len(level_sizes(n, self.arity)) - 1:
                roots.append((tree, own.pop()[2]))
            left += [((tree, n, level, i), d) for level, i, d in own]
        if roots:  # neighbours, as only the first and the last tree can reach beyond the block
            levels[TOP], own = fold_run([d for _, d in roots], roots[0][0], self.groups, self.arity)
            left += [((TOP, self.groups, level, i), d) for level, i, d in own]
        return levels, left

    def node(self, tree: int, level: int, index: int) -> str | None:
        own = self.levels.get(tree, ())
        if level >= len(own) or not 0 <= index - own[level][0] < len(own[level][1]):
            return None
        return own[level][1][index - own[level][0]]

    def beyond(self) -> Iterator[tuple[int, int, int]]:
        """Runs (tree, level of the siblings, parent) on the paths of the leaves, and the root, that the block can't fill itself."""
        spans = [(tree, n, first, first + b - a - 1) for tree, n, first, a, b in self.trees]
        for tree, n, first, last in [*spans, (TOP, self.groups, self.trees[0][0], self.trees[-1][0])]:
            for level in range(len(level_sizes(n, self.arity)) - (tree != TOP)):
                first, last = first // self.arity, last // self.arity
                yield from ((tree, level, parent) for parent in {first, last} if self.node(tree, level + 1, parent) is None)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "tree", "n", "level", "index", "digest"])


def _folding(arity: int) -> Callable:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        own, block = Block(table, arity), table["block"][0].as_py()
        yield _node_batch([(block, *node, digest) for node, digest in own.left] + [(block, tree, None, level, parent, None) for tree, level, parent in own.beyond()])

    return fold


def _merging(arity: int, groups: int) -> Callable:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        nodes = {(t, n, v, i): d for t, n, v, i, d in zip(*(table[c].to_pylist() for c in ("tree", "n", "level", "index", "digest")), strict=True)}
        new = merge_forest(nodes, arity, groups)
        block = table["block"][0].as_py()
        yield _node_batch([(block, *node, d) for node, d in nodes.items()] + [(None, *node, d) for node, d in new.items()])

    return merge


def tree_reduce(forests: DataFrame, blocks: int, arity: int, groups: int, fan_in: int = FAN_IN) -> DataFrame:
    """tree, level, index, digest of every node that a block leaves or a round resolves; the root is among them.

    A round merges the forests of ``fan_in`` neighbouring blocks in one task and is
    written, so a lost executor costs no more than its round.
    """
    known = ["tree", "level", "index", "digest"]
    out, now = forests.select(*known), forests
    while blocks > 1:
        dealt = now.withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
        merged = written(dealt.groupBy("block").applyInArrow(_merging(arity, groups), _NODES), "forest")
        out = out.unionByName(merged.where("block is null").select(*known))
        now, blocks = merged.where("block is not null"), -(-blocks // fan_in)
    return out


def _proving(arity: int, columns: list[str]) -> Callable:
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        is_leaf = pc.is_valid(table["leaf"])
        found = table.filter(pc.invert(is_leaf))
        far = {(t, v, i): d for t, v, i, d in zip(*(found[c].to_pylist() for c in ("tree", "level", "index", "digest")), strict=True)}
        own = Block(table.filter(is_leaf), arity)

        def get(tree: int, level: int, index: int) -> str:
            return own.node(tree, level, index) or far[tree, level, index]

        @lru_cache(1 << 14)
        def above(tree: int, n: int, level: int, index: int) -> str:
            """Siblings from a node to its tree's root; neighbours share what lies above."""
            sizes = level_sizes(n, arity)
            if level == len(sizes) - 1:
                return ""
            begin = index // arity * arity
            run = "".join(get(tree, level, i) for i in range(begin, min(begin + arity, sizes[level])) if i != index)
            return run + above(tree, n, level + 1, index // arity)

        root = get(TOP, len(level_sizes(own.groups, arity)) - 1, 0)
        for tree, n, first, a, b in own.trees:
            subroot, rest = get(TOP, 0, tree), above(TOP, own.groups, 0, tree)
            for at in range(a, b, PROOFS_AT_ONCE):
                end = min(b, at + PROOFS_AT_ONCE)
                places = range(first + at - a, first + end - a)
                rows = own.table.slice(at, end - at)
                more = {"position": pa.array(places, pa.int64())}
                more |= {name: pa.array([value] * len(places), pa.int64()) for name, value in (("leaves", n), ("group_position", tree), ("groups", own.groups))}
                more |= {name: pa.array([value] * len(places), pa.string()) for name, value in (("subroot", subroot), ("root", root))}
                more["proof"] = pa.array([above(tree, n, 0, i) + rest for i in places], pa.string())
                yield pa.RecordBatch.from_arrays([more[c] if c in more else rows[c].combine_chunks() for c in columns], columns)

    return prove


def _places(ranged: DataFrame) -> tuple[list[tuple], int]:
    """(block, first tree, its leaves, the last tree's leaves, leaves of the first tree before the block) of each block, and how many trees there are.

    One row for each block comes to the driver.
    """
    each = ranged.groupBy("block", "group").agg(F.count("*").alias("n"))
    ends = each.groupBy("block").agg(F.count("*"), F.min(F.struct("group", "n")).alias("a"), F.max(F.struct("group", "n")).alias("b"))
    found = sorted(ends.select("block", "count(1)", F.sha2("a.group", 256), "a.n", F.sha2("b.group", 256), "b.n").collect())
    tree, last, many, spans = -1, (), 0, []  # many: leaves of the last tree so far
    total: dict[int, int] = {}
    for block, groups, a, a_n, b, b_n in found:
        same = last == (a,)
        first = tree if same else tree + 1
        offset = many if same else 0
        tree = first + groups - 1
        total[first] = offset + a_n
        many = total[tree] = total[first] if groups == 1 else b_n
        last = (b,)
        spans.append((block, first, tree, offset))
    return [(block, first, total[first], total[end], offset) for block, first, end, offset in spans], tree + 1


def manifest(docs: DataFrame, leaf: Column, *, group_col: str = "source", id_col: str = "doc_id", arity: int = ARITY, block_rows: int = BLOCK_ROWS, more: Mapping[str, Column] | None = None) -> DataFrame:
    """id, group, leaf, position, leaves, group_position, groups, subroot, root and proof of every row, and the columns ``more``."""
    spark, more = docs.sparkSession, dict(more or {})
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("group"), leaf.alias("leaf"), *(c.alias(name) for name, c in more.items()), F.monotonically_increasing_id().alias("turn"))
    if taken := {c.lower() for c in more} & _OWN or len({c.lower() for c in more}) < len(more):
        raise ValueError(f"names of further columns that are taken or twice there: {taken}")
    leaves = written(given, "leaves")
    longs = [StructField(c, LongType()) for c in ("position", "leaves", "group_position", "groups")]
    texts = [StructField(c, StringType()) for c in ("subroot", "root", "proof")]
    schema = StructType([f for f in leaves.schema.fields if f.name != "turn"] + longs + texts)
    blocks = -(-leaves.count() // block_rows)
    if not blocks:
        return spark.createDataFrame([], schema)
    order = [F.col(c).asc_nulls_first() for c in ("group", "id", "leaf", "turn")]  # turn parts even rows that are alike
    ranged = written(leaves.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id().cast("long")), "blocks")
    places, groups = _places(ranged)
    plan = spark.createDataFrame([(*p, groups) for p in places], "block long, first_tree long, first_n long, last_n long, offset long, groups long")
    own = ranged.join(F.broadcast(plan), "block")  # a row for each block
    forests = written(own.drop(*more).groupBy("block").applyInArrow(_folding(arity), _NODES), "forests")
    found = tree_reduce(forests.where("digest is not null"), places[-1][0] + 1, arity, groups)
    asked = forests.where("digest is null").select("block", "tree", "level", F.col("index").alias("parent"))
    met = found.withColumn("parent", F.floor(F.col("index") / arity)).join(asked, ["tree", "level", "parent"]).select("block", "tree", "level", "index", "digest")
    return own.unionByName(met, allowMissingColumns=True).groupBy("block").applyInArrow(_proving(arity, schema.names), schema)


def fold_proof(leaf: str, proof: str, places: Sequence[tuple[int, int]], arity: int) -> str:
    """The root that a leaf's digest and a proof lead to; places: position and leaves of the group's tree and of the tree over groups."""
    at = 0
    for index, n in places:
        for size in level_sizes(n, arity)[:-1]:
            begin = index // arity * arity
            end = at + WIDTH * (min(arity, size - begin) - 1)
            here = at + WIDTH * (index - begin)
            leaf = digest_of((proof[at:here], leaf, proof[here:end]))
            at, index = end, index // arity
    return leaf


def _proof_folding(leaf_col: str, out_col: str, arity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = (leaf_col, "proof", "position", "leaves", "group_position", "groups")
            rows = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            folded = [fold_proof(leaf, proof, ((i, n), (j, m)), arity) for leaf, proof, i, n, j, m in rows]
            yield batch.append_column(out_col, pa.array(folded, pa.string()))

    return run


def folded(proofs: DataFrame, leaf_col: str = "leaf", *, out_col: str = "folded_root", arity: int = ARITY) -> DataFrame:
    """The rows of a manifest with the root that a column of leaf digests leads to; a leaf is as it was if that is ``root``."""
    schema = StructType([*proofs.schema.fields, StructField(out_col, StringType())])
    return proofs.mapInArrow(_proof_folding(leaf_col, out_col, arity), schema)
