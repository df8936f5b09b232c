import hashlib
import random

import pytest
from oracle import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from tidewire.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves, arity=3):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, i, arity=3):
    out = ""
    for level in levels[:-1]:
        b = i // arity * arity
        out += "".join(d for k, d in enumerate(level[b : b + arity], b) if k != i)
        i //= arity
    return out


def brute(rows, arity=3):
    """(group, id, leaf, subroot, root, proof) of (id, group, leaf), by whole trees."""
    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(((i, d) for i, k, d in rows if k == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in groups}
    trees = {g: tree([d for _, d in own[g]], arity) for g in groups}
    top = tree([trees[g][-1][0] for g in groups], arity)
    return [(g, i, d, trees[g][-1][0], top[-1][0], siblings(trees[g], k, arity) + siblings(top, j, arity)) for j, g in enumerate(groups) for k, (i, d) in enumerate(own[g])]


def run(docs, arity=3, block_rows=7, fan_in=2, **more):
    merkle_fan, merkle.FAN_IN = merkle.FAN_IN, fan_in
    try:
        return merkle.manifest(docs, F.col("leaf"), arity=arity, block_rows=block_rows, **more)
    finally:
        merkle.FAN_IN = merkle_fan


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, leaf string")


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize(("sizes", "arity"), [([1], 3), ([2], 3), ([1, 1], 3), ([1, 1, 1, 1], 3), ([3, 4, 1], 3), ([100], 3), ([81, 1, 9, 28], 3), ([50, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 40], 3), ([64, 17], 2), ([70, 5], 5)])
def test_equals_whole_trees(spark, sizes, arity):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(1_000_000), f"s{g}", h(str(rng.random()))) for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    got = run(made(spark, rows).repartition(5), arity).collect()
    assert sorted((r["group"], r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted(brute(rows, arity))
    for r in got:
        assert merkle.fold_proof(r["leaf"], r["proof"], ((r["position"], r["leaves"]), (r["group_position"], r["groups"])), arity) == r["root"]


@pytest.mark.parametrize("block_rows", [1, 2, 10, 1_000])
def test_blocks_do_not_matter(spark, block_rows):
    rows = [(k, "ab"[k % 7 == 0], h(str(k))) for k in range(60)]
    got = run(made(spark, rows), block_rows=block_rows).collect()
    assert sorted((r["group"], r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted(brute(rows))


def test_nulls_repeats_and_bytewise_order(spark):
    rows = [(None, None, h("a")), (None, None, h("a")), (1, None, h("b")), (5, "Z", h("c")), (5, "Z", h("d")), (5, "Z", h("d")), (2, "a", h("e")), (-3, "é", h("f")), (2, "", h("g"))] * 3
    got = run(made(spark, rows), block_rows=4).collect()
    assert sorted(((r["group"], r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=key) == sorted(brute(rows), key=key)


def test_many_rows_alike_are_parted(spark):
    rows = [(7, "hot", h("x"))] * 90 + [(k, "hot", h(str(k))) for k in range(100, 130)]
    got = run(made(spark, rows), block_rows=10)
    assert sorted((r["group"], r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got.collect()) == sorted(brute(rows))


def test_empty_table_and_columns_with_names_of_its_own(spark):
    assert run(made(spark, [])).count() == 0
    rows = [(k, "s", h(str(k)), k * 2, "x") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, leaf string, level int, block string")
    got = run(docs, more={"twice": F.col("level")}).collect()
    assert all(r["twice"] == 2 * r["id"] for r in got)
    assert sorted((r["group"], r["id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted(brute([r[:3] for r in rows]))
    with pytest.raises(ValueError, match="taken"):
        run(docs, more={"Level": F.col("level")})


def test_forests_merge_in_any_order():
    rng = random.Random(4)
    for n in (1, 2, 5, 27, 40, 100):
        leaves = [h(str(k)) for k in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(6))})
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            _, left = merkle.fold_run(leaves[a:b], a, n, 3)
            assert len(left) <= 4 * len(merkle.level_sizes(n, 3))
            parts.append({(0, n, level, i): d for level, i, d in left})
        while len(parts) > 1:
            rng.shuffle(parts)
            one = parts.pop() | parts.pop()
            merkle.merge_forest(one, 3, 1)
            parts.append(one)
        merkle.merge_forest(parts[0], 3, 1)
        assert parts[0] == {(merkle.TOP, 1, 0, 0): tree(leaves)[-1][0]}


def test_leaf_digest_of_odd_fields(spark):
    long = "line\n" * 2_000_000
    rows = [(None, None), ("", 0), ("é🙂", -5), ("a:b-", None), (long, 1)]
    got = spark.createDataFrame(rows, "a string, b long").select(merkle.leaf_digest(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [leaf_of(*r) for r in rows]


def test_any_change_of_a_leaf_is_found(spark):
    rows = [(k, "ab"[k % 3 == 0], h(str(k))) for k in range(40)]
    told = merkle.folded(run(made(spark, rows)).withColumn("other", F.when(F.col("id") % 4 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf"))), "other").collect()
    assert {r["id"] for r in told if r["folded_root"] != r["root"]} == set(range(0, 40, 4))


@pytest.mark.parametrize("block_rows", [20, 100_000])
def test_query_equals_its_sql(spark, monkeypatch, block_rows):
    sf = "/root/testdata/sf0.001"
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a, **b: whole(*a, **b, block_rows=block_rows))
    found = rows_of(queries.op13_manifest(spark, sf))
    assert found == rows_of_sql(connect(sf), queries.SQL["op13_manifest"])
    verified = found[0].index("verified")
    assert {r[verified] for r in found[1]} == {True, False}
