import hashlib
import os
from collections import defaultdict

import pytest

from tidewire.llm.exact import exact_dedup, exact_groups, grace


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t or ""): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("options", [{}, {"digest": "crc32"}, {"table_bytes": 300}])
def test_groups_equal_brute_force(odd, options):
    from llm_rows import ODD

    want = brute(ODD)
    got = exact_groups(odd, **options).collect()
    assert len(got) == len(ODD)
    by_key = defaultdict(list)
    for r in got:
        by_key[bytes(r["digest"])].append(r)
    for i, t in ODD:
        if options.get("digest") != "crc32":
            own = [r for r in by_key[hashlib.sha256((t or "").encode()).digest()] if r["doc_id"] == i]
            assert own and all((r["keep_id"], r["group_size"]) == want[i, t or ""] and r["kept"] == (i == r["keep_id"]) for r in own)


def test_different_texts_of_one_digest(documents):
    # plumless and buckeroo have one crc32
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(documents([(1, "plumless"), (2, "buckeroo"), (3, "plumless")]), digest="crc32").collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_rows_that_stay(odd, empty):
    stay = exact_dedup(odd)
    assert stay.columns == odd.columns
    texts = [(r["text"] or "") for r in stay.collect()]
    assert len(texts) == len(set(texts))
    assert exact_dedup(empty).count() == 0 and exact_groups(empty).count() == 0


def test_clashing_columns(documents):
    docs = documents([(1, "a", "en", "x", 5), (2, "a", "en", "y", 6)], ", digest string, keep_id int")
    assert [tuple(r) for r in exact_dedup(docs).collect()] == [(2, "a", "en", "src0", 1, "y", 6)]
    docs = documents([(1, "a", "en", "x", 5), (2, "b", "en", "y", 6)], ", __tw_digest string, __tw_row int")
    assert exact_dedup(docs).columns == docs.columns and exact_dedup(docs).count() == 2
    assert exact_groups(docs).count() == 2


def test_spilling_keeps_groups_whole(tmp_path):
    digest = lambda b: hashlib.sha256(b).digest()
    rows = []
    for k in range(3_000):
        content = f"text {k % 700}".encode() * 5
        d = digest(content)
        rows.append((int.from_bytes(d[:8], "big"), content, d, k, 1, 1))
    got = [r for part in grace(rows, digest, str(tmp_path), 5_000) for r in part]
    assert len(got) == 700 and sum(r[4] for r in got) == 3_000 and not list(tmp_path.iterdir())
    assert all(r[3] >= 2_300 - 1 for r in got)


def test_least_id_is_an_id(documents):
    least = -(1 << 63)
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_groups(documents([(least, "a"), (None, "a"), (None, "b")])).collect()}
    assert got == {(least, least, True), (None, least, False), (None, None, True)}
    assert sorted((r["text"], r["doc_id"]) for r in exact_dedup(documents([(least, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()) == [("a", least), ("b", None)]


@pytest.mark.parametrize("digest", ["sha256", "crc32"])
def test_rows_alike_but_for_other_columns(documents, digest):
    docs = documents([(2, "plumless", "en", "z"), (2, "plumless", "en", "y"), (1, "plumless", "en", "a"), (3, "buckeroo", "en", None)], ", extra string")
    for rows in (docs, docs.orderBy("extra"), docs.repartition(5)):
        assert sorted((r["doc_id"], r["extra"]) for r in exact_dedup(rows, digest=digest).collect()) == [(2, "y"), (3, None)]


def test_spilling_leaves_no_files_open(tmp_path):
    digest = lambda b: hashlib.sha256(b).digest()
    before = len(os.listdir("/proc/self/fd"))
    rows = ((int.from_bytes((d := digest(b"%d" % k))[:8], "big"), b"%d" % k, d, k, 1, 1) for k in range(5_000))
    assert sum(len(part) for part in grace(rows, digest, str(tmp_path), 20_000)) == 5_000
    assert len(os.listdir("/proc/self/fd")) == before
