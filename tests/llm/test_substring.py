import hashlib
import random

import pytest

from tidewire.llm.substring import COVER, PERIOD, remove_shared


def brute(rows, window):
    words = [(i, (t or "").encode().translate(None).split() if t else []) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, window=50):
    return sorted((tuple(r) for r in remove_shared(df, window=window, with_text=False).collect()), key=str)


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(documents, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "über", "x,", "The"]
    passages = [[rng.choice(vocabulary) + str(rng.randint(0, 40)) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in rng.sample(range(1_000), 60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a : a + rng.randint(40, 200)] if rng.random() < 0.7 else [rng.choice(vocabulary) + str(rng.random()) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    assert run(documents(rows)) == brute(rows, 50)


def test_odd_rows(odd, empty):
    from llm_rows import ODD

    assert run(odd) == brute(ODD, 50)
    assert remove_shared(empty).count() == 0


def test_texts_come_back(documents):
    p = [f"w{k}" for k in range(60)]
    got = {r["doc_id"]: r["kept"] for r in remove_shared(documents([(2, "start " + " ".join(p) + "  end"), (1, " ".join(p)), (3, " ".join(p[:49]))])).collect()}
    assert got == {1: " ".join(p), 2: "start end", 3: " ".join(p[:49])}
    with pytest.raises(ValueError):
        remove_shared(documents([(1, "a")]), window=10)


def test_clashing_columns(documents):
    docs = documents([(1, "a b", "en", "x", 1)], ", found string, n_words int")
    assert remove_shared(docs).first()["n_words"] == 2


def test_windows_of_one_polynomial_hash_are_told_apart(documents):
    # products of 2-adic differences make the complementary Thue-Morse words collide modulo 2**64 for every odd base
    bit = lambda n: n.bit_count() % 2
    word = lambda flip: "".join("ab"[bit(k) ^ flip] for k in range(512))
    rest = [f"w{k}" for k in range(34)]
    rows = [(1 + flip, " ".join([word(bit(k) ^ flip) for k in range(16)] + rest)) for flip in (0, 1)]
    assert run(documents(rows)) == brute(rows, 50)
    assert [r["n_removed"] for r in remove_shared(documents(rows)).orderBy("doc_id").collect()] == [0, 0]


def test_rows_that_share_an_id_and_repeat_passages(documents):
    p, q = [f"p{k}" for k in range(60)], [f"q{k}" for k in range(55)]
    rows = [(1, " ".join(p)), (5, " ".join(["x", *p, "y", *p, "z"])), (5, " ".join(q + p)), (5, " ".join(q)), (7, " ".join(q)), (7, " ".join(q))]
    assert run(documents(rows)) == brute(rows, 50)
