import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewire.llm import jaccard, simhash
from tidewire.llm.components import components


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split() if (text or "").isascii() else bytes((text or "").encode()).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(fp):
    """Smallest id reachable through fingerprints at 4 bits or fewer."""
    parent = {i: i for i in fp}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in fp}


def test_triples_meet_every_four_positions():
    triples = simhash.turan_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


def test_fingerprints_and_components(documents):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(300)]
    for i in range(60):
        w = list(base) if i % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((i, " ".join(w)))
    got = simhash.near_components(documents(rows)).select("doc_id", F.hex("f0"), "component_id").collect()
    fp = {i: fingerprint(t) for i, t in rows}
    assert {r[0]: int(r[1], 16) for r in got} == fp
    assert {r[0]: r[2] for r in got} == closure(fp)


def test_links_of_random_fingerprints_lose_nothing(spark):
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = {}
    for k in range(400):
        f = int(seeds[k % 40])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            f ^= 1 << int(b)
        fp[k] = f
    distinct = {f: k for k, f in reversed(fp.items())}
    signed = [(k, f - (1 << 64) if f >= 1 << 63 else f) for f, k in distinct.items()]
    nodes = spark.createDataFrame(signed, "node long, f0 long")
    for long_list in (simhash.LONG_LIST, 3):
        keep, simhash.LONG_LIST = simhash.LONG_LIST, long_list
        try:
            found = {r["node"]: r["component"] for r in components(simhash.near_links(nodes, simhash.EXACT)).collect()}
        finally:
            simhash.LONG_LIST = keep
        want = closure({k: f for f, k in distinct.items()})
        assert all(found.get(k, k) == want[k] for k in want)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (500, 300), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[400] == got[300] == 300 and len(got) == 204
    assert components(links.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    from llm_rows import ODD

    got = simhash.near_components(odd).collect()
    assert len(got) == len(ODD) and all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[6] == by[7] == 6
    assert simhash.near_components(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_similar_documents_go_and_others_stay(documents):
    rng = random.Random(9)
    rows, groups = [], defaultdict(list)
    for g in range(40):
        base = [f"v{rng.randint(0, 5_000)}" for _ in range(250)]
        for copy in range(2 if g % 2 else 1):
            w = list(base)
            if copy:
                for _ in range(2):
                    w[rng.randrange(250)] = "changed"
            groups[g].append(len(rows))
            rows.append((len(rows), " ".join(w)))
    kept = {r["doc_id"] for r in simhash.near_dedup(documents(rows)).collect()}
    assert all(ids[0] in kept for ids in groups.values())
    twins = [ids[1] for ids in groups.values() if len(ids) > 1]
    assert sum(t not in kept for t in twins) >= 0.9 * len(twins)


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup_equals_brute_force_around_the_limit(documents, monkeypatch):
    rng = random.Random(5)
    texts = []
    for g in range(60):
        base = [f"v{rng.randint(0, 3_000)}" for _ in range(rng.choice([12, 60, 250, 400]))]
        texts.append(" ".join(base))
        for _ in range(2 if g else 40):  # similarities from about 0.6 to 1, and one long list
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"c{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    below = 0
    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        else:
            below += 10 * shared >= 7 * len(sets[a] | sets[b])
    want = {i for i in range(len(texts)) if find(i) == i}
    assert below > 20 and len(texts) - len(want) > 40
    for pairs_each, few in ((jaccard.PAIRS_EACH, jaccard.FEW_CANDIDATES), (0, 0)):
        monkeypatch.setattr(jaccard, "PAIRS_EACH", pairs_each)
        monkeypatch.setattr(jaccard, "FEW_CANDIDATES", few)
        got = {r["doc_id"] for r in simhash.near_dedup(documents(list(enumerate(texts)))).collect()}
        assert got == want


def test_pairs_of_positions_meet_every_nine():
    rng = random.Random(2)
    pairs = simhash.turan_pairs(32)
    assert len(pairs) == 48 and all(any(set(p) <= q for p in pairs) for q in (set(rng.sample(range(32), 9)) for _ in range(5_000)))


def test_near_stage_links_by_the_fingerprint_index(documents, monkeypatch):
    """Index links of 256 bits equal brute force where a shared key is guaranteed, and give the stage its similar pairs."""
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = [f"v{rng.randint(0, 3_000)}" for _ in range(300)]
        for copy in range(4):
            w = list(base)
            for _ in range(2 * copy):
                w[rng.randrange(300)] = f"c{rng.randint(0, 99)}"
            texts.append(" ".join(w))
    seen, links = [], simhash.near_links

    def spy(nodes, near):
        found = links(nodes, near)
        seen.append((nodes.collect(), found.collect(), near))
        return found

    monkeypatch.setattr(simhash, "near_links", spy)
    for long_list, short_list in ((simhash.LONG_LIST, simhash.SHORT_LIST), (3, 2)):
        monkeypatch.setattr(simhash, "LONG_LIST", long_list)
        monkeypatch.setattr(simhash, "SHORT_LIST", short_list)
        seen.clear()
        kept = {r["doc_id"] for r in simhash.near_dedup(documents(list(enumerate(texts)))).collect()}
        assert kept == set(range(0, 120, 4))
        [(nodes, found, near)] = seen
        f = {r["node"]: [r[f"f{k}"] % (1 << 64) for k in range(4)] for r in nodes}
        assert len(f) == 120 and all(sum((x ^ y).bit_count() for x, y in zip(f[r["u"]], f[r["v"]], strict=True)) == r["bits"] <= near.most_bits for r in found)
        group = {n: n for n in f}

        def find(n, group=group):
            while group[n] != n:
                n = group[n]
            return n

        for r in found:
            group[find(r["u"])] = find(r["v"])
        for a, b in combinations(f, 2):
            x = b"".join((p ^ q).to_bytes(8, "little") for p, q in zip(f[a], f[b], strict=True))
            if x.count(0) >= 9 and int.from_bytes(x, "little").bit_count() <= near.most_bits:
                assert find(a) == find(b)
        assert len({find(n) for n in f}) <= 33


def thue_morse(order):
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_in_polynomial_hashes_are_told_apart(documents):
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    apart = [one, other, "quite other words", " ".join(one), " ".join(other)]
    frame = "six other words stand on each"
    rows = list(enumerate(apart + [f"{frame} {t} {frame}" for t in (one, other)]))
    # the two sets of single letters hold the same shingles: Thue-Morse words have the factors of their complements
    assert shingles(apart[3]) == shingles(apart[4])
    assert {r["doc_id"] for r in simhash.near_dedup(documents(rows)).collect()} == {0, 1, 2, 3, 5, 6}


def test_sequence_hashes_tell_sequences_apart():
    rng = random.Random(3)
    texts = [("".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) + " ") * rng.randint(1, 3) for _ in range(3_000)] + ["a" * n for n in range(1, 140)] + ["\x00" * n for n in range(1, 70)] + ["a\x00", "a", "a\x00\x00"]
    w = jaccard.Words([t.encode() for t in texts])
    values = w.word_values()
    words = [t for text in texts for t in text.split(" ") if t]
    assert len(words) == len(values)
    seen = {}
    for word, v in zip(words, values.tolist(), strict=True):
        assert seen.setdefault(word, v) == v
    assert len(set(seen.values())) == len(seen)
    at = np.arange(len(w) - 2)
    triples = {}
    for k, h in zip(at.tolist(), w.sequence_hashes(values, at, 3).tolist(), strict=True):
        assert triples.setdefault(tuple(words[k : k + 3]), h) == h
    assert len(set(triples.values())) == len(triples)


def test_pairs_of_lists_come_in_small_batches():
    """Many lists, and one with a large component, give all their counted pairs, and never very many at once."""
    lists = [[(k * 1_000 + m, 10, k * 1_000 + m) for m in range(90)] for k in range(110)] + [[(500_000 + m, 10, 7) for m in range(40_000)] + [(600_000 + m, 10 + m, 8 + m) for m in range(20)]]
    rows = [(key, *member) for key, members in enumerate(lists + lists[:5]) for member in members]
    table = jaccard.pa.table(dict(zip(["key", "node", "n", "component"], np.array(rows).T, strict=True)))
    found = list(jaccard._cross(table, ["a", "b", "many", "least"]))
    assert max(b.num_rows for b in found) <= 2 * jaccard.PAIRS_HELD
    got = defaultdict(int)
    for b in found:
        for a, other, many, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert least in (2, 3, 4)
            got[a, other] += many
    want = defaultdict(int)
    for members in lists + lists[:5]:
        by = members if len(members) < 1_000 else members[40_000:]
        pairs = list(combinations(by, 2)) + [(x, y) for x in members[:40_000] for y in members[40_000:] if len(members) > 1_000]
        for x, y in pairs:
            if jaccard.similar(min(x[1], y[1]), x[1], y[1]):
                want[min(x[0], y[0]), max(x[0], y[0])] += 1
    assert got == want


def test_batches_of_texts_are_bounded(spark, documents):
    """The session's batches follow the bytes of their rows once the stage has run."""

    def sizes(batches):
        for b in batches:
            yield jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array([b.nbytes])], ["b"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    simhash.near_dedup(documents([(1, "one text")])).count()
    texts = spark.range(0, 9_000, 1, 1).select("id", F.repeat(F.lit("x "), 2_000).alias("text"))
    found = [r["b"] for r in texts.mapInArrow(sizes, "b long").collect()]
    assert sum(found) > 30 << 20 and max(found) < 5 << 20
