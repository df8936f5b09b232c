import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import mixing

LETTERS = {"en": "the who with and of", "fr": "été très çà où déjà", "de": "über für groß schön", "es": "niño año más será"}
EVEN = dict.fromkeys(LETTERS, 0.25)


def corpus(documents, sizes):
    rng = random.Random(0)
    rows = []
    for lang, n in sizes.items():
        words = LETTERS[lang].split()
        rows += [(len(rows) + k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))), lang) for k in range(n)]
    return documents(rows)


def fitted(docs, weights, **options):
    domains = mixing.fit_domains(docs, weights)
    members = mixing.member_table(docs, domains)
    return domains, members, mixing.fit_mix(members, domains, weights, **options)


def test_totals_meet_the_targets(documents):
    docs = corpus(documents, {"en": 120, "fr": 40, "de": 20, "es": 10})
    for most in (None, 1.0):
        _, members, mix = fitted(docs, EVEN, most=most)
        assert np.abs(mix.gap).max() < mixing.TOLERANCE and len(mix.steps) >= 1
        total = {}
        for r in mixing.rates(members, mix).collect():
            assert r["rate"] >= 0 and (most is None or r["rate"] <= most)
            total[r["label"]] = total.get(r["label"], 0) + r["rate"] * r["tokens"]
        share = np.array([total[d] for d in sorted(total)]) / sum(total.values())
        assert np.abs(share - 0.25).max() < 0.03
    drawn = mixing.mixed(docs, EVEN, most=1.0)
    assert drawn.columns == docs.columns and 0 < drawn.count() < docs.count()


def test_posteriors_equal_brute_force(documents):
    docs = corpus(documents, {"en": 30, "fr": 20, "de": 12})
    weights = {"en": 0.5, "fr": 0.5}
    domains, members, _ = fitted(docs, weights)
    assert domains.names == [None, "en", "fr"]
    grams = {r["doc_id"]: (r["lang"] if r["lang"] in weights else None, r["g"]) for r in docs.select("doc_id", "lang", mixing._grams(mixing._words(F.col("text"))).alias("g")).collect()}
    seen = np.full((3, mixing.BUCKETS), 0.5)
    for lang, g in grams.values():
        np.add.at(seen[domains.names.index(lang)], g, 1)
    shares = np.log(seen / seen.sum(axis=1, keepdims=True))
    prior = np.log(np.array([12, 30, 20]) / 62)
    assert np.allclose(shares, domains.shares) and np.allclose(prior, domains.prior)
    got = {r["doc_id"]: r for r in members.collect()}
    for i, (_, g) in grams.items():
        logit = prior + shares[:, g].sum(axis=1) * min(1.0, mixing.EFFECTIVE_GRAMS / len(g))
        p = np.exp(logit - logit.max())
        assert np.abs(np.array(got[i]["parts"]) - p / p.sum() * mixing.GRID).max() <= 0.5 + 1e-4
        assert 2 * got[i]["tokens"] == len(g)


def members_of(spark, parts, tokens):
    return spark.createDataFrame([(k, "x", int(t), [int(x) for x in row]) for k, (row, t) in enumerate(zip(parts, tokens, strict=True))], "doc_id long, label string, tokens long, parts array<int>")


def least_squares(p, tokens, target, most, passes=20_000):
    """The same least squares over documents by plain projected gradient with its own step size."""
    a = p.T * tokens
    scale = 1 / a.sum(axis=1)
    step = 1 / np.linalg.eigvalsh((a.T * scale) @ a).max()
    r = np.ones(len(tokens))
    for _ in range(passes):
        new = np.clip(r - step * a.T @ (scale * (a @ r - target)), 0, np.inf if most is None else most)
        if np.abs(new - r).max() < 1e-13:
            break
        r = new
    return float((scale * (a @ r - target) ** 2).sum() / 2), a @ r


@pytest.mark.parametrize(("most", "budget", "weights"), [(None, None, (0.1, 0.1, 0.8)), (1.0, 4_000.0, (0.9, 0.05, 0.05)), (0.5, 3_000.0, (0.2, 0.3, 0.5))])
def test_rates_equal_brute_force_where_they_are_clipped(spark, most, budget, weights):
    rng = np.random.default_rng(3)
    parts = np.round(rng.dirichlet([0.5, 0.5, 0.5], 40) * 64).astype(int)
    tokens = rng.integers(20, 200, 40)
    domains = mixing.Domains(["a", "b", "c"], np.zeros(3), np.zeros((3, mixing.BUCKETS)))
    members = members_of(spark, parts, tokens)
    mix = mixing.fit_mix(members, domains, dict(zip("abc", weights, strict=True)), budget=budget, most=most)
    p = parts / parts.sum(axis=1, keepdims=True)
    whole = (p.T * tokens).sum(axis=1)
    target = np.array(weights) * (budget or (whole / weights).min())
    rate = np.array([r["rate"] for r in mixing.rates(members, mix).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (most is None or (rate <= most).all())
    assert (rate < 0.01).any() or (rate == most).any()
    got = (p.T * tokens) @ rate
    want, totals = least_squares(p, tokens, target, most)
    assert np.allclose((got - target) / target.sum(), mix.gap, atol=1e-9)
    assert float(((got - target) ** 2 / whole).sum() / 2) <= want + 1e-6 * target.sum() and np.allclose(got, totals, atol=2e-4 * target.sum())


def test_few_passes_where_posteriors_hardly_differ(spark):
    parts = [[34, 30], [30, 34], [33, 31]] * 5
    domains = mixing.Domains(["a", "b"], np.zeros(2), np.zeros((2, mixing.BUCKETS)))
    mix = mixing.fit_mix(members_of(spark, parts, [100] * 15), domains, {"a": 0.51, "b": 0.49}, budget=1_400.0)
    assert len(mix.steps) < 15 and np.abs(mix.gap).max() < mixing.TOLERANCE and mix.end == "met"


def test_eight_blurred_domains(spark):
    rng = np.random.default_rng(5)
    names = "abcdefgh"
    parts = np.round(rng.dirichlet(np.full(8, 8.0), 60) * 64).astype(int)
    tokens = rng.integers(20, 200, 60)
    domains = mixing.Domains(list(names), np.zeros(8), np.zeros((8, mixing.BUCKETS)))
    members = members_of(spark, parts, tokens)
    weights = dict(zip(names, (0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05), strict=True))
    mix = mixing.fit_mix(members, domains, weights)
    p = parts / parts.sum(axis=1, keepdims=True)
    whole = (p.T * tokens).sum(axis=1)
    target = np.array([weights[x] for x in names]) * min(w / weights[x] for w, x in zip(whole, names, strict=True))
    rate = np.array([r["rate"] for r in mixing.rates(members, mix).orderBy("doc_id").collect()])
    got = (p.T * tokens) @ rate
    want, _ = least_squares(p, tokens, target, None)
    assert len(mix.steps) <= mixing.MOST_PASSES and (rate >= 0).all()
    assert np.allclose((got - target) / target.sum(), mix.gap, atol=1e-6)
    assert float(((got - target) ** 2 / whole).sum() / 2) <= want + 1e-5 * target.sum()


def test_passes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PASSES", 2)
    parts = [[60, 2, 2], [20, 24, 20], [2, 2, 60], [30, 4, 30]]
    domains = mixing.Domains(["a", "b", "c"], np.zeros(3), np.zeros((3, mixing.BUCKETS)))
    mix = mixing.fit_mix(members_of(spark, parts, [100] * 4), domains, {"a": 0.01, "b": 0.98, "c": 0.01}, most=1.0)
    assert len(mix.steps) <= 2 and np.abs(mix.gap).max() > 0 and mix.end in ("passes", "still")


def test_copies(documents):
    docs = corpus(documents, {"en": 10, "fr": 40})
    got = mixing.mixed(docs, {"en": 0.8, "fr": 0.2}, budget=3_000.0)
    assert got.where("lang = 'en'").count() > 10 and got.where("lang = 'fr'").count() < 40


def test_more_than_64_labels(documents):
    rng = random.Random(1)
    rows = [(k, " ".join(f"{chr(97 + k % 20)}{chr(97 + k % 7)}{rng.randint(0, 9)}" for _ in range(20)), f"l{k % 70}") for k in range(280)]
    docs = documents(rows)
    _, members, mix = fitted(docs, {"l0": 0.5, "l1": 0.5})
    assert mixing.rates(members, mix).count() == 280
    domains, members, mix = fitted(docs, {f"l{k}": 1.0 for k in range(70)})
    assert len(domains.names) == 70 and len(mix.gap) == 70


def test_odd_rows(odd, empty, documents):
    _, members, mix = fitted(odd, {"en": 1.0})
    assert mixing.rates(members, mix).count() == odd.count()
    _, members, mix = fitted(empty, {"en": 1.0})
    assert mixing.rates(members, mix).count() == 0 and mixing.mixed(empty, {"en": 1.0}).count() == 0
    unlabelled = documents([(1, "a b", None), (None, None, None)])
    _, members, mix = fitted(unlabelled, {"en": 1.0})
    assert {r["rate"] for r in mixing.rates(members, mix).collect()} == {1.0}
    with pytest.raises(ValueError):
        mixing.fit_domains(odd, {"xx": 1.0})


def test_clashing_columns(documents):
    docs = documents([(1, "the who", "en", "a", 1.0), (2, "été", "fr", "b", 2.0)], ", tokens string, rate double")
    assert mixing.mixed(docs, {"en": 0.5, "fr": 0.5}, most=1.0).columns == docs.columns
