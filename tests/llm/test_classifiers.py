import random

import numpy as np
import pytest

from tidewire.llm import langid, quality, toxicity
from tidewire.llm.common import id_residue

RNG = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "light"]


def prose(n, extra=()):
    w = [RNG.choice(WORDS) for _ in range(n)]
    for e in extra:
        w[RNG.randrange(n)] = e
    return " ".join(w) + "."


def labelled(spark, documents, make, column, n=400):
    rows = [(k, make(k % 2)) for k in range(n)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], f"doc_id long, {column} int")
    return documents(rows), labels


def accuracy(scored, cut):
    got = [((r["__tw_score"] >= cut) == bool(r["doc_id"] % 2)) for r in scored.collect() if r["doc_id"] is not None]
    return float(np.mean(got))


def test_quality(spark, documents, odd, empty):
    docs, labels = labelled(spark, documents, lambda good: prose(60) if good else " ".join(w + "$$$" for w in prose(60).split()), "quality")
    model = quality.fit_quality(docs, labels.where(id_residue("doc_id", 5) != 0))
    assert accuracy(quality.with_quality(docs, model).where(id_residue("doc_id", 5) == 0), 0.3) > 0.97
    assert quality.with_quality(odd, model).where("__tw_score between 0 and 1").count() == odd.count()
    assert quality.with_quality(empty, model).count() == 0
    none = quality.fit_quality(docs, labels.limit(0))
    assert {r["__tw_score"] for r in quality.with_quality(odd, none).collect()} == {0.5}
    assert quality.fit_quality(empty, labels)[1] != quality.fit_quality(empty, labels)[1]  # nan: nothing to learn from
    with pytest.raises(ValueError):
        quality.with_quality(docs, model, out_col="lang")


def test_pairs_rank(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    w, t = quality.fit_pairs(x, y, 5_000)
    assert abs(w[0]) > 5 * np.abs(w[1:]).max() and np.mean((x @ w >= t) == (y == 1)) > 0.9


def test_quality_threshold_covers_all_labelled_rows(spark, documents, monkeypatch):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):  # labels that overlap, one in four 0
        good = i % 4 > 0
        odd = rng.randint(0, 12) if good else rng.randint(6, 20)
        rows.append((i, " ".join(w + "$$$" * (k < odd) for k, w in enumerate(prose(30).split()))))
        labels.append((i, int(good)))
    docs, labels = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    for most in (10_000, 20):
        monkeypatch.setattr(quality, "SORTED", most)
        weights, threshold = quality.fit_quality(docs, labels, sample_per_label=40)
        raw = quality.features([t.encode() for _, t in rows], quality.Hasher()) @ weights
        assert abs(threshold - np.quantile(raw, 0.25, method="median_unbiased")) < 1e-9


def test_toxicity(spark, documents, odd, empty):
    docs, labels = labelled(spark, documents, lambda bad: prose(80, ["nastyword"] * (3 * bad)), "toxic")
    model = toxicity.fit_toxicity(docs, labels.where(id_residue("doc_id", 5) != 0))
    assert accuracy(toxicity.with_toxicity(docs, model).where(id_residue("doc_id", 5) == 0), 0.5) > 0.97
    assert toxicity.with_toxicity(odd, model).where("__tw_score < 0.5").count() == odd.count()
    assert toxicity.with_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r["__tw_score"] for r in toxicity.with_toxicity(docs, none).collect()} == {0.0}


def test_settings_are_compared_by_folds_of_the_given_labels(spark, documents):
    docs, labels = labelled(spark, documents, lambda bad: prose(80, ["nastyword"] * (3 * bad)), "toxic", 120)
    found = toxicity.fold_losses(docs, labels, [(1_000, 3.0), (1_000, 1e9)], folds=2)
    assert [x[:2] for x in found] == [(1_000, 3.0), (1_000, 1e9)]
    assert found[0][2] < found[1][2] and found[0][3] < 0.05 and abs(found[1][3] - 0.5) < 1e-12  # without features all texts score alike
    (none,) = toxicity.fold_losses(docs, labels.limit(0), [(1_000, 3.0)], folds=2)
    assert np.isnan(none[2])


def test_grams_end_with_their_text():
    found, first = toxicity.grams(["abcd", "", "efgh"])
    one, _ = toxicity.grams(["abcd"])
    for h, alone, many in zip(found, one, (3, 2, 1), strict=True):
        inside = h[first[0] : first[1]]
        assert set(inside[inside >= 0]) == set(alone[alone >= 0]) and len(alone[alone >= 0]) == many


def test_grams_are_of_characters():
    text = "日本語の文 Ärger"
    padded = f" {text.lower()} "
    want = sum(len({padded[k : k + n] for k in range(len(padded) - n + 1)}) for n in toxicity.SIZES)
    assert len(toxicity.sample_grams([text.lower()])[0]) == want


def test_toxicity_counts_and_ratios_equal_brute_force(spark, documents):
    rows = [(k, prose(20, ["nastyword"] * (k % 3 == 0))) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    kept, weights, intercept = toxicity.fit_toxicity(documents(rows), labels)
    sets = [set(toxicity.sample_grams([t.lower()])[0].tolist()) for _, t in rows]
    want = {}
    for g in set().union(*sets):
        c1, c0 = sum(g in s for s in sets[::3]), sum(g in s for k, s in enumerate(sets) if k % 3)
        pooled = (c1 + c0) / 60
        if c1 + c0 >= 3 and abs(c1 / 20 - c0 / 40) > toxicity.CLEAR * np.sqrt(max(pooled * (1 - pooled), 1e-12) * (1 / 20 + 1 / 40)):
            want[g] = np.log((c1 + 1) / 22) - np.log((c0 + 1) / 42)
    assert sorted(want) == kept.tolist() and len(kept)
    got, b = toxicity.fit_scaled([np.array([k for k, g in enumerate(kept) if g in s]) for s in sets], np.array([int(k % 3 == 0) for k in range(60)]), np.array([want[g] for g in kept]))
    assert np.allclose(got, weights, atol=1e-6) and abs(b - intercept) < 1e-6
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(documents(rows), (kept, weights, intercept)).collect()}
    for k, s in enumerate(sets):
        assert abs(score[k] - 1 / (1 + np.exp(-(intercept + sum(w for g, w in zip(kept, weights, strict=True) if g in s))))) < 1e-9


def test_names_of_results_that_clash(spark, documents):
    docs, labels = labelled(spark, documents, lambda bad: prose(80, ["nastyword"] * (3 * bad)), "toxic", 60)
    with pytest.raises(ValueError):
        toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, labels), out_col="Lang")
    clash = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "label").withColumnRenamed("n_chars", "id")
    model = toxicity.fit_toxicity(clash, labels)
    assert toxicity.toxicity_scores(clash, model).columns == ["doc_id", "score"]
    assert quality.quality_scores(clash, labels.withColumnRenamed("toxic", "quality")).columns == ["doc_id", "score"]
    langs = docs.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "id")
    assert langid.predict_languages(langs, langid.fit_languages(langs)).count() == 60


def test_scores_of_one_pass_equal_those_of_two(spark, documents):
    docs, labels = labelled(spark, documents, lambda good: prose(60) if good else " ".join(w + "$$$" for w in prose(60).split()), "quality", 80)
    one = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    two = {r["doc_id"]: r["__tw_score"] for r in quality.with_quality(docs, quality.fit_quality(docs, labels)).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_features_equal_brute_force():
    text = "Aa aa  aa! $b\n12 é"
    got = quality.features([b"", text.encode()], quality.Hasher())[1]
    raw, words = text.encode(), text.split()
    share = lambda members: np.sqrt(sum(b in members for b in raw) / len(raw))
    assert np.isclose(got[0], share(range(97, 123))) and np.isclose(got[1], share(range(65, 91))) and np.isclose(got[2], share(b"0123456789")) and np.isclose(got[11], share(range(128, 256)))
    rest = got[12:]
    assert np.isclose(rest[0], sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words))
    assert np.isclose(rest[1], len(set(words)) / len(words) / (1 + np.log1p(len(words))) * 8)
    assert np.isclose(rest[2], np.log1p(len(words)) / 10) and np.isclose(rest[3], sum(len(w.encode()) for w in words) / len(words) / 10)
    assert np.isclose(rest[4], sum(w[-1] in "!$%&#*@^~+|<>{}[]\\/=_" for w in words) / len(words))


TALK = {"xx": ["foo", "bar", "baz", "quux"], "yy": ["lorem", "ipsum", "dolor", "sit"]}


def test_languages(documents, odd, empty):
    rows = [(k, " ".join(RNG.choice(TALK["xx" if k % 2 else "yy"]) for _ in range(30)), "xx" if k % 2 else "yy") for k in range(200)]
    docs = documents([*rows, (900, None, "xx"), (901, "12 34!", "xx"), (902, "FOO! bar, BAZ 99", None), (903, " ".join(TALK["yy"] * 5_000), None)])
    model = langid.fit_languages(docs.where(id_residue("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx" and got[903]["lang_pred"] == "yy"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[0]["rejected"] and got[900]["rejected"]
    assert langid.predict_languages(odd, model).count() == odd.count() and langid.predict_languages(empty, model).count() == 0
    assert langid.fit_languages(empty) == {}
    assert {r["lang_pred"] for r in langid.predict_languages(odd, {}).collect()} == {"und"}


def test_rare_languages_are_learnt(documents):
    rng = random.Random(5)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(201)]
    word = lambda k: "".join(rng.choice(alphabets[k]) for _ in range(5))
    rows = [(k, " ".join(word(k % 201) for _ in range(60)), f"l{k % 201:03}") for k in range(402)]
    rows += [(1_000 + k, " ".join(word(0) for _ in range(60)), "l000") for k in range(100)]
    model = langid.fit_languages(documents(rows))
    assert len(model) == 201
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(documents([r for r in rows if r[0] in (0, 77, 200)]), model).collect()}
    assert got == {0: "l000", 77: "l077", 200: "l200"}


def test_encoded_sizes_equal_brute_force(documents):
    import zstandard

    model = {"xx": b"foo bar baz quux " * 40, "yy": b"lorem ipsum dolor sit " * 40}
    rows = [(1, "foo bar lorem " * 20), (2, "Dolor SIT, sit 1 2 3 " * 900)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(documents(rows), model).collect()}
    for i, text in rows:
        size = {}
        data = langid.letters(text)
        n = -(-len(data) // langid.BLOCK_BYTES)
        for lang, content in model.items():
            how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.BLOCK_BYTES, dict_size=len(content), min_match=langid.SHORTEST_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
            size[lang] = sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n))
        assert got[i] == min(size, key=lambda x: (size[x], x))


def test_samples_are_bounded(spark):
    from tidewire.llm.sampling import class_sample

    rows = spark.range(3_000).selectExpr("if(id < 1000, 7, id) AS id", "if(id % 3 = 0, 'a', 'b') AS lang").union(spark.sql("SELECT CAST(NULL AS bigint), 'a' FROM range(500)"))
    found = class_sample(rows, "id", "lang", 50).distinct().groupBy("lang").count().collect()
    assert {r["lang"] for r in found} == {"a", "b"} and all(20 < r["count"] < 90 for r in found)
