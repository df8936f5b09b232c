import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_rows import ODD
from pyspark.sql import functions as F

from tidewire.llm import bpe, queries


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(bpe.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(bpe.serialise(ranks), bpe.rust_pattern(public_tokenizers.PATTERN))


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_every_token_is_its_own_id(codec, ranks):
    assert codec.tokens == sorted(ranks, key=ranks.get)
    assert codec.model.encode([bpe.mapped(t) for t in codec.tokens]) == [[i] for i in range(len(ranks))]


def test_bytes_map_both_ways():
    every = bytes(range(256))
    assert bpe.unmapped(bpe.mapped(every)) == every and len(set(bpe.mapped(every))) == 256


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_library_on_odd_letters(codec, library, seed):
    rng = random.Random(seed)
    letters = [chr(c) for c in range(0x300)] + list("  \n\t<|>") + ["'s", "'LL", "<|endoftext|>", "日", "🙂", "Ж", "٠", " ", "​", "　", "\x1c", "\x85", "ͅ"]
    for _ in range(2_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert ids(codec.encode(text)[0]) == library.encode_ordinary(text)
        assert codec.decode(np.array(library.encode_ordinary(text), dtype=int)) == text.encode()


def test_splits_every_character_as_the_library(codec, library):
    for code in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)]:
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1 {chr(code)}{chr(code)} b"
            assert ids(codec.encode(text)[0]) == library.encode_ordinary(text)


def test_very_long_pre_tokens_and_texts_beyond_a_piece(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 1_000)
    for text in ("abcxyzq" * 30_000, " " * 50_000, "x1 é\n" * 1_200_000):
        assert ids(codec.encode(text)[0]) == library.encode_ordinary(text)


def test_what_is_remembered_is_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    codec.known.clear()
    for k in range(300):
        text = f"word{k} other {k}"
        assert ids(codec.encode(text)[0]) == library.encode_ordinary(text) and len(codec.known) <= 50


def test_odd_rows_round_trip(odd, empty, library):
    found = bpe.decode(bpe.encode(odd)).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"]), bytes(r["raw"])) for r in found) == sorted((i or 0, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_long_texts_through_spark(documents, library, monkeypatch):
    monkeypatch.setattr(bpe, "OUT_BYTES", 100)
    texts = ["eins zwei drei 4 " * 300_000, None, "short", "日本 " * 100]
    docs = documents([(k, t, "en", "x", 1) for k, t in enumerate(texts)], ", ids string, raw int")
    for r in bpe.decode(bpe.encode(docs)).collect():
        own = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(own) and bytes(r["raw"]) == own.encode()


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 255])], "doc_id long, ids array<int>")
    assert [len(r["raw"]) for r in bpe.decode(rows).orderBy("doc_id").collect()] == [0, 0, 2]
    for wrong in (-1, 50_257):
        with pytest.raises(Exception, match="below 0|out of range"):
            bpe.decode(rows.withColumn("ids", F.array(F.lit(wrong)))).collect()


def test_ranks_have_to_be_whole(ranks):
    with pytest.raises(ValueError, match="ranks"):
        bpe.serialise({t: r for t, r in ranks.items() if r != 1_000})
    with pytest.raises(ValueError, match="ranks"):
        bpe.serialise({b"a": 0})


def test_other_vocabulary(library):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    own = bpe.Codec(bpe.serialise(ranks), bpe.rust_pattern(public_tokenizers.PATTERN))
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Größe, año, niño; élève", "数据 данные δεδομένα", "plain words"):
        assert ids(own.encode(text)[0]) == other.encode_ordinary(text)


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op12_bpe(spark, sf).collect():
        own = library.encode_ordinary(want.pop(r["doc_id"]))
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(own)).hexdigest()
    assert not want
