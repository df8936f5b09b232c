import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewire.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check(rows, texts, tokenizer, capacity):
    """The pieces are an exact cut of the ids, and sequences are gapless."""
    left = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,) for t in texts)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at and length <= capacity
            at += length
        assert at <= capacity
    assert sorted(r["length"] for r in rows) == sorted(n for ids in left for _, n in packing.cut(len(ids), capacity))
    assert sorted(r["ids_crc32"] for r in rows) == sorted(zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for ids in left for a, n in packing.cut(len(ids), capacity))
    return len(by_seq)


def test_odd_rows(odd, empty, tokenizer):
    from llm_rows import ODD

    assert check(packing.pack(odd).collect(), [t for _, t in ODD], tokenizer, 1_024)
    assert packing.pack(empty).count() == 0


def test_few_sequences(documents, tokenizer):
    rng = random.Random(2)
    texts = [" ".join(["word"] * rng.randint(1, 90)) for _ in range(300)]
    rows = packing.pack(documents(list(enumerate(texts))), capacity=128).collect()
    n = check(rows, texts, tokenizer, 128)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 128) + 1


def test_cut():
    assert packing.cut(1_024, 1_024) == [(0, 1_024)] and packing.cut(1_025, 1_024) == [(0, 1), (1, 1_024)] and packing.cut(2_048, 1_024) == [(0, 1_024), (1_024, 1_024)]


def test_encoder_gives_the_same_ids(tokenizer):
    rng = random.Random(1)
    letters = [chr(c) for c in range(1, 0x250)] + list("  \n\t<|>") + ["'s", "<|endoftext|>", "日", "🙂", "Ж", "٠", " "]
    encode = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    for _ in range(1_500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_plan_covers_all_ranks(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 20))}
    ranks, filled = {n: [] for n in counts}, {}
    for n, first, end, seq, offset in packing.plan(counts, 64):
        ranks[n] += range(first, end)
        for k in range(end - first):
            filled.setdefault(seq + k, []).append((offset, n))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    assert sorted(filled) == list(range(len(filled)))
    for slots in filled.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 64


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing takes, one document at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in room if r >= n]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_takes_as_many_sequences_as_best_fit_over_documents(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
    planned = 1 + max(seq + end - first - 1 for _, first, end, seq, _ in packing.plan(counts, 64))
    assert planned == best_fit([n for n, many in counts.items() for _ in range(many)], 64)


def test_many_buckets_repeated_rows_and_clashing_columns(documents, tokenizer):
    rows = [(1, "same words here", "en", 7, "x")] * 40 + [(None, "other", "en", 8, "y")] * 3
    docs = documents(rows, ", length int, bucket string")
    got = packing.pack(docs, capacity=16, bucket_pieces=4).collect()
    assert check(got, [r[1] for r in rows], tokenizer, 16) and len(got) == 43
