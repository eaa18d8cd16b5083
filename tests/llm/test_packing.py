from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA
from vellumine.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [(900, None), (901, ""), (902, "<|endoftext|> inside <|endoftext|>"), (903, "🙂é\x00 \n\n  \t x"), (904, "it's we'll 'S 123 4567 ..."), (905, "x" * 20000), (906, " " * 5000 + "a"), (None, "no id"), (901, "")]


def test_pieces_against_the_tokenizers_library(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + ODD
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    found = P.pack_documents(frame).collect()
    wanted = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(wanted, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // 1024) * 1.02 + 1


def test_tokens_are_those_of_the_library_for_strange_texts(tokenizer):
    encode = P.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "ß", "中", "🙂", "'s", "’", "1", "23", "...", "\u200b", "\u00a0", "<|", "|>", "the", "ing", "\x7f"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_search_empties_a_bin_that_best_fit_leaves():
    lengths, bins = [6, 5, 4, 3, 2], [[0, 3], [1, 2], [4]]
    out = P._Search([list(b) for b in bins], lengths, 10).run()
    assert sorted(i for b in out for i in b) == list(range(5)) and len(out) == 2


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_valid_and_no_worse_than_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice((rng.randrange(1, 101), rng.randrange(30, 60))) for _ in range(400)]
    plain, bins = P.best_fit(lengths, 100), P.pack(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert -(-sum(lengths) // 100) <= len(bins) <= len(plain)


def test_each_exchange_raises_the_squared_fill(monkeypatch):
    rng = random.Random(9)
    lengths = [rng.randrange(20, 70) for _ in range(300)]
    search = P._Search([[i] for i in range(300)], lengths, 100)
    seen = [sum(f * f for f in search.fill)]
    apply = search._apply
    monkeypatch.setattr(search, "_apply", lambda *a: (apply(*a), seen.append(sum(f * f for f in search.fill))))
    search.run()
    assert len(seen) > 10 and seen == sorted(set(seen))


def test_shards_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 20)
    frame = spark.createDataFrame([(i, "word " * (i % 37)) for i in range(150)], "doc_id long, text string")
    found = P.pack_documents(frame, capacity=64).toPandas()
    assert len(found) == 150 and (found.groupby("sequence_id").length.sum() <= 64).all()
    assert P.pack_documents(frame.where("false")).count() == 0


def test_rows_that_repeat_are_dealt_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 20)
    docs = spark.createDataFrame([(None, "")] * 400, "doc_id long, text string").repartition(4)
    rows = P.pack_documents(docs, capacity=8).collect()
    held = Counter(r["sequence_id"] >> 32 for r in rows)
    assert sum(held.values()) == 400 and max(held.values()) <= 60
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert max(places.values()) == 1 and max(o for _, o in places) < 8


@pytest.mark.parametrize(("low", "high"), [(150, 450), (256, 512)])
def test_search_runs_until_no_exchange_helps(low, high):
    rng = random.Random(1)
    lengths = [rng.randrange(low, high + 1) for _ in range(16000)]
    bins = P.pack(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(16000)) and all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert P.least_bins(lengths, 1024) < len(bins) < len(P.best_fit(lengths, 1024))
    left = P._Search(bins, lengths, 1024)
    under = np.flatnonzero(left.fill < 1024)
    pool = np.flatnonzero(np.isin(left.bin_of, under))
    assert not any(left._improve(a, pool) for a in under.tolist())


@pytest.mark.parametrize("text", [" " * 3_000_000 + "a", "\n" * 1_000_000, "\t \r\n" * 500_000 + "b c", "x" * 300_000, " " * (P.FAST_CHARS - 1) + "a"], ids=["spaces", "newlines", "mixed", "letters", "below"])
def test_very_long_runs(tokenizer, text):
    assert list(P.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")(text)) == tokenizer.encode(text, add_special_tokens=False).ids
