from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumine.llm import katz, langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), None]


def discounts(counts):
    n = [sum(c == r for c in counts.values()) for r in range(1, 7)]
    last = 6 * n[5] / n[0] if n[0] else 1.0
    out = [((r + 1) * n[r] / (r * n[r - 1]) - last) / (1 - last) if n[r - 1] and last < 1 else 0.0 for r in range(1, 6)]
    if not all(0 < d < 1 for d in out):
        out = [1 - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5) / r for r in range(1, 6)]
    return lambda c: out[c - 1] if c <= 5 else 1.0


class Brute:
    """The same model with dictionaries."""

    def __init__(self, training):
        self.words, self.pairs = Counter(), Counter()
        for text in training:
            t = tokens(text)
            self.words.update(t)
            self.pairs.update(zip(["<s>", *t], t))
        self.total = sum(self.words.values())
        self.d1, self.d2 = discounts(self.words), discounts(self.pairs)
        self.followers = {}
        for (h, w), c in self.pairs.items():
            self.followers.setdefault(h, {})[w] = c
        left = sum(c * (1 - self.d1(c)) for c in self.words.values())
        self.scale = 1 / self.total if left else 1 / (self.total + 1)
        self.unknown = left / self.total if left else 1 / (self.total + 1)

    def unigram(self, w):
        c = self.words.get(w, 0)
        return self.d1(c) * c * self.scale if c else self.unknown

    def p(self, h, w):
        seen = self.followers.get(h)
        if not seen:
            return self.unigram(w)
        total = sum(seen.values())
        left = sum(c * (1 - self.d2(c)) for c in seen.values())
        if left <= 0:
            total, left = total + 1, 1.0
        if w in seen:
            return self.d2(seen[w]) * seen[w] / total
        return left / total / (1 - sum(self.unigram(x) for x in seen)) * self.unigram(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.words.get(w, 0) + 0.1) / (self.total + 0.1 * (len(self.words) + 1))) for w in tokens(text))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "ÉCLAIR", "éclair", " x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "never seen before"), (1004, "a " * 3000), (5, rows[5][1])]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


@pytest.mark.parametrize(("seed", "batch", "part"), [(0, 1_000_000, 2_000_000), (1, 100, 150), (2, 300, 10_000)])
def test_against_brute_force(spark, monkeypatch, seed, batch, part):
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, batch string, part int").repartition(3)
    found = katz.katz_scores(frame, langid.held_out(F.col("doc_id"), 10)).collect()
    assert len(found) == len(rows)
    model = Brute([t for i, t in rows if not held(i)])
    by_id = {}
    for i, t in rows:
        by_id[i] = t
    for r in found:
        text = by_id[r.doc_id]
        assert r.held_out == held(r.doc_id)
        assert r.train_tokens == model.total
        assert r.n_tokens == len(tokens(text))
        assert r.n_known == sum(w in model.words for w in tokens(text))
        assert r.base_score == pytest.approx(model.base(text), rel=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9)


def test_contexts_sum_to_one():
    model = Brute([t for _, t in corpus(3)])
    for h in [*list(model.followers)[:20], "unseen"]:
        assert sum(model.p(h, w) for w in model.words) + model.p(h, "unknown") == pytest.approx(1)


def test_nothing_to_learn_and_nothing_to_score(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.katz_scores(frame, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.score == pytest.approx(0) and row.base_score == pytest.approx(0)
    assert katz.katz_scores(frame.where("false"), F.lit(False)).count() == 0


def test_null_ids_are_kept(spark):
    frame = spark.createDataFrame([(None, "a"), (None, None), (3, "a")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in katz.katz_scores(frame, F.lit(False)).collect()) == ["3", "None", "None"]


def test_it_beats_unigrams_on_held_out_texts(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    row = katz.katz_scores(docs, langid.held_out(F.col("doc_id"), 10)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


class BruteOrder:
    """The model of any order with dictionaries and recursion."""

    def __init__(self, training, order):
        self.order, self.plain = order, Brute(training)
        self.counts = {}
        for text in training:
            t = tokens(text)
            for level in range(2, order + 1):
                padded = [*["<s>"] * (level - 1), *t]
                self.counts.setdefault(level, Counter()).update(zip(*(padded[i:] for i in range(level))))
        self.d = {level: discounts(c) for level, c in self.counts.items()}
        self.followers = {}
        for c in self.counts.values():
            for (*h, w), n in c.items():
                self.followers.setdefault(tuple(h), {})[w] = n

    def p(self, h, w):
        if not h:
            return self.plain.unigram(w)
        seen, d = self.followers.get(h), self.d.get(len(h) + 1)
        if not seen:
            return self.p(h[1:], w)
        total = sum(seen.values())
        left = sum(c * (1 - d(c)) for c in seen.values())
        if left <= 0:
            total, left = total + 1, 1.0
        if w in seen:
            return d(seen[w]) * seen[w] / total
        return left / total / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def score(self, text):
        t = tokens(text)
        padded = [*["<s>"] * (self.order - 1), *t]
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("order", "batch", "part"), [(1, 300, 500), (3, 1_000_000, 2_000_000), (3, 100, 150), (4, 300, 500)])
def test_orders_against_brute_force(spark, monkeypatch, order, batch, part):
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    rows = corpus(order)
    model = BruteOrder([t for i, t in rows if not held(i)], order)
    by_id = dict(rows)
    found = katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), langid.held_out(F.col("doc_id"), 10), order=order).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.score == pytest.approx(model.score(by_id[r.doc_id]), rel=1e-9)


def test_contexts_of_two_words_sum_to_one():
    model = BruteOrder([t for _, t in corpus(3)], 3)
    for h in [h for h in model.followers if len(h) == 2][:20]:
        assert sum(model.p(h, w) for w in model.plain.words) + model.p(h, "unknown") == pytest.approx(1)


def test_the_query_scores_more_than_one_word_of_context(spark):
    from tests.conftest import DATA
    from vellumine.llm.queries import op6_katz_score

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held_out = langid.held_out(F.col("doc_id"), 10)
    found = {r.doc_id: r.score for r in op6_katz_score(spark, DATA).collect()}
    assert found == pytest.approx({r.doc_id: r.score for r in katz.katz_scores(docs, held_out, order=3).collect()})
    assert found != pytest.approx({r.doc_id: r.score for r in katz.katz_scores(docs, held_out).collect()})


def test_order_is_checked(spark):
    with pytest.raises(ValueError):
        katz.katz_scores(spark.createDataFrame([(1, "a")], "doc_id long, text string"), F.lit(False), order=0)


def test_the_model_is_kept_on_demand(spark, tmp_path):
    from vellumine.llm.packed import load

    rows = corpus(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    katz.katz_scores(frame, langid.held_out(F.col("doc_id"), 10), order=3, model=str(tmp_path)).collect()
    kept = spark.read.parquet(f"{tmp_path}/counts").collect()
    brute = BruteOrder([t for i, t in rows if not held(i)], 3)
    for level in (1, 2, 3):
        counts = sorted(c for r in kept if r.level == level for c in load(r.payload)[1].tolist())
        assert counts == sorted((brute.counts[level] if level > 1 else brute.plain.words).values())
    assert {r.level for r in spark.read.parquet(f"{tmp_path}/backoff").collect()} == {2, 3}
