from __future__ import annotations

import hashlib
import random
import re

import pytest

from vellumine.llm import decontaminate as D
from vellumine.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for j in range(len(v) - k + 1 if v else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "É", "7"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.randrange(1, 9))) for i in range(6)] + [(10 + i, text(rng.randrange(4, 14))) for i in range(5)]
    items += [(20, None), (21, ""), (22, "?! --"), (3, items[3][1]), (30, items[8][1])]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + k, f"{text(20)}, {t or ''} {text(5)}") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "é " + "a B-c\nd " * 500), (5, docs[5][1])]
    return docs, items


@pytest.mark.parametrize(("seed", "shard"), [(0, 4 << 20), (1, 4 << 20), (2, 40)])
def test_against_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    docs, items = cases(seed)
    frame = spark.createDataFrame([(*r, 0, ["x"]) for r in docs], "doc_id long, text string, n_hit int, items array<string>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.scan_contamination(frame, bench, window=5).collect()
    assert len(found) == len(docs)
    texts = dict(docs)
    for r in found:
        n, hit, names = brute(texts[r.doc_id], items, 5)
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), names), texts[r.doc_id]
        assert [i for s in r.spans for i in range(s.start, s.end)] == hit


def test_spans_are_cut_by_length_and_documents_by_coverage(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"before, {item.upper()} after that and more words to stay clear of the limit here now"), (2, item), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in D.scan_contamination(docs, bench).collect()}
    assert rows[1].clean_text.startswith("before,  after that") and not rows[1].dropped
    assert rows[2].clean_text == "" and rows[2].dropped
    assert rows[3].clean_text == "nothing of it" and rows[3].items == []
    longer = {r.doc_id: r for r in D.scan_contamination(docs, bench, span_limit=12).collect()}
    assert item.upper() in longer[1].clean_text
    assert [r.doc_id for r in D.uncontaminated(docs, bench).collect()] == [3]


def test_digest(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "x y"), (9, "z")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.digest(D.scan_contamination(docs, bench)).collect()}
    assert rows[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and rows[1].contaminated
    assert rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].n_items == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.scan_contamination(docs, bench).collect()] == [0]
    assert D.scan_contamination(docs.where("false"), bench).count() == 0


def test_against_oracle(same):
    same(queries.op3_decontaminate, queries.ORACLE_SQL["op3_decontaminate"])


@pytest.mark.parametrize("few", [0, 1000])
def test_shards_drop_the_same_rows(spark, monkeypatch, few):
    docs, items = cases(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted((str(i), str(t)) for i, t in docs if not brute(t, items, 5)[1])
    assert sorted((str(r.doc_id), str(r.text)) for r in D.uncontaminated(frame, bench, window=5).collect()) == wanted
    monkeypatch.setattr(D, "SHARD_BYTES", 30)
    monkeypatch.setattr(D, "BROADCAST_HITS", few)
    named = frame.selectExpr("*", "1 AS key", "'x' AS items", "2 AS known_key")
    found = D.uncontaminated(named, bench, window=5)
    assert found.columns == named.columns and sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == wanted
    assert sum(1 for _ in D._shards(bench, 5)) > 5


def test_texts_on_demand(spark):
    docs, items = cases(5)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = D.scan_contamination(frame, bench, window=5, texts=False)
    assert found.columns == ["doc_id", "n_words", "n_hit", "items", "dropped"]
    assert sorted(map(str, D.digest(found).collect())) == sorted(map(str, D.digest(D.scan_contamination(frame, bench, window=5)).collect()))


def test_automaton_is_small():
    """4 MB of benchmark have to take less than 150 MB of a worker; a quarter of it is measured."""
    import pickle

    import numpy as np

    rng = np.random.default_rng(3)
    items, n_bytes = [], 0
    while n_bytes < 1 << 20:
        words = rng.integers(0, 50_000, rng.integers(20, 200)).astype(np.uint64)
        items.append((str(len(items)), words))
        n_bytes += 6 * len(words)
    automaton = D.SuffixAutomaton(items, 10)
    assert len(pickle.dumps(automaton)) < 10 * n_bytes
    spans, names = automaton.scan(automaton.ids(items[7][1]).tolist(), 100)
    assert spans == [[100, 100 + len(items[7][1])]] and names == {"7"}


def test_a_state_with_many_moves(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(["a", rng.choice(words), "a", rng.choice(words), "b"])) for i in range(80)]
    texts = [" ".join(rng.choice(["a", "b", *words[:9]]) for _ in range(80)) for _ in range(20)]
    found = D.scan_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=3).collect()
    for r in found:
        n, hit, names = brute(texts[r.doc_id], items, 3)
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), names)
