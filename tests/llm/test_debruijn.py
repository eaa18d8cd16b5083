from __future__ import annotations

import glob
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vellumine.llm import debruijn as B
from vellumine.llm import queries
from vellumine.plans import durable, skew

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=20):
    """Every window against every earlier one."""
    first, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - k + 1):
            if first.setdefault(tuple(words[i : i + k]), (doc, i)) != (doc, i):
                gone.update(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, k=20):
    return sorted((tuple(r) for r in B.digest(B.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), k)).collect()), key=str)


def corpus(seed, n=40):
    """Texts of few words, copies of parts of each other, periods and odd spaces."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 5, 400]))] + ["É", "é", "A", "a", "🙂"]
    out = []
    for doc in rng.sample(range(1000), n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 19, 20, 21, 60, 150]))]
        for _ in range(rng.randrange(3)):
            if out:
                other = WORD.findall(rng.choice(out)[1] or "")
                a, b = sorted(rng.randrange(len(other) + 1) for _ in "ab")
                at = rng.randrange(len(words) + 1)
                words[at:at] = other[a:b]
        if rng.random() < 0.2:
            words += ["the", "same"] * rng.randrange(30)
        out.append((doc, rng.choice([" ", "  ", "\n", " \t\x0b"]).join(words) + rng.choice(["", " "])))
    return out


@pytest.mark.parametrize(("seed", "k"), [(0, 20), (1, 20), (2, 3), (3, 3)])
def test_against_brute_force(spark, seed, k):
    rows = corpus(seed)
    assert run(spark, rows, k) == brute(rows, k)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (1, None), (2, ""), (3, "  "), (4, text), (5, "x " + text), (6, text.replace("15", "y"))]
    assert run(spark, rows) == brute(rows)
    # a row that repeats wholly is the same document
    twice = run(spark, [(1, text), (1, text), (2, text)])
    assert [r[:3] for r in twice] == [(1, 30, 0), (1, 30, 0), (2, 30, 30)]
    # of two texts under one id one is the first
    assert sorted(r[2] for r in run(spark, [(1, text), (1, text + " end")])) in ([0, 30], [0, 30])
    frame = spark.createDataFrame([(1, text, 0, 0, 0)], "doc_id long, text string, tag int, doc int, spans int")
    assert B.remove_repeats(frame).first().kept == text
    assert B.remove_repeats(frame.where("false")).count() == 0
    assert B.repeated_spans(frame.where("false")).count() == 0


def test_hot_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "FREQUENT", 3)
    rng = random.Random(2)
    common = " ".join(f"c{i}" for i in range(45))
    rows = [(i, f"{rng.random()} {common} {rng.random()} " + " ".join(str(rng.randrange(3)) for _ in range(rng.randrange(30)))) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_long_text_and_periods(spark):
    rng = random.Random(4)
    rows = [(1, " ".join(str(rng.randrange(10**6)) for _ in range(300_000))), (2, "a " * 5000), (3, "b a " * 3000)]
    rows.append((4, " ".join(rows[0][1].split()[1000:200_000])))
    assert run(spark, rows) == brute(rows)


def test_spans_name_their_source(spark):
    rows = corpus(9) + [(2000, " ".join(map(str, range(100)))), (2001, "x " + " ".join(map(str, range(10, 90))) + " y"), (2002, " ".join(map(str, [*range(30), *range(50, 100)])))]
    words = {doc: WORD.findall(text or "") for doc, text in rows}
    spans = B.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in spans:
        assert s.n_words >= 20 and (s.of_doc_id, s.of_start) < (s.doc_id, s.start)
        assert words[s.doc_id][s.start : s.start + s.n_words] == words[s.of_doc_id][s.of_start : s.of_start + s.n_words]
    planted = {(s.doc_id, s.start, s.n_words, s.of_doc_id, s.of_start) for s in spans if s.doc_id >= 2000}
    assert planted == {(2001, 1, 80, 2000, 10), (2002, 0, 30, 2000, 0), (2002, 30, 50, 2000, 50)}


def test_paths_hold_every_window_once_and_are_few():
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(5000))
    walks = B._Walks(pa.array([text, "", text[:200], "one two"]), 20)
    anchor, start, n, row = walks.paths()
    covered = np.concatenate([np.arange(a, a + m) for a, m in zip(start, n)])
    assert covered.tolist() == walks.starts.tolist()
    assert len(start) < 0.17 * len(covered)
    # equal paths have equal hashes, wherever they stand
    again = B._Walks(pa.array(["other words " + text]), 20)
    known = set(zip(*(x.tolist() for x in (anchor, walks.hashes(start, start + n + 19)))))
    anchor, start, n, row = again.paths()
    assert sum(p in known for p in zip(*(x.tolist() for x in (anchor, again.hashes(start, start + n + 19))))) > 0.99 * len(start)


def test_equal_hashes_of_other_words_remove_nothing(spark, monkeypatch):
    texts = [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(30)))]
    frame = B._texts(spark.createDataFrame(texts, SCHEMA), "doc_id", "text")[1]
    spans = spark.createDataFrame([(2, 0, 3, 25, 1, 0, 3), (2, 0, 0, 20, 2, 0, 0)], "doc long, tag long, start int, n_words int, of_doc long, of_tag long, of_start int")
    for most in (10_000, 1):
        monkeypatch.setattr(B, "SPANS", most)
        assert [r.n_words for r in B._verified(frame, spans).collect()] == [20]


def test_little_is_left_behind(spark):
    made = []
    with durable.scratch(spark) as paths:
        frame = B.remove_repeats(spark.createDataFrame(corpus(1, 12), SCHEMA))
        made += paths
        assert frame.count() == 12
        # the spans, which the result reads
        assert len([p for p in made if glob.glob(p.removeprefix("file://"))]) == 1


def test_query(same):
    assert same(queries.op13_substring_dedup, queries.ORACLE_SQL["op13_substring_dedup"]) == 200
