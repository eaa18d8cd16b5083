from __future__ import annotations

import hashlib
import math
import random

import pytest

from vellumine.llm import lloyd as L
from vellumine.llm import queries
from vellumine.plans import skew

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Rounds in plain integers, from all parts anew each time."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    book = [[list(cut[k][p]) for k in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            row = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(v[p], e)) for e in book[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                of = [cut[k][p] for k in range(len(cut)) if found[k][p][0] == e]
                if of:
                    book[p][e] = [sum(c) // len(of) for c in zip(*of)]
    found = assign()
    errors = [sum(d for _, d in row) for row in found]
    per_label = {}
    for (_, _, label), e in zip(kept, errors):
        per_label[label] = per_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in row), err, per_label[label], sha) for (i, _, label), row, err in zip(kept, found, errors)), key=str)


def run(spark, rows, **options):
    found = L.digest(L.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)).collect()
    return sorted((tuple(r) for r in found), key=str)


def vectors(seed, n, length, labels=(0, 1, None)):
    rng = random.Random(seed)
    return [(k, [rng.choice([rng.gauss(0, 1), 0.0, -0.5]) for _ in range(length)], rng.choice(labels)) for k in rng.sample(range(1000), n)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = vectors(seed, 90, 32)
    assert run(spark, rows) == brute(rows)


def test_other_shapes(spark):
    rows = vectors(7, 60, 12)
    assert run(spark, rows, parts=4, entries=8, rounds=4) == brute(rows, 4, 8, 4)
    assert run(spark, rows, parts=3, entries=5, rounds=0) == brute(rows, 3, 5, 0)


def test_unusable_vectors_repeats_and_nulls(spark):
    rows = vectors(5, 20, 16) + [(2000, None, 1), (2001, [], 1), (2002, [0.5, None] * 8, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] * 16, 1), (None, [0.25] * 16, None)]
    rows += [rows[0]] * 3 + [(rows[1][0], [9.0] * 16, 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[20:25]) == []


def test_few_vectors_and_equal_ones(spark):
    rows = [(k, [1.0] * 16, 3) for k in range(5)]
    assert run(spark, rows) == brute(rows)
    assert {r[1] for r in run(spark, rows)} == {"00" * 16}


def test_extra_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [0.5] * 16, "a", 7, 8)], "vec_id long, embedding array<double>, label string, code int, error int")
    assert [r.label_error for r in L.digest(L.compress(frame)).collect()] == [0]
    assert L.digest(L.compress(frame.where("false"))).count() == 0


def test_lengths_and_sizes_that_cannot_be(spark):
    for bad in ([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], [(1, [1.0] * 17, 0)]):
        with pytest.raises(ValueError, match="components"):
            run(spark, bad)
    large = [(k, [float(2**18 + 64 * k)] * 16, 0) for k in range(3)]
    assert run(spark, large) == brute(large)


def test_only_changed_parts_are_sent(spark, monkeypatch):
    seen = []
    real = L.materialise

    def spy(df, *args, **kwargs):
        out = real(df, *args, **kwargs)
        if "old" in out.columns:
            seen.append(out.selectExpr("old is null as first", "code != old as moved").agg({"*": "count"}).first()[0] and out.where("old is null or code != old").count())
        return out

    monkeypatch.setattr(L, "materialise", spy)
    rows = vectors(11, 300, 16)
    L.compress(spark.createDataFrame(rows, SCHEMA), parts=16, entries=4, rounds=6)
    assert seen[0] == 300 and seen[-1] < 300


def test_rare_labels_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(skew, "FREQUENT", 2)
    rows = vectors(3, 80, 16, labels=(0, 0, 0, 0, 1, 2, 3, None))
    assert run(spark, rows) == brute(rows)


def test_query(same):
    assert same(queries.op12_vector_codes, queries.ORACLE_SQL["op12_vector_codes"]) == 500
