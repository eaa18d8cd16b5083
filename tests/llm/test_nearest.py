from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vellumine.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        rest = [i for i in range(len(ids)) if ids[i] != ids[q]]
        s = x[rest] @ x[q]
        order = np.lexsort((ids[rest], -s))[:k]
        out[int(ids[q])] = [(int(ids[rest[o]]), s[o]) for o in order]
    return out


def test_recall_and_scores(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    table = frame.toPandas()
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    wanted = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    found = {}
    for r in N.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(wanted)
    place = {int(v): i for i, v in enumerate(ids)}
    hits = 0
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, 21))
        order = [(-s, v) for _, (v, s) in sorted(ranks.items())]
        assert order == sorted(order)
        for v, s in ranks.values():
            assert s == pytest.approx(float(x[place[v]] @ x[place[q]]), abs=1e-12)
        hits += len({v for v, _ in ranks.values()} & {v for v, _ in wanted[q]})
    assert hits / (20 * len(wanted)) >= 0.95


def test_lengths_matter_for_inner_products(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((1500, 10)) * rng.uniform(0.1, 5, (1500, 1))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3)
    wanted = exact(np.arange(1500), x.astype(float), range(0, 1500, 20), 20)
    found = {}
    for r in N.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {v for v, _ in w}) / 20 for q, w in wanted.items()]) >= 0.9


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (5, [2.0, 1.0, 0.0]), (20, [0.0, 0.0, 0.0]), (40, None), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (9, [None, 1.0, 0.0]), (10, [1.0]), (None, [9.0, 9.0, 9.0]), (60, []), (3, [2.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", rank int")
    found = N.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(found)] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 5, 2.0)]


def test_empty_and_lone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.nearest(none, F.lit(True)).count() == 0
    assert N.nearest(spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA), F.lit(True)).count() == 0


def test_anisotropic_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = N.Codebook.fit(x)

    def along(codes):
        decoded = book.centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        return np.mean(((x - decoded) * x).sum(axis=1) ** 2)

    plain = ((N._split(x)[:, :, None, :] - book.centres) ** 2).sum(axis=3).argmin(axis=2)
    assert along(book.encode(x)) < along(plain)


def recall(spark, x, step, k=20):
    """Share of the exact neighbours, by id, that are found for every step-th vector."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(1)
    wanted = exact(np.arange(len(x)), x.astype(float), range(0, len(x), step), k)
    found = {}
    for r in N.nearest(frame, F.col("vec_id") % step == 0, k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found[q] & {v for v, _ in w}) / k for q, w in wanted.items()])


def test_large_groups_of_copies(spark):
    """Small integers, so that sums are exact and ties are ties."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.integers(-9, 10, (4, 12)), 600, axis=0), rng.integers(-9, 10, (600, 12))]).astype(np.float32)
    assert recall(spark, x[rng.permutation(len(x))], 30) == 1


def test_groups_that_the_code_cannot_tell_apart(spark):
    rng = np.random.default_rng(7)
    near = np.repeat(rng.standard_normal((1, 8)), 500, axis=0)
    near[:, 7] = 1e-3 + 1e-9 * np.arange(500)
    x = np.concatenate([near, rng.standard_normal((300, 8))]).astype(np.float32)
    assert len(np.unique(x, axis=0)) > 400
    assert recall(spark, x[rng.permutation(len(x))], 20) >= 0.98


def test_a_full_block(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((10, 32)) * 2
    x = (centres[rng.integers(0, 10, 17000)] + rng.standard_normal((17000, 32))).astype(np.float32)
    assert recall(spark, x, 200) >= 0.95


def test_copies_with_repeated_ids_and_the_query_among_them():
    ids = np.array([5, 3, 3, 9, 1, 7, 2])
    x = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1.0, 0.0], [2.0, 0.0]])
    kept, copies, rows = N._distinct(ids, x, 3)
    by = {tuple(r): g.tolist() for r, g in zip(rows, np.split(kept, np.cumsum(copies)[:-1]))}
    assert by == {(1.0, 0.0): [3, 5, 7], (2.0, 0.0): [1, 2]}


def test_probed_cells_hold_the_neighbours(spark, monkeypatch):
    """Many small cells; fewer of them than all are asked."""
    monkeypatch.setattr(N, "CANDIDATES", 250)
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((40, 16)) * 3
    x = (centres[rng.integers(0, 40, 10_000)] * rng.uniform(0.5, 2, (10_000, 1)) + rng.standard_normal((10_000, 16))).astype(np.float32)
    cells = N.Cells.fit(x.astype(float), len(x), 500, 20, N.TARGET)
    assert len(cells.means) == 40 and cells.probes < 30
    assert recall(spark, x, 20) >= 0.97


def test_a_cell_with_a_third_of_all_vectors_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(N, "CANDIDATES", 200)
    monkeypatch.setattr(N, "ASKED", 30)
    rng = np.random.default_rng(11)
    hot = rng.standard_normal((1, 8)) * 4 + rng.standard_normal((1500, 8)) * 0.01
    x = np.concatenate([hot, rng.standard_normal((3000, 8))])[rng.permutation(4500)].astype(np.float32)
    cells = N.Cells.fit(x.astype(float), len(x), 225, 20, N.TARGET)
    assert cells.parts.max() >= 5 and cells.query_parts.max() >= 2
    assert recall(spark, x, 20) >= 0.97


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "CANDIDATES", 150)
    monkeypatch.setattr(N, "RERANK", 1)
    x = np.random.default_rng(12).standard_normal((1200, 10))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wanted = exact(np.arange(len(x)), x, range(0, 1200, 40), 7)
    found = {}
    for r in N.nearest(frame, F.col("vec_id") % 40 == 0, 7, exact=True).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [v for v, _ in w] for q, w in wanted.items()}


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((300, 6))
    x[:100] *= 1e-200
    x[100:150] *= 1e150
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = N.nearest(frame, F.col("vec_id") % 30 == 0, 5).collect()
    assert len(found) == 50 and all(np.isfinite(r.score) and r.score == pytest.approx(float((x[r.query_id] * x[r.vec_id]).sum()), rel=1e-9, abs=0) for r in found)
