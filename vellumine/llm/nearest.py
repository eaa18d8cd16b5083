"""Approximate nearest neighbours by inner product, with score-aware quantisation.

Vectors are cut into subspaces of two dimensions, each with sixteen centres, so
a code is four bits a subspace.  What hurts the ranking of large inner products
is the part of the residual that is parallel to the vector; the loss weighs it
``eta`` times as much as the part across:

    |r|^2 + (eta - 1) <r, x>^2 / |x|^2,   eta = (d - 1) t^2 / (1 - t^2)

Codes minimise it by coordinate descent over the subspaces, centres by least
squares.  A query makes a table of its inner products with all centres; two
subspaces' tables are added up to one over byte values, so a candidate costs one
look-up per four dimensions.  The best of a block are ranked again exactly, with
all whose rough scores tie with theirs.  A block holds each distinct vector once, with
the smallest ids that have it, so copies take no places from other vectors.

Vectors lie in cells around coarse centres, and a query asks only the cells whose
mean has the largest inner products with it.  How many is measured: as many as
hold ``TARGET`` of the exact neighbours of sampled vectors within the sample.
Large cells are dealt into parts, and the queries of a cell too, so that no task
gets more than some blocks of either, whatever share of all vectors a cell has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm import tokens
from vellumine.plans.durable import materialise

#: Vectors of the fit, at most, by a hash of their ids; every vector is indexed.
SAMPLE = 10_000
#: Vectors of a candidate block, and queries of a query block.
CANDIDATES, QUERIES = 8_192, 512
#: Queries of a cell that one part of it is asked by, about.
ASKED = 64 * QUERIES
#: Cells at most: so many vectors of the sample stand for each.
CELL_SAMPLE = 20
#: Vectors of the sample that the number of probed cells is measured with, and the share of their neighbours that these hold.
MEASURED, TARGET = 400, 0.995
#: Distinct vectors of a block that are ranked exactly, for each neighbour wanted.
RERANK = 16
ROUNDS, SWEEPS, THRESHOLD = 8, 2, 0.2


@dataclass
class Codebook:
    """Centres per subspace, (subspaces, 16, 2), and the weight of parallel error."""

    dim: int
    centres: np.ndarray
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 5) -> Codebook:
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rng = np.random.default_rng(seed)
        x = _unit(x)
        parts = _split(x)
        start = parts[np.resize(rng.permutation(len(x)), 16)].transpose(1, 0, 2)
        book = cls(dim, start + rng.standard_normal(start.shape) * 1e-3, eta)
        for _ in range(ROUNDS):
            codes = book.encode(x)
            book._refit(parts, codes)
        return book

    def _refit(self, parts: np.ndarray, codes: np.ndarray) -> None:
        n, m, _ = parts.shape
        residual = parts - self.centres[np.arange(m), codes]
        along = (residual * parts).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            p, c = parts[:, j], codes[:, j]
            # <r, x> without this subspace's centre
            s = total - along[:, j] + (p * p).sum(axis=1)
            left = np.zeros((16, 2, 2))
            right = np.zeros((16, 2))
            np.add.at(left, c, np.eye(2) + (self.eta - 1) * p[:, :, None] * p[:, None, :])
            np.add.at(right, c, p + (self.eta - 1) * s[:, None] * p)
            used = np.bincount(c, minlength=16) > 0
            self.centres[j, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            now = ((p - self.centres[j, c]) * p).sum(axis=1)
            total += now - along[:, j]
            along[:, j] = now

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (vectors, subspaces) that minimise the loss."""
        return np.concatenate([self._encode(x[i : i + 2048]) for i in range(0, len(x), 2048)])

    def _encode(self, x: np.ndarray) -> np.ndarray:
        parts = _split(_unit(x))
        residual = parts[:, :, None, :] - self.centres
        across = (residual**2).sum(axis=3)
        along = (residual * parts[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        n, m = codes.shape
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(SWEEPS):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                codes[:, j] = (across[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
                total = rest + along[rows, j, codes[:, j]]
        return codes


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors that are not zero, (vectors, 1); squares neither vanish nor overflow."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return np.linalg.norm(x / most, axis=1, keepdims=True) * most


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split(x: np.ndarray) -> np.ndarray:
    """(vectors, subspaces, 2); an odd dimension is filled with zero."""
    if x.shape[1] % 4:
        x = np.pad(x, ((0, 0), (0, 4 - x.shape[1] % 4)))
    return x.reshape(len(x), -1, 2)


@dataclass
class Cells:
    """Coarse cells: directions that vectors are put by, means that queries choose by, and how cells are dealt."""

    directions: np.ndarray
    means: np.ndarray
    probes: int
    parts: np.ndarray
    query_parts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n: int, asked: int, k: int, target: float, seed: int = 3) -> Cells:
        """Spherical k-means over a sample x of n vectors, of which so many are asked."""
        count = max(1, min(-(-n // CANDIDATES), len(x) // CELL_SAMPLE))
        unit = _unit(x)
        directions = unit[np.random.default_rng(seed).permutation(len(x))[:count]]
        for _ in range(10 if count > 1 else 0):
            home = _best(unit, directions)
            sums = np.zeros_like(directions)
            np.add.at(sums, home, unit)
            directions = np.where(np.abs(sums).max(axis=1, keepdims=True) > 0, sums, directions)
            directions = _unit(directions)
        home = _best(unit, directions)
        scale = np.abs(x).max()
        means = np.zeros_like(directions)
        np.add.at(means, home, x / scale)
        sizes = np.bincount(home, minlength=count)
        means /= np.maximum(sizes, 1)[:, None]
        cells = cls(directions, means, count, np.ones(count, np.int64), np.ones(count, np.int64))
        chosen = cells.order(x[:MEASURED])
        if count > 1 and target < 1:
            cells.probes = _probes(x / scale, home, chosen, k, target)
        cells.parts = np.maximum(1, -(-sizes * n // (len(x) * CANDIDATES)))
        reach = np.bincount(chosen[:, : cells.probes].ravel(), minlength=count)
        cells.query_parts = np.maximum(1, -(-reach * asked // (len(chosen) * ASKED)))
        return cells

    def put(self, x: np.ndarray) -> np.ndarray:
        return _best(_unit(x), self.directions)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The cells of each query, best first."""
        return np.argsort(-(_unit(x) @ self.means.T), axis=1, kind="stable")


def _best(unit: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.concatenate([(unit[i : i + 4096] @ directions.T).argmax(axis=1) for i in range(0, len(unit), 4096)])


def _probes(x: np.ndarray, home: np.ndarray, chosen: np.ndarray, k: int, target: float) -> int:
    """How many of their cells hold the target share of the neighbours of the first vectors."""
    scores = x[: len(chosen)] @ x.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(chosen, axis=1)
    found = np.bincount(np.take_along_axis(place, home[near], axis=1).ravel(), minlength=chosen.shape[1])
    return int(np.searchsorted(np.cumsum(found) / found.sum(), target)) + 1


def _pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, (bytes, vectors)."""
    return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8).T)


def _usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


_DEALT = "cell int, part int, vec_id long, vector binary"
_BLOCK = "cell int, part int, ids binary, copies binary, scale binary, vectors binary, codes binary"


def _deal(cells, asks: bool):
    """Vectors by cell and part: the cell of each, or for queries those that they ask."""

    def run(batches):
        known: Cells = cells.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("vec_id"))
            x = np.asarray(batch.column("vector").flatten(), dtype=np.float64).reshape(len(ids), -1)
            if asks:
                cell = known.order(x)[:, : known.probes]
                row = np.repeat(np.arange(len(ids)), cell.shape[1])
                cell, parts = cell.ravel(), known.query_parts
            else:
                cell, row, parts = known.put(x), np.arange(len(ids)), known.parts
            part = (tokens.mix(ids.view(np.uint64))[row] % parts[cell].astype(np.uint64)).astype(np.int32)
            raw = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part), pa.array(ids[row]), pa.array([raw[r] for r in row], pa.binary())], names=["cell", "part", "vec_id", "vector"])

    return run


def _distinct(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by distinct vector, at most so many and the smallest of each; how many ids each has; the vectors."""
    rows = np.ascontiguousarray(x + 0.0)
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    again = (ids[1:] == ids[:-1]) & (group[1:] == group[:-1])
    once = np.concatenate([[True], ~again])
    ids, group = ids[once], group[once]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    ids, group = ids[place < most], group[place < most]
    return ids, np.bincount(group, minlength=len(first)), rows[first]


def _blocks(book, limit: int, most: int = 0):
    """Blocks of up to limit vectors of one part, over partitions sorted by (cell, part); with codes and distinct vectors, if there is a codebook."""

    def run(batches):
        name, held, size = None, [], 0

        def block():
            ids = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            ids, copies, x = _distinct(ids, x, most) if book else (ids, np.ones(len(ids), dtype=np.int64), x)
            codes = _pack(book.value.encode(x)).tobytes() if book else b""
            scale = _norm(x).ravel()
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in name), *(pa.array([v], pa.binary()) for v in (ids.tobytes(), copies.tobytes(), scale.tobytes(), x.tobytes(), codes))], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([np.asarray(batch.column(c)) for c in ("cell", "part")])
            ids = np.asarray(batch.column("vec_id"))
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if held and (name != tuple(where[:, a].tolist())):
                    yield block()
                    held, size = [], 0
                name = tuple(where[:, a].tolist())
                for i in range(a, b, limit):
                    held.append((ids[i : min(b, i + limit)], x[i : min(b, i + limit)]))
                    size += len(held[-1][0])
                    if size >= limit:
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    return run


def _leading(rough: np.ndarray, n: int) -> np.ndarray:
    """Places of at least n different values, the largest, and of all that tie with them."""
    want = n
    while want < len(rough):
        best = np.flatnonzero(rough >= np.partition(rough, -want)[-want])
        if len(np.unique(rough[best])) >= n:
            return best
        want = 2 * max(want, len(best))
    return np.arange(len(rough))


def _search(book, k: int, exact_only: bool):
    def run(batches):
        known: Codebook = book.value
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, ids, copies, scale, x, codes = (np.frombuffer(batch.column(c)[row].as_buffer(), dtype=kind) for c, kind in (("q_ids", "i8"), ("q_vectors", "f8"), ("ids", "i8"), ("copies", "i8"), ("scale", "f8"), ("vectors", "f8"), ("codes", "u1")))
                q, x = q.reshape(len(q_ids), -1), x.reshape(len(scale), -1)
                codes = codes.reshape(-1, len(scale)).astype(np.intp)
                first = np.cumsum(copies) - copies
                out = ([], [], [])
                tables = np.einsum("qmd,mkd->qmk", _split(q), known.centres).astype(np.float32)
                tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, 256)
                size = scale.astype(np.float32)
                for i, q_id in enumerate(q_ids):
                    if exact_only:
                        best = np.arange(len(scale))
                    else:
                        rough = np.take(tables[i, 0], codes[0])
                        for j in range(1, len(codes)):
                            rough += np.take(tables[i, j], codes[j])
                        rough *= size
                        best = _leading(rough, RERANK * k + 1)
                    # sums by row, the same for the same vector wherever it lies
                    exact, n = (x[best] * q[i]).sum(axis=1), copies[best]
                    at = np.repeat(first[best] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    exact, known_ids = np.repeat(exact, n), ids[at]
                    other = known_ids != q_id
                    exact, known_ids = exact[other], known_ids[other]
                    order = np.lexsort((known_ids, -exact))[:k]
                    out[0].append(np.full(len(order), q_id))
                    out[1].append(known_ids[order])
                    out[2].append(exact[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", exact: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest inner products per query.

    With ``exact`` every cell is asked and every vector ranked exactly.

    Queries are the rows where ``queries`` is true; candidates are all rows but
    those with the query's id.  Scores are in double precision over the given
    components; ties go to the smaller id.

    Null, empty and zero vectors and those with null or non-finite components
    take no part, nor do rows with a null id or with another dimension than most
    rows (of ties, the smaller).  Rows that repeat an id are one candidate, the
    best.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == dims[0]["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    x = np.asarray(sample.flatten(), dtype=np.float64).reshape(len(sample), -1)
    count = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("asked")).first()
    cells = Cells.fit(x, count["n"], count["asked"], k, 1.0 if exact else TARGET)
    book, dealing = spark.sparkContext.broadcast(Codebook.fit(x)), spark.sparkContext.broadcast(cells)

    def blocks(some: DataFrame, asks: bool, book, limit: int, most: int = 0) -> DataFrame:
        """Vectors or queries as blocks of one part each."""
        dealt = some.select("vec_id", "vector").mapInArrow(_deal(dealing, asks), _DEALT)
        tasks = int((cells.query_parts if asks else cells.parts).sum())
        return materialise(dealt.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_blocks(book, limit, most), _BLOCK))

    candidates = blocks(rows, False, book, CANDIDATES, k + 1)
    asked = blocks(rows.where("is_query"), True, None, QUERIES)

    def each(parts: np.ndarray) -> Column:
        """The numbers of a cell's parts of the other side."""
        return F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1) - 1))

    left = asked.select("cell", F.col("part").alias("query_part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), each(cells.parts).alias("part"))
    right = candidates.withColumn("query_part", each(cells.query_parts))
    keys, tasks = ["cell", "part", "query_part"], int((cells.parts * cells.query_parts).sum())
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_hash"), keys)
    found = met.select("q_ids", "q_vectors", "ids", "copies", "scale", "vectors", "codes").mapInArrow(_search(book, k, exact), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
