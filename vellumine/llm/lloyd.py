"""Vector code compression by product quantisation, fitted with delta-maintained Lloyd rounds.

Vectors become integers and are cut into parts; each part position has its own
codebook.  A round assigns every part to its nearest entry and moves the entries
to the means of their parts.  The sums behind the means are kept from round to
round: an assignment is written with the one before it, and only parts whose
assignment changed are subtracted from their old entry and added to their new
one.  So what a round shuffles is as much as moved, added up in each task first,
and never more than a row per task and component of a codebook.

Vectors stay in their partitions throughout.  The driver holds the codebooks
alone, whose size does not depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.plans.durable import discard, materialise
from vellumine.plans.skew import meet

#: Vectors whose distances are computed together.
BLOCK = 2048

_STATE = "id long, label {label}, x array<long>, code binary, old binary"
_DELTA = "slot int, position int, delta long"


def _usable(vector: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower of equals, and the squared distance; exact.

    ``x`` is (vectors, parts, width), ``book`` (parts, entries, width), integers.
    """
    best = np.empty(x.shape[:2], dtype=np.int64)
    far = np.empty(x.shape[:2], dtype=np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # below 2**53 doubles hold these integers exactly; beyond 2**63 no long holds the sum of the squares
    if x.shape[1] * x.shape[2] * 4 * most * most >= 2**63:
        raise ArithmeticError("components are too large for exact errors in 64 bits")
    kind = np.float64 if x.shape[2] * 4 * most * most < 2**53 else np.int64
    for part in range(x.shape[1]):
        a, b = x[:, part].astype(kind), book[part].astype(kind)
        distance = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        best[:, part] = distance.argmin(1)
        far[:, part] = distance[np.arange(len(a)), best[:, part]]
    return best, far


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), parts, -1)


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _assign(book: np.ndarray):
    """Assignments to the codebook, with those that stood before."""

    def run(batches):
        for batch in _blocks(batches):
            best, _ = _nearest(_matrix(batch.column("x"), len(book)), book)
            codes = pa.array([row.tobytes() for row in best.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("x"), codes, batch.column("code")], names=["id", "label", "x", "code", "old"])

    return run


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, parts).astype(np.int64)


def _moves(shape: tuple[int, int, int]):
    """What a task's parts take from their old entries and give to their new ones.

    Position -1 is the number of parts, the others are components.
    """
    parts, entries, width = shape

    def run(batches):
        total = np.zeros((parts * entries, width + 1), dtype=np.int64)
        at = np.arange(parts) * entries
        for batch in _blocks(batches):
            x = _matrix(batch.column("x"), parts)
            new, old = _codes(batch.column("code"), parts), batch.column("old")
            first = np.array([v is None for v in old.to_pylist()], dtype=bool)
            before = np.full_like(new, -1)
            if not first.all():
                before[~first] = _codes(old.filter(pa.array(~first)), parts)
            vector, part = np.nonzero(new != before)
            gain = np.concatenate([np.ones((len(vector), 1), dtype=np.int64), x[vector, part]], axis=1)
            np.add.at(total, at[part] + new[vector, part], gain)
            left = before[vector, part] >= 0
            np.subtract.at(total, (at[part] + before[vector, part])[left], gain[left])
        slot, position = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(position - 1, pa.int32()), pa.array(total[slot, position], pa.int64())], names=["slot", "position", "delta"])

    return run


def _coded(book: np.ndarray):
    def run(batches):
        for batch in _blocks(batches):
            best, far = _nearest(_matrix(batch.column("x"), len(book)), book)
            codes = pa.array([row.tobytes().hex() for row in best.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(far.sum(1), pa.int64())], names=["id", "label", "code", "error"])

    return run


def _book(sums: DataFrame, before: np.ndarray) -> np.ndarray:
    """Entries at the floored means of their parts; unused ones stay.  A row per component comes to the driver."""
    parts, entries, width = before.shape
    total = np.zeros((parts * entries, width + 1), dtype=np.int64)
    for slot, position, value in sums.collect():
        total[slot, position + 1] = value
    count, total = total[:, :1], total[:, 1:]
    moved = np.where(count > 0, total // np.maximum(count, 1), before.reshape(parts * entries, width))
    return moved.reshape(before.shape)


@dataclass
class Compressed:
    """What was fitted: ``codes`` (id, label, code, error), and the codebooks (parts, entries, width)."""

    codes: DataFrame
    book: np.ndarray

    def book_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Compressed:
    """Codes of all usable vectors, after so many Lloyd rounds from the first ones by id.

    A component x becomes floor(scale * x).  The codebook of a part position
    starts as that part of the vectors with the smallest ids; where these are
    fewer than ``entries``, it has so many entries.  All arithmetic is exact.

    Null and empty vectors, and those with a component that is null or not
    finite, take no part.  A null id comes after all others, and of equal ids
    the smaller vector first; repeated rows count as often as they stand.  Vectors of
    several lengths, or of one that the parts don't divide, are a ValueError, and
    components whose squares 64 bits can't add up an ArithmeticError.  Other
    columns are ignored; an empty table gives an empty one.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is a byte")
    spark = vectors.sparkSession
    label = vectors.schema[label_column].dataType.simpleString()
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    named = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v")).where(_usable(F.col("v")))
    old: list[str] = []
    state = materialise(named.select("id", "label", whole.alias("x"), F.lit(None).cast("binary").alias("code")), old)
    lengths = state.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None:
        return Compressed(state.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), dtype=np.int64))
    if lengths[0] != lengths[1] or lengths[0] % parts:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} components; all must have as many, a multiple of {parts}")
    first = state.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    book = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    sums = None
    for _ in range(rounds):
        made: list[str] = []
        state = materialise(state.mapInArrow(_assign(book), _STATE.format(label=label)), made)
        moved = state.where("old is null or code != old").mapInArrow(_moves(book.shape), _DELTA)
        if sums is not None:
            moved = moved.unionByName(sums.withColumnRenamed("total", "delta"))
        sums = materialise(moved.groupBy("slot", "position").agg(F.sum("delta").alias("total")), made)
        discard(spark, old)
        old = made
        book = _book(sums, book)
    return Compressed(state.select("id", "label", "x").mapInArrow(_coded(book), f"id long, label {label}, code string, error long"), book)


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors of all rows with an equal label; nulls are equal.

    One label may hold any share of the rows.
    """
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    # null is a label like others, but no key of a join
    keyed = [x.withColumn("_key", F.to_json(F.struct("label"))) for x in (codes, materialise(sums))]
    return meet(keyed[0], keyed[1].drop("label"), ["_key"], "n").drop("_key", "n")


def digest(found: Compressed) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``; the codes are written once and read for both sums and rows."""
    rows = with_label_error(materialise(found.codes))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.book_sha256()).alias("codebooks_sha256"))
