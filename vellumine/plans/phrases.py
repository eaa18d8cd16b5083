"""Finding many phrases in texts, by hashes of whole words.

Texts and phrases are words parted by single spaces, one also at either end.  A
broadcast holds two hashes a phrase, however long it is, and every text is read
once, where it stands.  What meets a hash is told by its own text, so that a join
with the phrases is exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that one reading of the texts looks for; more take another.
AT_ONCE = 4_000_000
#: Bytes of text that are hashed together.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of stretches of up to n bytes of text, each from sums up to its ends."""

    def __init__(self, n: int):
        # modulo 2**64, by which every odd number has an inverse
        self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def read(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return (x ^ (x >> np.uint64(29))) * np.uint64(_BASE)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where its rows start and the last ends."""
    _, offsets, data = column.cast(pa.large_string()).buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _hashed(batches):
    for batch in batches:
        out = []
        for name in ("needle", "head"):
            data, rows = _bytes(batch.column(name))
            hashes, longest = np.zeros(len(batch), dtype=np.uint64), int(np.diff(rows).max(initial=0))
            hasher, i = _Hasher(SEGMENT + longest), 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(rows, rows[i] + SEGMENT)) - 1)
                hasher.read(data[rows[i] : rows[j]])
                hashes[i:j] = hasher.of(rows[i:j] - rows[i], rows[i + 1 : j + 1] - rows[i])
                i = j
            out.append(pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("n"), *out], names=["n", "needle", "head"])


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _search(shared):
    def run(batches):
        least, longest, heads, of_words = shared.value
        hasher = _Hasher(SEGMENT + longest)
        for batch in batches:
            data, rows = _bytes(batch.column("hay"))
            for at in range(0, len(data), SEGMENT):
                # a phrase that starts here ends in this part
                part = data[at : at + SEGMENT + longest]
                spaces = np.flatnonzero(part == 32)
                hasher.read(part)
                first = np.arange(min(np.searchsorted(spaces, SEGMENT), max(0, len(spaces) - least)))
                first = first[_among(hasher.of(spaces[first], spaces[first + least] + 1), heads)]
                found: dict[tuple[int, str], None] = {}
                for n, hashes in of_words.items():
                    i = first[first + n < len(spaces)]
                    starts, ends = spaces[i], spaces[i + n] + 1
                    met = _among(hasher.of(starts, ends), hashes)
                    starts, ends = starts[met], ends[met]
                    row = np.searchsorted(rows, starts + at, side="right") - 1
                    found |= {(r, part[s:e].tobytes().decode()): None for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist())}
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([r for r, _ in found])), pa.array([text for _, text in found], pa.string())], names=["id", "needle"])

    return run


def find_phrases(hay: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(id, needle)`` of the phrases (needle) in each of the texts (id, hay), as whole words.

    A pair may repeat, and rarely a needle is told that is no phrase.  Texts are
    read once for every ``AT_ONCE`` phrases.  Phrases hold a word or more.
    """
    spark, kind = hay.sparkSession, hay.schema["id"].dataType.simpleString()
    bare = F.trim("needle")
    rows = phrases.select("needle", F.size(F.split(bare, " ")).alias("n"))
    number, least, longest = rows.agg(F.count("*"), F.min("n"), F.max(F.octet_length("needle"))).first()
    shards = max(1, -(-number // AT_ONCE))
    headed = rows.select("n", "needle", F.concat(F.lit(" "), F.substring_index(bare, " ", least or 1), F.lit(" ")).alias("head"), F.pmod(F.xxhash64("needle"), F.lit(shards)).alias("shard"))
    found = [hay.select("id", F.lit("").alias("needle")).where("false")]
    for shard in range(shards):
        hashes = headed.where(F.col("shard") == shard).mapInArrow(_hashed, "n int, needle long, head long").toPandas()
        if len(hashes):
            of_words = {int(n): np.unique(own["needle"].to_numpy().view(np.uint64)) for n, own in hashes.groupby("n")}
            shared = spark.sparkContext.broadcast((least, longest, np.unique(hashes["head"].to_numpy().view(np.uint64)), of_words))
            found.append(hay.mapInArrow(_search(shared), f"id {kind}, needle string"))
    return reduce(DataFrame.unionByName, found)
