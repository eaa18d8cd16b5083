"""Byte-level word splitting and hashing, vectorised with numpy.

Every routine works on the raw UTF-8 bytes of many documents at once.  A word
is a maximal run of bytes that an alphabet calls word bytes; A-Z is lowered,
if asked for, nothing else is folded.  Words become 64-bit polynomial hashes, so no Python
object is made per word.  Work memory is bounded by ``SEGMENT`` bytes of text
(or by the longest single word), however long a document is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together.
SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of anything but space and the controls 9 to 13.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: Words are runs of digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True

_TABLE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def _spans(data: np.ndarray, rows: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses one of the offsets in rows."""
    inside = alphabet[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[rows[rows < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = table[data[at]] * _power(int(lengths.max()))[within]
        return mix(np.add.reduceat(terms, first) ^ lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, rows: np.ndarray, alphabet: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: hashes, starts, ends, and each row's first word.

    ``first[i]:first[i + 1]`` are the words of row i.  Without ``fold`` A-Z differ from a-z.
    """
    starts, ends = _spans(data, rows, alphabet)
    table = _TABLE[_LOWER] if fold else _TABLE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT)))
        out[i:j] = _hash(data, starts[i:j], ends[i:j], table)
        i = j
    return out, starts, ends, np.searchsorted(starts, rows)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words; of the whole sequence, if it is shorter."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * _BASE + words[k : n - width + 1 + k])
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of a batch with about limit bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0), dtype=np.int64)
    reach = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def parts(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch, column, limit)
    release()


def release() -> None:
    """Give memory that a task has freed back to the machine, for its worker stays and waits for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # another C library has no such call
        return
