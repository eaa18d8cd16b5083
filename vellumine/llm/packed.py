"""Arrays packed into one binary, so that a row of an exchange carries thousands of values."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

_HEAD = "<3sQQ"


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary: like bytes side by side, compressed."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        body = zstandard.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if len(raw) else b"", 1)
        out += [struct.pack(_HEAD, raw.dtype.str.encode(), len(raw), len(body)), body]
    return b"".join(out)


def load(payload: pa.Buffer | bytes) -> list[np.ndarray]:
    payload = memoryview(payload)
    out, at = [], 1
    for _ in range(payload[0]):
        kind, n, size = struct.unpack_from(_HEAD, payload, at)
        at += struct.calcsize(_HEAD)
        dtype = np.dtype(kind.decode())
        raw = np.frombuffer(zstandard.decompress(payload[at : at + size]), dtype=np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.zeros(0, dtype))
        at += size
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the differences of neighbours, which compress better."""
    return np.diff(keys, prepend=np.uint64(0))


def keys(gap: np.ndarray) -> np.ndarray:
    """What ``gaps`` was made from."""
    return np.cumsum(gap, dtype=np.uint64)
