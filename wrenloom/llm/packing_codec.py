"""Several numpy arrays in one binary cell, for shuffles in which a row for each value would be mostly overhead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays' lengths, then their bytes."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(cell: bytes, *kinds: str) -> list[np.ndarray]:
    """What pack() packed; kinds: the dtype of each array."""
    sizes = np.frombuffer(cell, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(cell, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def joined(cells: list[bytes], *kinds: str) -> list[np.ndarray]:
    """unpack() of several cells, end to end."""
    parts = [unpack(c, *kinds) for c in cells]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def squeezed(cell: bytes) -> bytes:
    """The cell compressed with zstd, which takes prose to far less than the codec of Spark's shuffles does."""
    return len(cell).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(cell, asbytes=True)


def loosened(cell: bytes) -> bytes:
    """What squeezed() compressed."""
    return pa.decompress(memoryview(cell)[8:], decompressed_size=int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)
