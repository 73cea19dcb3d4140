"""Arrays as small compressed values that Spark can shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    if a.dtype.kind not in "iu" or not len(a):
        return a
    kind = np.result_type(np.min_scalar_type(a.min()), np.min_scalar_type(a.max()))
    return a.astype(kind) if kind.kind in "iu" else a


def packed(*arrays: np.ndarray) -> list[tuple[str, int, bytes]]:
    """Each array by the planes of its bytes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(_narrow(a))
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out.append((a.dtype.str, len(a), pa.compress(planes, codec="zstd", asbytes=True)))
    return out


def unpacked(values: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """The arrays again, as copies; whole numbers are 64 bits wide."""
    out = []
    for kind, n, data in values:
        kind = np.dtype(kind)
        planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
        a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)
        out.append(a.astype(np.int64 if kind.kind in "iu" else kind))
    return out
