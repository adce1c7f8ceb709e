"""Arrays of numbers as short binaries, for what travels between tasks."""

from __future__ import annotations

import numpy as np
import zstandard

_KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one frame, their bytes transposed, so that equal high bytes compress away."""
    parts = [np.array([len(arrays)] + [x for a in arrays for x in (len(a), a.itemsize)], "<u4").tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shape, at, out = np.frombuffer(raw, "<u4", 2 * n, 4).tolist(), 4 + 8 * n, []
    for size, item in zip(shape[::2], shape[1::2]):
        x = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size)
        out.append(np.ascontiguousarray(x.T).reshape(-1).view(_KINDS[item]))
        at += size * item
    return out


def distinct(*arrays: np.ndarray) -> np.ndarray:
    """The distinct numbers of the arrays, ascending; by sorting, which is faster than hashing here."""
    x = np.sort(np.concatenate(arrays))
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def small(a: np.ndarray) -> np.ndarray:
    """a in the smallest unsigned type that holds it."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0)).astype(np.uint64)
