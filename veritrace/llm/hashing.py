"""Mixing of 64-bit numbers, and packed arrays of whole numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, by hash."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def pack(x: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed: high bytes of small numbers cost nearly nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()
