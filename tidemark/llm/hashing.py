"""Hashes over byte arrays, vectorized with 64-bit wrap-around."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 ... BASE^(n-1) and the same of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 14, 2 * len(_powers["up"]))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their gaps, as many planes as the largest gap needs."""
    gaps = np.diff(values, prepend=U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.uint32(len(values)).tobytes() + bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpacked_sorted(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, n * width, 5).reshape(width, n).T
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=U)
