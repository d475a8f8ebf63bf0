"""Hashed word n-grams for the linear classifiers."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def fold(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper `bits` of a mixed 64-bit hash, as int32."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _B
        h = (h ^ (h >> np.uint64(29))) * _C
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def joined(parts: list[np.ndarray], kind: int) -> np.ndarray:
    """One hash for the same place of several arrays, in this order; `kind` keeps families of features apart."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), np.uint64(kind + 1) * _C, dtype=np.uint64)
        for p in parts:
            h = (h ^ p) * _A
            h ^= h >> np.uint64(31)
    return h
