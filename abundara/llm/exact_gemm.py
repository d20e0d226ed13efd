"""Exact integer matrix products by way of floating-point BLAS.

Integers are split into limbs so small that every sum of limb products stays below 2^53, where float64 is exact
whatever the order of additions; products of limbs are shifted and added in int64. Where even the result may leave
64 bits, Python's integers recombine the same limb products.
"""

from __future__ import annotations

import numpy as np

#: Integers below this are exact in float64.
EXACT_BITS = 53


def limb_bits(inner: int) -> int:
    """Width of limbs for sums of `inner` products."""
    return max(1, (EXACT_BITS - max(0, int(inner - 1).bit_length())) // 2)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs, least first: all but the last in [0, 2^bits), the last with the sign. At least one."""
    out, rest = [], x
    while largest(rest) >= 1 << bits:
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: int64, or Python integers where the sums may not fit."""
    inner = a.shape[1]
    bits = limb_bits(inner)
    fits = inner * largest(a) * largest(b) < 1 << 62
    out = np.zeros((len(a), len(b)), np.int64 if fits else object)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            part = (x @ y.T).astype(np.int64)
            out += part << (bits * (i + j)) if fits else part.astype(object) * (1 << (bits * (i + j)))
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Squared length of each row, exact."""
    wide = a if a.shape[1] * largest(a) ** 2 < 1 << 62 else a.astype(object)
    return (wide * wide).sum(axis=1) if a.shape[1] else np.zeros(len(a), np.int64)
