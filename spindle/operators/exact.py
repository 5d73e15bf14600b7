"""Exact integer convolution by floating transforms: limbs, and the bound that tells how many are needed.

The rounded result of a transform of length N is exact while its error stays below 1/2. With u = 2^-53 the error of a
product of spectra is at most about ``16 u log2(N) |a| |b|`` (Euclidean norms; the factor holds the constants of forward and
inverse transforms with room). Integers too large for that are cut into balanced limbs, each pair of limbs is filtered on its own, and the exact
parts are put together by shifts modulo 2^64 - the exact value if it fits a BIGINT at all, else an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor, log2

import numpy as np

MOST = 8  # limbs of a 64-bit integer, at most


def room(n_fft: int, width: int) -> int:
    """Largest sum of bits of two operands (of n_fft and width entries) whose products round exactly."""
    return floor(53 - 2 - log2(16 * max(1.0, log2(n_fft))) - 0.5 * (log2(n_fft) + log2(max(1, width))))


@dataclass(frozen=True)
class Limbs:
    """Base bits and number of limbs of samples and taps. One limb is the number itself."""

    x_bits: int
    x_count: int
    h_bits: int
    h_count: int

    def shift(self, i: int, j: int) -> int:
        return i * self.x_bits + j * self.h_bits


def _bits(total: int, count: int) -> tuple[int, int]:
    """(base bits, bits of the largest limb) of ``count`` balanced limbs of a number of ``total`` bits."""
    if count == 1:
        return 0, total
    base = -(-(total + 1) // count)
    return base, base - 1


def plan(x_max: int, h_max: int, n_fft: int, width: int) -> Limbs:
    """The fewest limb pairs for samples and taps of these magnitudes."""
    tx, th, most = int(x_max).bit_length(), int(h_max).bit_length(), room(n_fft, width)
    best = None
    for cx in range(1, MOST + 1):
        for ch in range(1, MOST + 1):
            (bx, mx), (bh, mh) = _bits(tx, cx), _bits(th, ch)
            if mx + mh <= most and (best is None or cx * ch < best.x_count * best.h_count):
                best = Limbs(bx, cx, bh, ch)
    if best is None:
        raise ValueError(f"no split into {MOST} limbs is exact for transforms of {n_fft} entries and {width} taps")
    return best


def split(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Balanced limbs of int64 numbers, lowest first, as float64; their weighted sum is x."""
    if count == 1:
        return [x.astype(np.float64)]
    out, half, mask = [], np.int64(1 << (bits - 1)), np.int64((1 << bits) - 1)
    for _ in range(count - 1):
        low = (x & mask) - ((x & half) << 1)
        out.append(low.astype(np.float64))
        x = (x - low) >> np.int64(bits)
    return [*out, x.astype(np.float64)]


class Sum:
    """The limb products put together: exact modulo 2^64, with a floating estimate that shows what does not fit."""

    def __init__(self, shape):
        self.exact = np.zeros(shape, np.int64)
        self.near = np.zeros(shape)

    def add(self, part: np.ndarray, shift: int) -> None:
        whole = np.rint(part)
        if shift < 64:
            with np.errstate(over="ignore"):
                self.exact += whole.astype(np.int64) << np.int64(shift)
        self.near += whole * 2.0 ** shift

    def values(self) -> np.ndarray:
        if self.near.size and np.abs(self.near).max() >= 2.0 ** 63:
            raise OverflowError("a filtered value does not fit a BIGINT")
        return self.exact
