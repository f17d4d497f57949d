"""Column builders over spectra: one array of doubles a frame.

All are plain expressions, so they stay in the JVM and push down; none needs a
shuffle. Arrays must not be null; empty ones give empty results or zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtide.schema import Band


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rms(a: Column) -> Column:
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def rises(now: Column, before: Column) -> Column:
    """max(now - before, 0) a bin; zeros if there is no frame before, or one of another size."""
    known = before.isNotNull() & (F.size(before) == F.size(now))
    return F.when(known, F.zip_with(now, before, lambda a, b: F.greatest(a - b, F.lit(0.0)))).otherwise(F.transform(now, lambda a: F.lit(0.0)))


def log_magnitude(a: Column, gain: float = 1000.0) -> Column:
    return F.transform(a, lambda m: F.log1p(F.lit(gain) * m) / F.lit(math.log1p(gain)))


def wrapped(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    turn = F.lit(2 * math.pi)
    return x - turn * F.floor((x + F.lit(math.pi)) / turn)


def harmonic(magnitude: Column, mask: Column) -> Column:
    return F.zip_with(magnitude, mask, lambda m, s: m * s)


def percussive(magnitude: Column, mask: Column) -> Column:
    return F.zip_with(magnitude, mask, lambda m, s: m * (F.lit(1.0) - s))


def percussive_flux(flux: Column, mask: Column) -> Column:
    return F.zip_with(flux, mask, lambda m, s: m * F.sqrt(F.lit(1.0) - s))


#: Semitone offsets of harmonics 2 to 6, and the share of the fundamental each has.
HARMONICS = tuple((round(12 * math.log2(k)), 0.5 ** (k - 1)) for k in range(2, 7))


def collapse_harmonics(a: Column, of: Column | None = None, harmonics=HARMONICS) -> Column:
    """Takes from each bin what lower bins predict as their harmonics.

    Values are non-negative, so that clamping once equals clamping after every
    subtraction. With ``of`` (the magnitudes), only bins that sound predict.
    """
    def left(x: Column, j: Column) -> Column:
        out = x
        for offset, share in harmonics:
            lower = F.when(j >= offset, F.get(a, j - offset)).otherwise(F.lit(0.0))
            if of is not None:
                lower = F.when((j >= offset) & (F.get(of, j - offset) > 0), lower).otherwise(F.lit(0.0))
            out = out - lower * F.lit(share)
        return F.greatest(out, F.lit(0.0))

    return F.transform(a, left)


def reflected(a: Column, half: int) -> Column:
    """a with ``half`` mirrored values on either side, the edge itself not repeated."""
    return F.concat(F.reverse(F.slice(a, 2, half)), a, F.reverse(F.slice(a, F.size(a) - half, F.lit(half))))


def sliding_median(a: Column, kernel: int) -> Column:
    """Median over ``kernel`` (odd) neighbouring bins, edges reflected."""
    padded = reflected(a, kernel // 2)
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.get(F.array_sort(F.slice(padded, i, F.lit(kernel))), F.lit(kernel // 2)))


def a_weight(f: float) -> float:
    """Linear gain of the IEC 61672 A curve, 1 at 1 kHz."""
    def r(x: float) -> float:
        s = x * x
        return 12194.0**2 * s * s / ((s + 20.6**2) * math.sqrt((s + 107.7**2) * (s + 737.9**2)) * (s + 12194.0**2))

    return r(f) / r(1000.0) if f > 0 else 0.0


def a_weights(freqs) -> list[float]:
    return [a_weight(f) for f in freqs]


def bins(freqs, lo: float, hi: float) -> list[int]:
    """Places of the axis in [lo, hi)."""
    return [i for i, f in enumerate(freqs) if lo <= f < hi]


def band(a: Column, freqs, b: Band) -> Column:
    """The part of a rising axis in a band."""
    own = bins(freqs, b.lo, b.hi)
    return F.slice(a, own[0] + 1, len(own)) if own else F.slice(a, 1, 0)


def uniform_weights(freqs, lo: float, hi: float) -> list[float]:
    """Equal weights in [lo, hi) that sum to 1, or none."""
    own = set(bins(freqs, lo, hi))
    return [1.0 / len(own) if i in own else 0.0 for i in range(len(freqs))]
