"""Scalar maths.  A value within 1e-7 of zero counts as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-7


def is_zero(x: Column) -> Column:
    return F.abs(x) < ZERO


def nonzero_min(a: Column, b: Column) -> Column:
    return F.when(is_zero(a), b).when(is_zero(b), a).otherwise(F.least(a, b))


def nonzero_max(a: Column, b: Column) -> Column:
    return F.when(is_zero(a), b).when(is_zero(b), a).otherwise(F.greatest(a, b))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(is_zero(b), F.lit(0.0)).otherwise(a / b)


def round_to(x: Column, z: float) -> Column:
    """Rounded half up to 1/z."""
    return F.floor(x * z + 0.5) / z


def zoom_down(x: Column, z: int) -> Column:
    return (F.floor(x / z) * z).cast("long")


def zoom_up(x: Column, z: int) -> Column:
    return (F.ceil(x / z) * z).cast("long")


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def int_log10(x: Column) -> Column:
    """Digits after the first of a whole number of 1 or more; 0 for less."""
    return F.when(x < 1, 0).otherwise(F.length(x.cast("long").cast("string")) - 1)


def low_mask(n: int) -> int:
    return (1 << n) - 1


def remove_bit(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << n)))


def between(x: Column, a, b) -> Column:
    """Between two bounds in either order, both included."""
    a, b = F.lit(a), F.lit(b)
    return x.between(F.least(a, b), F.greatest(a, b))


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Ranges that share more than 0.001, or touch."""
    lo = F.greatest(F.least(a1, a2), F.least(b1, b2))
    hi = F.least(F.greatest(a1, a2), F.greatest(b1, b2))
    return (hi - lo > 0.001) | (hi == lo)


def price(x: Column, decimals: int, wide: bool = False) -> Column:
    """The tagged-scale decimal nearest to x, or null if x doesn't fit: as many decimals as asked for, as
    long as the magnitude has room (28 bits and 6 decimals, or 58 bits and 30)."""
    limit, most = ((1 << 58) - 1, 18) if wide else ((1 << 28) - 1, 6)
    scales = range(min(decimals, most), -1, -1)
    size = F.abs(x.cast("double"))
    out = F.lit(None).cast("double")
    for s in reversed(scales):
        m = F.floor(size * 10**s + 0.5)
        out = F.when(m <= limit, F.signum(x.cast("double")) * m / 10**s).otherwise(out)
    return out


def price_scale(x: Column, decimals: int, wide: bool = False) -> Column:
    """The number of decimals that ``price`` keeps; null if x doesn't fit, 0 for zero."""
    limit, most = ((1 << 58) - 1, 18) if wide else ((1 << 28) - 1, 6)
    size, out = F.abs(x.cast("double")), F.lit(None).cast("int")
    for s in range(min(decimals, most) + 1):
        out = F.when(F.floor(size * 10**s + 0.5) <= limit, F.lit(s)).otherwise(out)
    return F.when(size == 0, F.lit(0)).otherwise(out)


def random_int(lo: int, hi: int, seed: int, *by: Column) -> Column:
    """A whole number of a closed range, in either order, drawn by a row's values and a seed."""
    lo, hi = min(lo, hi), max(lo, hi)
    return (F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(hi - lo + 1)) + lo).cast("int")


def random_double(lo: float, hi: float, seed: int, *by: Column) -> Column:
    """In thousandths, which the ends are cut to; a range without thousandths gives its start."""
    a, b = int(lo * 1000), int(hi * 1000)
    return F.lit(float(lo)) if a == b else random_int(a, b, seed, *by) / 1000


def random_score(most: int, least: int, seed: int, *by: Column) -> Column:
    """How many of ``least`` draws from 0 to ``most`` are below ``least``; 0 for bounds below 1 or turned about."""
    if most < 1 or least < 1 or most < least:
        return F.lit(0)
    draws = F.transform(F.sequence(F.lit(1), F.lit(least)), lambda i: random_int(0, most, seed, *by, i))
    return F.size(F.filter(draws, lambda x: x < least))
