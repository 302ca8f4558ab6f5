"""Series functions that walk their values: numpy on one key's ordered series (``per_key``).

Each function takes an array and gives a number (or a tuple) and is tested by itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

#: Speeds within it have no sign.
BAND = 0.01


def per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, function: Callable, outputs: str) -> DataFrame:
    """``function(array)`` of each key's series; ``outputs`` is a DDL list of its results.  A key's series
    must fit one task."""
    import pandas as pd

    kept = df.select(*keys, *[c for c in order if c not in keys], value) if value not in order else df.select(*keys, *order)
    names = [x.strip().split(" ")[0] for x in outputs.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = function(pdf.sort_values(list(order))[value].to_numpy(dtype=float))
        return pd.DataFrame([[*key, *(out if isinstance(out, tuple) else (out,))]], columns=[*keys, *names])

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)
    return kept.groupBy(*keys).applyInPandas(run, f"{schema}, {outputs}")


def normalised(y: np.ndarray, low: float = 0.0, high: float = 0.0) -> np.ndarray:
    """Values between the bounds (the series' own, if both are 0) from 0.001 to 0.999; beyond them, those."""
    if low == 0 and high == 0:
        low, high = y.min(), y.max()
    return np.full(len(y), 0.001) if high <= low else 0.001 + np.clip((y - low) / (high - low), 0, 1) * 0.998


def _turn(s: np.ndarray, sign: int, rate: float) -> int:
    """How far the series gets from its first value upwards (sign 1) or downwards (-1): the last of the new
    extremes that follow each other once one is more than ``rate`` of the first value away; -1 without one."""
    top = np.maximum.accumulate(sign * s)
    new = sign * s[1:] > top[:-1]
    far = np.flatnonzero(new & (sign * (s[1:] - s[0]) / s[0] > rate))
    if not len(far):
        return -1
    ends = np.flatnonzero(~new[far[0] :])
    return int(far[0] + ends[0]) if len(ends) else len(s) - 1


def nearest_trend(y: np.ndarray, rate: float, low: float = 0.0, high: float = 0.0, forward: bool = False) -> tuple[int, int, float, float]:
    """(direction, offset, change, slope) of the trend at the start (forward) or the end of a series.

    From the first (last) value on, the nearest extreme that is more than ``rate`` of it away, and isn't passed
    by the next value, is the turning point: ``offset``; without one it is the other end, and the direction 0.
    Backward, 1 is a rise and -1 a fall up to the last value.  Forward, 1 is a rise before any fall or a pure
    fall, and -1 the reverse.  ``slope`` is that of a line through the part, normalised within the bounds
    (its own, if both are 0); ``change`` is relative to the first (last) value, which without a turning point
    is compared with the line's start.  Fewer than 3 values, or one near 0: no trend, ``rate`` as it is.
    """
    n = len(y)
    if n < 3 or abs(y[0] if forward else y[-1]) < 1e-5:
        return 0, max(n - 1, 0) if forward else 0, rate, 0.0
    s = y if forward else y[::-1]
    up, down = _turn(s, 1, rate), _turn(s, -1, rate)
    at = min((i for i in (up, down) if i >= 0), default=n - 1)
    if up < 0 and down < 0:
        direction = 0
    elif forward:
        direction = -1 if up > down else 1
    else:
        direction = -1 if at == up else 1
    part = y[: at + 1] if forward else y[n - 1 - at :]
    line = np.polynomial.polynomial.polyfit(np.arange(len(part), dtype=float), normalised(part, low, high), 1)
    if at == n - 1:
        start = (high - low) * line[0] / 0.998 + low
        change = (start - s[0]) / s[0] if forward else (s[0] - start) / s[0]
    else:
        change = (s[at] - s[0]) / s[0] if forward else (s[0] - s[at]) / s[0]
    return direction, at if forward else n - 1 - at, float(change), float(line[1])


def resample(y: np.ndarray, n: int) -> np.ndarray:
    """A series of n points: too many become averages of neighbours, one fewer each time; too few get midpoints
    between neighbours.  Of fewer than 2 points nothing can be made: zeros."""
    s = np.asarray(y, dtype=float)
    if len(s) < 2:
        return np.zeros(n)
    while len(s) < n:
        wide = np.empty(2 * len(s) - 1)
        wide[::2], wide[1::2] = s, (s[:-1] + s[1:]) / 2
        s = wide
    while len(s) > n:
        s = (s[1:] + s[:-1]) / 2
    return s


def _signed_byte(bits: int) -> int:
    return (bits + 128) % 256 - 128


def trend_bits(y: np.ndarray, level: int) -> int:
    """A bit for each of ``level`` steps of the resampled series, set where it doesn't fall; the newest step is
    the highest.  The result is a signed byte: of more than 8 steps the oldest 8 stay."""
    s = resample(y, level + 1)
    return _signed_byte(sum(1 << i for i in range(level) if s[i + 1] >= s[i])) if len(y) > 1 else 0


def pair_bits(ask: np.ndarray, bid: np.ndarray, level: int) -> int:
    """A bit where ask >= bid for ``level`` points of both resampled series, but for the first point; the
    newest is the highest of a signed byte."""
    a, b = resample(ask, level), resample(bid, level)
    return _signed_byte(sum(1 << (i - 1) for i in range(1, level) if a[i] >= b[i])) if len(ask) > 1 else 0


def factor_decode(code: int, level: int = 3) -> int:
    """The last ``level`` digits of a code as bits, the last digit being the highest; 0 for a code without mark."""
    if code < 10**level:
        return 0
    return sum((code // 10**i % 10 > 0) << (level - 1 - i) for i in range(level))


def speed(newest_first: np.ndarray) -> int:
    """Of the newest run of one sign: +-1 if its mean step is above its first step, seen in the direction of the
    run, +-2 if not; the sign is the run's.  Values within the band before the run's first value beyond it belong
    to it; fewer than 3 values, or none beyond the band: 0."""
    x = np.asarray(newest_first, dtype=float)
    beyond = np.flatnonzero(np.abs(x) > BAND)
    if not len(beyond):
        return 0
    sign = 1 if x[beyond[0]] > 0 else -1
    ends = np.flatnonzero(sign * x[beyond[0] + 1 :] < BAND)
    n = beyond[0] + 1 + ends[0] if len(ends) else len(x)
    if n < 3:
        return 0
    steps = np.diff(x[:n]).tolist()
    return sign * (1 if sign * (sum(steps) / (n - 1) - steps[0]) > 0 else 2)
