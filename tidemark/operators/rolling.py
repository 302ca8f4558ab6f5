"""Rolling windows, normalisation and ranking over the rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import is_zero

LOW, HIGH = 0.001, 0.999


def frame(keys: Sequence[str], order: Sequence[str], n: int):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Sum, average, least and greatest of the last n rows (fewer at the start)."""
    w = frame(keys, order, n)
    return df.select("*", F.sum(value).over(w).alias("roll_sum"), F.avg(value).over(w).alias("roll_avg"), F.min(value).over(w).alias("roll_min"), F.max(value).over(w).alias("roll_max"))


def last_avg(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int, out: str = "last_avg") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(frame(keys, order, k)))


def volatility(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, out: str = "volatility") -> DataFrame:
    """Mean of |change / value| over the newest n steps."""
    by = Window.partitionBy(*keys).orderBy(*order)
    step = F.abs((F.col(value) - F.lag(value).over(by)) / F.nullif(F.col(value), F.lit(0.0)))
    return df.withColumn("__s", step).withColumn(out, F.avg("__s").over(frame(keys, order, n))).drop("__s")


def _scaled(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(0.5)).otherwise(LOW + (x - lo) / (hi - lo) * (HIGH - LOW))


def extremes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, greatest and mean of each key: a partial aggregate, joined where it is needed."""
    return df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.avg(value).alias("__mid"))


def minmax_normalise(df: DataFrame, keys: Sequence[str], value: str, out: str = "norm") -> DataFrame:
    """To [0.001, 0.999] over each key's values; a flat series is 0.5."""
    return df.join(extremes(df, keys, value), list(keys)).withColumn(out, _scaled(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi", "__mid")


def split_normalise(df: DataFrame, keys: Sequence[str], value: str, mid: float | None = None, out: str = "norm") -> DataFrame:
    """Around a middle (the mean, if not given), which becomes 0.5: the sides are scaled apart."""
    x, lo, hi = F.col(value), F.col("__lo"), F.col("__hi")
    m = F.col("__mid") if mid is None else F.lit(mid)
    up = F.when(hi > m, 0.5 + (x - m) / (hi - m) * (HIGH - 0.5)).otherwise(0.5)
    down = F.when(lo < m, 0.5 - (m - x) / (m - lo) * (0.5 - LOW)).otherwise(0.5)
    return df.join(extremes(df, keys, value), list(keys)).withColumn(out, F.when(x >= m, up).otherwise(down)).drop("__lo", "__hi", "__mid")


def rank_desc(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], ties_first: bool = False, out: str = "rank") -> DataFrame:
    """1, 2, ... by falling value; later arrivals of a tie come after (before, if ``ties_first``)."""
    by = Window.partitionBy(*keys).orderBy(F.desc(value), *[F.desc(c) if ties_first else F.asc(c) for c in ties])
    return df.withColumn(out, F.row_number().over(by).cast("long"))


def bars(df: DataFrame, keys: Sequence[str], time: str, value: str, width: str, order: Sequence[str]) -> DataFrame:
    """Open, high, low, close, sum and count of each key and time bucket: one partial aggregate."""
    at = F.struct(time, *order)
    bucket = F.window(time, width).alias("w") if width not in ("day", "month", "year") else F.date_trunc(width, time).alias("w")
    agg = df.groupBy(*keys, bucket).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("total"), F.count("*").alias("n"))
    start = F.col("w.start") if width not in ("day", "month", "year") else F.col("w")
    return agg.select(*keys, start.alias("bucket"), "open", "high", "low", "close", "total", "n")


def rolling_drift(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, out: str = "drift") -> DataFrame:
    """At each row 100 times the drift (see ``series.cubic_drift``) of the last ``n`` values, as many as there are."""
    v, k = F.col("__v"), F.size("__v").cast("double")
    half, square = (k - 1) / 2, k * k
    total = lambda f: F.aggregate(F.transform(v, f), F.lit(0.0), lambda x, y: x + y)
    m = total(lambda y: y) / k
    s2, s4, s6 = k * (square - 1) / 12, k * (square - 1) * (3 * square - 7) / 240, k * (square - 1) * (3 * square * square - 18 * square + 31) / 1344
    moment = lambda p: total(lambda y, i: F.pow(i.cast("double") - half, F.lit(float(p))) * y) / m
    t1, t2, t3 = moment(1), moment(2), moment(3)
    odd = s2 * s6 - s4 * s4
    c1, c3 = (t1 * s6 - t3 * s4) / odd, (t3 * s2 - t1 * s4) / odd
    c2 = (k * t2 - s2 * k) / (k * s4 - s2 * s2)
    drift = F.when((k < 5) | is_zero(m), F.lit(0.0)).otherwise(100 * (c1 + 2 * c2 * half + 3 * c3 * half * half))
    return df.withColumn("__v", F.collect_list(value).over(frame(keys, order, n))).withColumn(out, drift).drop("__v")
