"""Analytics of a numeric series per key, in closed form: aggregates and array expressions.

A series is ordered by ``order``; position 1 is the oldest value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import is_zero

PI = 3.1415927
FIBONACCI = (1, 1, 2, 3, 5, 8, 13, 21, 34, 55)
#: Where the warm-up means change their weight.
WARM, LONG = 10, 100


def as_array(value: str, order: Sequence[str]) -> Column:
    """A key's values in order, for use in ``agg``; the caller answers for the size of a key."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def stats_nonzero(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average of all values; least and greatest of those that aren't zero."""
    v = F.when(~is_zero(F.col(value)), F.col(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("avg_v"), F.coalesce(F.min(v), F.lit(0.0)).alias("min_v"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_v"))


def mean_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("avg_v"), F.median(value).alias("median_v"))


def mean_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean_v"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_v"))


def density(x: Column, mean: Column, std: Column) -> Column:
    """Gaussian density; 0 for a deviation of 0."""
    return F.when(is_zero(std), F.lit(0.0)).otherwise(F.exp(-F.pow(x - mean, 2) / (2 * F.pow(std, 2))) / (F.sqrt(F.lit(2 * PI)) * std))


def fibonacci_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "fib_avg") -> DataFrame:
    """Weighted by a Fibonacci number for each tenth of the series, the newest heaviest."""
    size = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    at = F.floor((F.col("pos") - 1) / F.col("__n") * 10).cast("int")
    w = F.get(F.array(*[F.lit(x) for x in FIBONACCI]), at)
    return numbered(df, keys, order).join(size, list(keys)).groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(out))


def warm_mean(values: Column) -> Column:
    """Running mean of an array: the first value, then weights 1/10 until 10 samples, 1/(n+1) until 100, 1/100."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"]
        weight = F.when(n < WARM, F.lit(1.0 / WARM)).when(n < LONG, 1.0 / (n + 1)).otherwise(F.lit(1.0 / LONG))
        new = F.when(n == 0, x).otherwise(a["m"] * (1 - weight) + x * weight)
        return F.when(is_zero(x), a).otherwise(F.struct((n + 1).alias("n"), new.alias("m")))

    return F.aggregate(values, start, step, lambda a: a["m"])


def warm_ratio(pairs: Column) -> Column:
    """Running ratio of an array of (son, mom), each sample weighted as in ``warm_mean`` by its son's share."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"]
        weight = F.when(n < WARM, F.lit(1.0 / WARM)).when(n < LONG, 1.0 / (n + 1)).otherwise(F.lit(1.0 / LONG))
        mix = lambda old, new: F.when(n == 0, new).otherwise(old * (1 - weight) + new * weight)
        skip = is_zero(x["son"]) | is_zero(x["mom"])
        return F.when(skip, a).otherwise(F.struct((n + 1).alias("n"), mix(a["s"], x["son"]).alias("s"), mix(a["m"], x["mom"]).alias("m")))

    return F.aggregate(pairs, start, step, lambda a: F.when(is_zero(a["m"]), F.lit(0.0)).otherwise(a["s"] / a["m"]))


def correlation(a: str, b: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def _agree(a: str, b: str) -> Column:
    """Share of the same sign, as (s - 0.5) * 2; s is sames/n, or -differents/n if these are more; 0 on a tie.
    Zeros count as different."""
    n, same = F.count("*"), F.count_if(F.col(a) * F.col(b) > 0)
    diff = n - same
    return F.when(same > diff, (same / n - 0.5) * 2).when(same < diff, (-diff / n - 0.5) * 2).otherwise(F.lit(0.0))


direction = _agree


def lagged(df: DataFrame, keys: Sequence[str], pos: str, a: str, b: str, max_lag: int | None = None, measure=correlation) -> DataFrame:
    """For each lag from 0 (``b`` moved back by it): the measure, as long as it doesn't fall; the last one
    kept is the result.  The lag is at most 0.382 n + 1, and ``max_lag`` if given.  (keys, lag, value)"""
    size = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    lags = size.withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_lag).cast("int"), F.floor(F.col("__n") * 0.382 + 1).cast("int")))))
    x = df.select(*keys, F.col(pos).alias("__p"), F.col(a).alias("__a")).join(lags, list(keys)).withColumn("__q", F.col("__p") + F.col("lag"))
    y = df.select(*keys, F.col(pos).alias("__q"), F.col(b).alias("__b"))
    each = x.join(y, [*keys, "__q"]).groupBy(*keys, "lag").agg(measure("__a", "__b").alias("value"))
    by = Window.partitionBy(*keys).orderBy("lag")
    fell = F.max(F.when(F.col("value") < F.col("__before"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = each.withColumn("__before", F.lag("value").over(by)).withColumn("__fell", fell).where("__fell = 0")
    return kept.groupBy(*keys).agg(F.max("lag").alias("lag"), F.max_by("value", "lag").alias("value"))


def slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Least-squares line on x = 1..n."""
    p = numbered(df, keys, order).withColumn("pos", F.col("pos").cast("double"))
    return p.groupBy(*keys).agg(F.coalesce(F.regr_slope(value, "pos"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(value, "pos"), F.lit(0.0)).alias("intercept"))


def slope_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Slope in units of (max - min) / (n - 1), where the extremes start from 0; fewer than 3, or flat: 0."""
    p = numbered(df, keys, order).withColumn("pos", F.col("pos").cast("double"))
    g = p.groupBy(*keys).agg(F.regr_slope(value, "pos").alias("__s"), F.count("*").alias("__n"), F.least(F.lit(0.0), F.min(value)).alias("__lo"), F.greatest(F.lit(0.0), F.max(value)).alias("__hi"))
    unit = (F.col("__hi") - F.col("__lo")) / (F.col("__n") - 1)
    return g.select(*keys, F.when((F.col("__n") < 3) | is_zero(F.col("__hi") - F.col("__lo")), F.lit(0.0)).otherwise(F.col("__s") / unit).alias("slope_rate"))


def cubic_drift(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(drift, acceleration): of the values over their mean, the first and second derivative of the cubic
    least-squares fit on x = 0..n-1, at the last point; fewer than 5 values, or a mean of 0: 0.

    x is centred, which makes the odd power sums vanish: the normal equations fall into two 2x2 systems in
    sums of powers, which are plain aggregates."""
    size = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"))
    p = numbered(df, keys, order).join(size, list(keys))
    x = F.col("pos").cast("double") - 1 - (F.col("__n") - 1) / 2
    y = F.when(is_zero(F.col("__m")), F.lit(0.0)).otherwise(F.col(value) / F.col("__m"))
    p = p.withColumn("__x", x).withColumn("__y", y)
    s = lambda k: F.sum(F.pow("__x", F.lit(float(k))))
    t = lambda k: F.sum(F.pow("__x", F.lit(float(k))) * F.col("__y"))
    g = p.groupBy(*keys).agg(F.first("__n").alias("n"), F.first("__m").alias("m"), s(2).alias("s2"), s(4).alias("s4"), s(6).alias("s6"), F.sum("__y").alias("t0"), t(1).alias("t1"), t(2).alias("t2"), t(3).alias("t3"))
    odd = F.col("s2") * F.col("s6") - F.col("s4") * F.col("s4")
    even = F.col("n") * F.col("s4") - F.col("s2") * F.col("s2")
    c1 = (F.col("t1") * F.col("s6") - F.col("t3") * F.col("s4")) / odd
    c3 = (F.col("t3") * F.col("s2") - F.col("t1") * F.col("s4")) / odd
    c2 = (F.col("n") * F.col("t2") - F.col("s2") * F.col("t0")) / even
    e = (F.col("n") - 1) / 2
    ok = (F.col("n") >= 5) & ~is_zero(F.col("m"))
    return g.select(*keys, F.when(ok, c1 + 2 * c2 * e + 3 * c3 * e * e).otherwise(0.0).alias("drift"), F.when(ok, 2 * c2 + 6 * c3 * e).otherwise(0.0).alias("acceleration"))


def quadratic(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(c0, c1, c2) of the least-squares parabola over x = 0..n-1, from power sums of centred x; fewer than 3
    values: 0."""
    size = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    p = numbered(df, keys, order).join(size, list(keys)).withColumn("__x", F.col("pos").cast("double") - 1 - (F.col("__n") - 1) / 2)
    t = lambda k: F.sum(F.pow("__x", F.lit(float(k))) * F.col(value))
    s = lambda k: F.sum(F.pow("__x", F.lit(float(k))))
    g = p.groupBy(*keys).agg(F.first("__n").alias("n"), s(2).alias("s2"), s(4).alias("s4"), F.sum(value).alias("t0"), t(1).alias("t1"), t(2).alias("t2"))
    n, s2 = F.col("n"), F.col("s2")
    e, b2 = (n - 1) / 2, (n * F.col("t2") - s2 * F.col("t0")) / (n * F.col("s4") - s2 * s2)
    b1, b0 = F.col("t1") / s2, (F.col("t0") - b2 * s2) / n
    found = {"c0": b0 - b1 * e + b2 * e * e, "c1": b1 - 2 * b2 * e, "c2": b2}
    return g.select(*keys, *[F.when(n > 2, c).otherwise(0.0).alias(name) for name, c in found.items()])


def factor_codes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, level: int = 3, sums: bool = False, out: str = "code") -> DataFrame:
    """Each key's newest confirmed moves as decimal digits, the newest first: 1 where a value doesn't fall after a
    rise, 0 where it falls after a fall; with ``sums``, also where it is above (below) the sum of the three
    values before it.  At most ``level`` moves, looked for from position ``level`` on; 10^level marks that there
    are so many."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v, (a, b, c) = F.col(value), [F.lag(value, i).over(w) for i in (1, 2, 3)]
    over, under = (v > a + b + c, v < a + b + c) if sums else (F.lit(False), F.lit(False))
    digit = F.when((v >= a) & ((a > b) | over), 1).when((v < a) & ((a < b) | under), 0)
    rows = df.select(*keys, *order, digit.alias("__d"), F.row_number().over(w).alias("__p")).where((F.col("__p") >= max(3, level)) & F.col("__d").isNotNull())
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in order]))
    found = rows.withColumn("__r", newest).where(F.col("__r") <= level).groupBy(*keys).agg(F.sum(F.col("__d") * F.pow(F.lit(10.0), -F.col("__r"))).alias("__s"), F.count("*").alias("__n"))
    code = F.round(F.col("__s") * F.pow(F.lit(10.0), F.col("__n"))) + F.when(F.col("__n") >= level, F.lit(10.0**level)).otherwise(0.0)
    return df.select(*keys).distinct().join(found.select(*keys, code.cast("int").alias(out)), list(keys), "left").na.fill(0, [out])


def factor_pair(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, out: str = "code") -> DataFrame:
    """Of the newest three rows, a digit 1 where ``a`` isn't below ``b``, the newest first, after a 1; fewer rows: 0."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(x) for x in order]))
    g = df.withColumn("__r", newest).where("__r <= 3").groupBy(*keys)
    digits = F.sum(F.when(F.col(a) >= F.col(b), F.pow(F.lit(10.0), F.lit(3) - F.col("__r"))).otherwise(0.0))
    return g.agg(F.when(F.count("*") < 3, 0).otherwise((digits + 1000).cast("int")).alias(out))


def trend(newest_first: Column) -> Column:
    """+1 if an array, newest first, strictly falls (the series rises), -1 if it strictly rises, else 0."""
    n = F.size(newest_first)
    steps = F.zip_with(F.slice(newest_first, 1, F.greatest(n - 1, F.lit(0))), F.slice(newest_first, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)
    return F.when(n < 2, 0).when(F.forall(steps, lambda d: d > 0), 1).when(F.forall(steps, lambda d: d < 0), -1).otherwise(0)


def nearest_difference(values: Column) -> Column:
    """Last value less the extreme at the start of the newest monotone run (oldest first)."""
    back = F.reverse(values)
    start = F.struct(F.get(back, F.lit(0)).alias("x"), F.lit(0).alias("sign"), F.lit(False).alias("end"))

    def step(a: Column, v: Column) -> Column:
        sign = F.signum(a["x"] - v).cast("int")
        stop = a["end"] | ((sign != 0) & (a["sign"] != 0) & (sign != a["sign"]))
        return F.when(stop, F.struct(a["x"].alias("x"), a["sign"].alias("sign"), F.lit(True).alias("end"))).otherwise(F.struct(v.alias("x"), F.when(sign == 0, a["sign"]).otherwise(sign).alias("sign"), F.lit(False).alias("end")))

    return F.get(back, F.lit(0)) - F.aggregate(F.slice(back, 2, F.greatest(F.size(back) - 1, F.lit(0))), start, step, lambda a: a["x"])


def argmin(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Position (from 0) of the first least value."""
    return numbered(df, keys, order).groupBy(*keys).agg((F.min_by("pos", F.struct(F.col(value), F.col("pos"))) - 1).alias("argmin"), F.min(value).alias("least"))


def threshold_counts(df: DataFrame, keys: Sequence[str], value: str, limit: float, floor: float | None = None) -> DataFrame:
    c = F.col(value)
    counted = F.lit(True) if floor is None else c >= floor
    return df.groupBy(*keys).agg(F.count_if((c > limit) & counted).alias("above"), F.count_if((c < limit) & counted).alias("below"))


def combinations(spark, levels: Sequence[Sequence[float]], names: Sequence[str] | None = None) -> DataFrame:
    """Every choice of one level for each position, the last position fastest: the product of literal lists."""
    names = names or [f"p{i}" for i in range(len(levels))]
    df = spark.range(1).select()
    return reduce(lambda d, x: d.select("*", F.explode(F.array(*[F.lit(v) for v in x[1]])).alias(x[0])), zip(names, levels, strict=True), df)


def ratio_levels(centre: float, div: int, low: float, high: float) -> list[float]:
    """``div`` even steps below and above a centre, together as long as its way to the nearer end of the
    range (the centre itself, halfway); levels outside the bounds are left out."""
    half = (high - low) / 2
    reach = high - centre if centre > half else centre - low if centre < half else centre
    levels = (centre + reach * i / (2 * div) for i in range(-div, div + 1))
    return [x for x in levels if low <= x <= high]
