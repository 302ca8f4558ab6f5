"""Splits of a set of numbers into bands, and assignment of rows to them.

Cut points are the values at certain ranks of a key; ranks come from a window and are joined, so no key's
values are gathered in one array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GUARD = 1e-9


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    size = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys).orderBy("__v")
    return df.select(*keys, F.col(value).cast("double").alias("__v")).withColumn("__r", F.row_number().over(by) - 1).join(size, list(keys))


def quantile_cuts(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """(keys, nth, cut): k cut points, every n/(k+1) values; a cut is the middle between its neighbours."""
    r = _ranked(df, keys, value)
    size = r.select(*keys, "__n").distinct()
    at = size.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("__i", F.floor(F.col("__n") * F.col("nth") / (k + 1)).cast("int"))
    both = at.withColumn("__r", F.explode(F.array(F.greatest(F.col("__i") - 1, F.lit(0)), F.least(F.col("__i"), F.col("__n").cast("int") - 1))))
    return both.join(r.select(*keys, "__r", "__v"), [*keys, "__r"]).groupBy(*keys, "nth").agg(F.avg("__v").alias("cut"))


def equal_sum_cuts(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """(keys, nth, cut): the values at which the running sum of the sorted values passes nth/(k+1) of the total."""
    by = Window.partitionBy(*keys).orderBy("__v", "__u").rowsBetween(Window.unboundedPreceding, 0)
    total = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    r = df.select(*keys, F.col(value).cast("double").alias("__v"), F.monotonically_increasing_id().alias("__u")).withColumn("__c", F.sum("__v").over(by)).join(total, list(keys))
    at = r.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("__c") >= F.col("__t") * F.col("nth") / (k + 1))
    return at.groupBy(*keys, "nth").agg(F.min("__v").alias("cut"))


def equal_count_splits(df: DataFrame, keys: Sequence[str], value: str, k: int, nozero: bool = False) -> DataFrame:
    """(keys, nth, lo, hi): k bands [lo, hi) of equal counts, the outer edges widened by a guard.
    ``nozero`` leaves out values nearer to 0 than 0.001."""
    rows = df.where(F.abs(F.col(value)) >= 0.001) if nozero else df
    r = _ranked(rows, keys, value)
    size = r.select(*keys, "__n").distinct()
    edges = size.withColumn("__e", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("__r", F.least(F.floor(F.col("__n") * F.col("__e") / k).cast("int"), F.col("__n").cast("int") - 1))
    e = edges.join(r.select(*keys, "__r", "__v"), [*keys, "__r"])
    edge = F.when(F.col("__e") == 0, F.col("__v") - GUARD).when(F.col("__e") == k, F.col("__v") + GUARD).otherwise(F.col("__v"))
    by = Window.partitionBy(*keys).orderBy("__e")
    return e.select(*keys, F.col("__e"), edge.alias("lo")).withColumn("hi", F.lead("lo").over(by)).where(F.col("__e") < k).select(*keys, (F.col("__e") + 1).alias("nth"), "lo", "hi")


def signed_splits(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """(keys, side, nth, lo, hi): negatives and positives split apart, k bands each; zeros have none."""
    neg = equal_count_splits(df.where(F.col(value) < 0), keys, value, k).select(*keys, F.lit(-1).alias("side"), "nth", "lo", "hi")
    pos = equal_count_splits(df.where(F.col(value) > 0), keys, value, k).select(*keys, F.lit(1).alias("side"), "nth", "lo", "hi")
    return neg.unionByName(pos)


def equal_width_splits(df: DataFrame, keys: Sequence[str], value: str, k: int, guard: float = 0.001) -> DataFrame:
    """(keys, nth, lo, hi): k bands of equal width between the extremes, widened by a guard."""
    g = df.groupBy(*keys).agg((F.min(value) - guard).alias("__lo"), (F.max(value) + guard).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / k
    return g.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(*keys, "nth", (F.col("__lo") + width * (F.col("nth") - 1)).alias("lo"), (F.col("__lo") + width * F.col("nth")).alias("hi"))


def two_sided(lower: DataFrame, upper: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every pair of a lower and an upper band of a key (the bands are few by their parameter)."""
    a = lower.select(*keys, F.col("lo").alias("lower_lo"), F.col("hi").alias("lower_hi"))
    b = upper.select(*keys, F.col("lo").alias("upper_lo"), F.col("hi").alias("upper_hi"))
    return a.join(b, list(keys))


def signed_groups(df: DataFrame, keys: Sequence[str], value: str, k: int, place: Sequence[str]) -> DataFrame:
    """Each row's ``bucket``: negatives 0..k-1 and positives k+1..2k by equal counts, zeros k; and ``nth``, its
    place in the bucket by ``place``.  Edges are the bands' lower ends, so end bands take what lies beyond."""
    edges = signed_splits(df, keys, value, k).where("nth > 1").groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("side") < 0, F.col("lo")))).alias("__neg"), F.sort_array(F.collect_list(F.when(F.col("side") > 0, F.col("lo")))).alias("__pos"))
    below = lambda a, v: F.coalesce(F.size(F.filter(a, lambda e: e <= v)), F.lit(0))
    v = F.col(value)
    own = F.when(v < 0, F.greatest(below(F.col("__neg"), v), F.lit(0))).when(v == 0, F.lit(k)).otherwise(F.greatest(below(F.col("__pos"), v), F.lit(0)) + k + 1)
    out = df.join(edges, list(keys), "left").withColumn("bucket", own.cast("int")).drop("__neg", "__pos")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*place)).cast("long"))


def assign(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below a value: its band."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value >= e, 1).otherwise(0)
    return out
