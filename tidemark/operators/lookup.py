"""Lookups by key and index: latest, range, as-of, point and offset.

Ranges and last-n go by index value, so ties widen them; as-of and offset go by row, with ``order`` (the
index and what breaks its ties) deciding.  Bounds are literals, or sentinels resolved per key: a start of
-n is the index value of the n-th row from the end (the first row's, if there are fewer), a stop of -1 the
last index value, a stop of 0 the start.  Literal bounds reach the Parquet scan; per-key bounds are partial
aggregates joined back, and n-th rows use a ranked window whose group limit runs before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LO, HI = "__lo", "__hi"


def _sentinel(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x < 0


def _newest(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("__n", F.row_number().over(_newest(keys, order))).where(F.col("__n") <= n).drop("__n")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def nth_from_end(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    by = _newest(keys, order)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).where(F.col("__n") == n).drop("__n")


def bounds(df: DataFrame, keys: Sequence[str], index: str, start: Any, stop: Any) -> DataFrame | None:
    """Per-key bounds, or None if both are literals."""
    if not _sentinel(start) and not _sentinel(stop):
        return None
    out = None
    if _sentinel(start):
        out = last_rows(df.select(*keys, index), keys, [index], -start).groupBy(*keys).agg(F.min(index).alias(LO))
    if _sentinel(stop):
        top = df.groupBy(*keys).agg(F.max(index).alias(HI))
        out = top if out is None else out.join(top, list(keys))
    if not _sentinel(start):
        out = out.withColumn(LO, F.lit(start))
    if not _sentinel(stop):
        out = out.withColumn(HI, F.col(LO) if stop == 0 else F.lit(stop))
    return out


def range_rows(df: DataFrame, keys: Sequence[str], index: str, start: Any, stop: Any = 0, ifprev: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Rows of each key with start <= index <= stop.  ``ifprev``: where no row equals the start, also the
    one last row before it, if its index is at most the stop."""
    columns, order = df.columns, order or [index]
    per_key = bounds(df, keys, index, start, stop)
    if per_key is None:
        lo, hi = F.lit(start), F.lit(start if isinstance(stop, int) and stop == 0 and not isinstance(stop, bool) else stop)
        base = df
    else:
        base, lo, hi = df.join(per_key, list(keys)), F.col(LO), F.col(HI)
    c = F.col(index)
    inside = base.where((c >= lo) & (c <= hi)).select(*columns)
    if not ifprev:
        return inside
    exact = base.where(c == lo).select(*keys).distinct()
    before = last_rows(base.where(c < lo), keys, order).where(c <= hi).select(*columns)
    return inside.unionByName(before.join(exact, list(keys), "left_anti").select(*columns))


def where_rows(df: DataFrame, keys: Sequence[str], index: str, start: Any, offset: int = 0, order: Sequence[str] | None = None) -> DataFrame:
    """Offset 0: the rows equal to start.  -n: the n-th row before the first with index >= start.  Over 0: none."""
    c = F.col(index)
    if offset == 0:
        return df.where(c == F.lit(start))
    if offset > 0:
        return df.limit(0)
    return nth_from_end(df.where(c < F.lit(start)), keys, order or [index], -offset)


def latest(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """All rows that share each key's greatest index value."""
    return range_rows(df, keys, index, -1, 0)


def last_n_values(df: DataFrame, keys: Sequence[str], index: str, n: int) -> DataFrame:
    """The last n rows and those tied with the first of them."""
    return range_rows(df, keys, index, -n, -1)


def positional(df: DataFrame, order: Sequence[str], start: int, count: int = 1) -> DataFrame:
    """``count`` rows of an untimed table from a position; negative positions count from the end.
    Both ends are top-n queries, so no row gets a global number."""
    if start >= 0:
        return df.orderBy(*order).offset(start).limit(count)
    return df.orderBy(*[F.desc(c) for c in order]).limit(-start).orderBy(*order).limit(count)


def project(df: DataFrame, fields: str | Sequence[str] | None) -> DataFrame:
    """Fields in the order asked for; ``name.3`` is element 3 (from 0) of an array; None or '*' is all."""
    if fields in (None, "*"):
        return df
    names = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
    out: list[Column] = []
    for name in names:
        base, _, nth = name.partition(".")
        if base not in df.columns:
            raise ValueError(f"unknown field {name!r}; there are {', '.join(df.columns)}")
        out.append(F.get(F.col(base), F.lit(int(nth))).alias(f"{base}_{nth}") if nth else F.col(base))
    return df.select(*out)
