"""Matching of keys and subjects: exact, list, prefix and substring, without regard to case."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many patterns are broadcast; with more, rows that share a beginning are dealt into so many shares.
FEW_PATTERNS, SHARES = 1 << 16, 64


def tokens(patterns: str) -> list[str]:
    return [t.strip().lower() for t in patterns.split(",") if t.strip()]


def _any(found: list[Column]) -> Column:
    return reduce(or_, found) if found else F.lit(False)


def in_list(key: Column, patterns: str) -> Column:
    return F.lower(key).isin(tokens(patterns))


def has_prefix(key: Column, patterns: str) -> Column:
    return _any([F.lower(key).startswith(t) for t in tokens(patterns)])


def has_part(key: Column, patterns: str) -> Column:
    return _any([F.lower(key).contains(t) for t in tokens(patterns)])


def is_multi(subject: str) -> bool:
    """Whether a subject can name more than one series."""
    return "*" in subject or "," in subject


def subject_filter(key: Column, table: Column, keys: str = "*", tables: str = "*", head: bool = True) -> Column:
    """Keys by prefix (whole, if not ``head``), tables by whole name; '*' is all."""
    k = F.lit(True) if keys == "*" else has_prefix(key, keys) if head else in_list(key, keys)
    return k & (F.lit(True) if tables == "*" else in_list(table, tables))


def fan_out(rows: DataFrame, key: str, patterns: DataFrame, pattern: str = "pattern", few: int = FEW_PATTERNS) -> DataFrame:
    """Each row once for each subscriber whose pattern (a prefix, or '*') its key matches.

    Patterns are few and short against the rows: a row is listed under those beginnings of its key that are as
    long as some pattern, and joined on them, so no row meets a pattern that it doesn't match.  Up to ``few``
    patterns are broadcast, and the rows stay where they are; beyond that each pattern has ``SHARES`` copies and
    each row goes to one, as most rows can share a beginning ('*' is one that all have)."""
    p = F.lower(F.col(pattern))
    told = patterns.withColumn("__p", F.when(p == "*", "").otherwise(p)).where("__p is not null")
    lengths = {x[0]: x[1] for x in told.groupBy(F.length("__p")).count().collect()}  # as many as a key has letters
    k = F.lower(F.col(key))
    starts = F.array_distinct(F.array(*[F.when(F.length(k) >= n, F.left(k, F.lit(n))) for n in lengths])) if lengths else F.array().cast("array<string>")
    listed = rows.withColumn("__p", F.explode(starts))
    if sum(lengths.values()) <= few:
        return listed.join(F.broadcast(told), "__p").drop("__p")
    share = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(SHARES))
    return listed.withColumn("__s", share).join(told.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))), ["__p", "__s"]).drop("__p", "__s")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect_ci(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Rows of ``left`` whose value occurs in ``right`` in any case."""
    own = right.select(F.lower(F.col(column)).alias("__k")).distinct()
    return left.join(own, F.lower(left[column]) == F.col("__k"), "left_semi")
