"""Partition predicates that follow from a range on the index, so that only its folders are read."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_predicate(column: str, start: int, stop: int) -> Column:
    """``start`` and ``stop`` as yyyymmdd."""
    return F.col(column).between(start // 10000, stop // 10000)


def date_predicate(column: str, start_ms: int, stop_ms: int) -> Column:
    day = lambda ms: int((date(1970, 1, 1) + timedelta(days=ms // 86_400_000)).strftime("%Y%m%d"))
    return F.col(column).between(day(start_ms), day(stop_ms))


def read_range(spark, path: str, index: str, start: int, stop: int, grain: str) -> DataFrame:
    """Rows of a partitioned table with start <= index <= stop; other partitions are not listed."""
    df = spark.read.parquet(path)
    if grain == "year":
        df = df.where(year_predicate("year", start, stop))
    elif grain == "date":
        df = df.where(date_predicate("date", start, stop))
    return df.where(F.col(index).between(start, stop))


def write_segments(df: DataFrame, path: str, time: str, hours: int = 6) -> None:
    """A folder for each day and segment of so many hours; later rows of a segment are added beside the others."""
    part = df.withColumn("date", F.date_format(time, "yyyyMMdd").cast("int")).withColumn("segment", F.floor(F.hour(time) / hours).cast("int"))
    part.repartition("date", "segment").sortWithinPartitions(time).write.mode("append").partitionBy("date", "segment").parquet(path)


def read_days(spark, path: str, first: int, last: int, weekends: bool = True, segments: tuple[int, int] | None = None) -> DataFrame:
    """Rows of the days (yyyymmdd) from one to another, of some segments, without Saturdays and Sundays if so
    wished: all of it chooses folders, none of it reads rows."""
    df = spark.read.parquet(path)
    df = df.where(F.col("date").between(first, last))
    if not weekends:
        df = df.where(F.dayofweek(F.to_date(F.col("date").cast("string"), "yyyyMMdd")).isin(2, 3, 4, 5, 6))
    return df if segments is None else df.where(F.col("segment").between(*segments))
