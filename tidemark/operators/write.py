"""Writes: upsert, append, delete, partition layout and compaction.

A table is a folder of Parquet files, partitioned by ``year`` or ``date`` as its grain says.  A write
rewrites only the partitions that its rows touch, through a written copy, so that no job reads the path
that it replaces."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, identity: Sequence[str], seq: str) -> DataFrame:
    """All rows of both; of those with one identity (key, index and unique fields) the last by ``seq``.
    The winner is found by a partial aggregate, so repeats of one identity meet as one row per task."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in identity]
    won = both.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__w"))
    return won.select(*identity, *[F.col(f"__w.{c}").alias(c) for c in rest]).select(*both.columns)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition isn't true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def ordered_last(df: DataFrame, index: str, seq: str) -> DataFrame:
    """An ordered map: the last row of each index value."""
    return upsert(df.limit(0), df, [index], seq)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def write_table(df: DataFrame, path: str, partition: str | None, key: str = "key", index: str | None = None) -> None:
    """The whole table, clustered by partition and sorted so that row groups can be skipped by key and index."""
    order = [c for c in (key, index) if c and c in df.columns]
    if partition is None:
        (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(path)
    else:
        df.repartition(partition, key).sortWithinPartitions(partition, *order).write.mode("overwrite").partitionBy(partition).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def rewrite_partitions(spark: SparkSession, path: str, partition: str, touched: DataFrame, change) -> None:
    """Apply ``change`` (rows -> rows) to the partitions named in ``touched`` (one column) and replace them; those
    that are left without a row go.  The names of the touched partitions reach the driver, which removes their
    folders one by one."""
    whole = spark.read.parquet(path)
    values = touched.select(partition).distinct()
    part = whole.join(values, partition, "left_semi")
    names = [str(x[0]) for x in part.select(partition).distinct().collect()]
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex[:8]}"
    changed = change(part)
    changed.write.partitionBy(partition).parquet(staging)
    ready = spark.read.schema(changed.schema).parquet(staging)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    where, files = _files(spark, staging)
    for name in names:
        if not files.exists(_files(spark, f"{staging}/{partition}={name}")[0]):
            remove(spark, f"{path.rstrip('/')}/{partition}={name}")
    remove(spark, staging)


class Journal:
    """A log of batches that is written before they are applied.

    ``append`` writes a batch as an entry of its own; ``recover`` gives the entries after the last applied one in
    their order, with ``entry``; ``applied`` marks how far a table has come and removes what is no longer needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        where, files = _files(self.spark, f"{self.path}/{kind}")
        names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def append(self, rows: DataFrame) -> int:
        n = max([0, *self._numbers("entries"), *self._numbers("applied")]) + 1
        staged = f"{self.path}/staged-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(staged)
        where, files = _files(self.spark, f"{self.path}/entries/entry={n}")
        files.mkdirs(where.getParent())
        if not files.rename(_files(self.spark, staged)[0], where):
            raise RuntimeError(f"entry {n} could not be written")  # an entry is there whole or not at all
        return n

    def recover(self) -> DataFrame | None:
        done = max([0, *self._numbers("applied")])
        left = [n for n in self._numbers("entries") if n > done]
        if not left:
            return None
        return self.spark.read.option("basePath", f"{self.path}/entries").parquet(*[f"{self.path}/entries/entry={n}" for n in left])

    def applied(self, n: int) -> None:
        where, files = _files(self.spark, f"{self.path}/applied/n={n}")
        files.mkdirs(where)
        for old in self._numbers("entries"):
            if old <= n:
                remove(self.spark, f"{self.path}/entries/entry={old}")


class DayStore:
    """A store of days with one writer: rows of the running day are appended as they come, without removing
    repeats; a day that is stopped is sorted into its folder, and a new year merges the year before it."""

    def __init__(self, spark: SparkSession, path: str, key: str, index: str):
        self.spark, self.path, self.key, self.index = spark, path.rstrip("/"), key, index
        self.day: int | None = None

    def start(self, day: int) -> None:
        """Take the day; an error if another writer has one (its mark is created by one only)."""
        where, files = _files(self.spark, f"{self.path}/writer")
        files.mkdirs(where.getParent())
        if not files.createNewFile(where):
            raise RuntimeError("the store has a writer")
        self.day = day

    def set(self, rows: DataFrame) -> None:
        if self.day is None:
            raise RuntimeError("no day has been started")
        rows.write.mode("append").parquet(f"{self.path}/running/day={self.day}")

    def running(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/running/day={self.day}")

    def stop(self) -> None:
        """Write the day out, drop its running files and give the writer's place back."""
        where, files = _files(self.spark, f"{self.path}/running/day={self.day}")
        if files.exists(where):
            year = self.day // 10000
            rows = self.running().repartition(self.key).sortWithinPartitions(self.key, self.index)
            rows.write.mode("overwrite").parquet(f"{self.path}/years/year={year}/day={self.day}")
            remove(self.spark, f"{self.path}/running/day={self.day}")
        remove(self.spark, f"{self.path}/writer")
        self.day = None

    def merge(self, year: int, files: int = 1) -> None:
        """One folder for all days of a year."""
        whole, new = f"{self.path}/years/year={year}", f"{self.path}/merged-{uuid.uuid4().hex[:8]}"
        rows = self.spark.read.option("basePath", whole).parquet(whole)
        rows.repartition(files, self.key).sortWithinPartitions("day", self.key, self.index).write.partitionBy("day").parquet(new)
        where, fs = _files(self.spark, whole)
        fs.delete(where, True)
        if not fs.rename(_files(self.spark, new)[0], where):
            raise RuntimeError(f"year {year} is in {new}")

    def read(self, first: int, last: int) -> DataFrame:
        """Rows of the stopped days from one to another; other days' folders are not read."""
        rows = self.spark.read.option("basePath", f"{self.path}/years").parquet(f"{self.path}/years")
        return rows.where(F.col("year").between(first // 10000, last // 10000) & F.col("day").between(first, last))


def compact(spark: SparkSession, path: str, partition: str, files: int = 1) -> None:
    """Rewrite every partition into few files."""
    rows = spark.read.parquet(path)
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != partition]), F.lit(files))
    rewrite_partitions(spark, path, partition, rows.select(partition), lambda df: df.repartition(partition, spread))
