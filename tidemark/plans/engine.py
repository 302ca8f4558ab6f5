"""The engine's API: named tables, lookups, writes, replay, subscriptions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, lookup, match, write
from tidemark.plans.schema import Table, parse, same_layout


class Engine:
    """Tables with a ``key`` column, an index and a ``seq`` of arrival, as frames or as Parquet folders."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.frames: dict[str, DataFrame] = {}
        self.values: dict[str, Any] = {}

    # definitions
    def create(self, name: str, spec: dict | str, rows: DataFrame | None = None) -> bool:
        """Define or redefine a table; False if it exists with this layout."""
        table = parse(name, spec)
        if name in self.tables and same_layout(self.tables[name], table):
            return False
        self.tables[name] = table
        schema = f"key string, {', '.join(f'{f.name} {f.element().simpleString() if f.count == 1 else f.spark().dataType.simpleString()}' for f in table.fields)}, seq long"
        self.frames[name] = rows if rows is not None else self.spark.createDataFrame([], schema)
        return True

    def attach(self, name: str, df: DataFrame, key: str, index: str | None, unique: Sequence[str] = ()) -> None:
        """Use existing rows as a table."""
        self.tables[name] = Table(name, (), index, index, tuple(unique))
        self.frames[name] = df.withColumnRenamed(key, "key") if key != "key" else df

    def drop(self, name: str) -> None:
        self.tables.pop(name)
        self.frames.pop(name)

    def show(self) -> DataFrame:
        rows = [(t.name, f.name, f.type, f.size, f.count, f.decimals, f.flags) for t in self.tables.values() for f in t.fields]
        return self.spark.createDataFrame(rows, "table string, field string, type string, bytes int, count int, decimals int, flags string")

    def keys(self, name: str) -> DataFrame:
        return self.frames[name].select("key").distinct()

    # reads
    def _keyed(self, name: str, keys: str, head: bool) -> DataFrame:
        df = self.frames[name]
        return df.where(match.subject_filter(F.col("key"), F.lit(name), keys, head=head))

    def get(self, name: str, keys: str = "*", range: tuple | None = None, where: tuple | None = None, fields=None, limit: int | None = None, ifprev: bool = False, head: bool = False) -> DataFrame:
        """Rows of some keys; with neither ``range`` (start, stop) nor ``where`` (start, offset), the latest."""
        t, df = self.tables[name], self._keyed(name, keys, head)
        if t.index is None:
            out = df
        elif where is not None:
            out = lookup.where_rows(df, ["key"], t.index, *where)
        else:
            start, stop = range if range is not None else (-1, 0)
            out = lookup.range_rows(df, ["key"], t.index, start, stop, ifprev)
        out = lookup.project(out, fields)
        return out if limit is None else out.limit(limit)

    def gets(self, names: Sequence[str], keys: str = "*") -> dict[str, DataFrame]:
        """The one last row of each key, by table."""
        return {n: lookup.last_rows(self._keyed(n, keys, False), ["key"], [self.tables[n].index, "seq"]) for n in names}

    # writes
    def set(self, name: str, rows: DataFrame) -> None:
        """Upsert where the table has unique fields, else append."""
        t = self.tables[name]
        identity = list(dict.fromkeys(["key", *([t.index] if t.index else []), *t.unique]))
        self.frames[name] = write.upsert(self.frames[name], rows, identity, "seq") if t.unique else write.append(self.frames[name], rows)

    def delete(self, name: str, keys: str, start=None, stop=None) -> None:
        t, hit = self.tables[name], match.in_list(F.col("key"), keys)
        if start is not None:
            hit = hit & F.col(t.index).between(start, stop)
        self.frames[name] = write.delete(self.frames[name], hit)

    def save(self, name: str, path: str) -> None:
        """Write a table out, partitioned by its grain, and go on from what was written: the plan of all writes so
        far ends here.  Any folder but the one that it is read from now."""
        t, df = self.tables[name], self.frames[name]
        part = t.partition()
        df = df if part is None else df.withColumn(t.grain, part)
        write.write_table(df, path, None if part is None else t.grain, "key", t.index)
        self.frames[name] = self.spark.read.parquet(path).select(*self.frames[name].columns)

    # key-value store
    def put(self, key: str, value: Any) -> None:
        self.values[key] = value

    def value(self, key: str) -> Any:
        """None for an unknown key."""
        return self.values.get(key)

    # streams
    def replay(self, names: Sequence[str], units: dict[str, str], keys: str = "*", start: int | None = None, stop: int | None = None) -> DataFrame:
        """Rows of many tables in one time order."""
        streams = [(n, self._keyed(n, keys, True), self.tables[n].index, units.get(n), ["seq"]) for n in names]
        merged = asof.time_merge(streams)
        if start is not None:
            merged = merged.where(F.col("time") >= start)
        if stop is not None:
            merged = merged.where(F.col("time") <= stop)
        return asof.replay(merged)
