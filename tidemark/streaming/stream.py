"""Streams: subscriptions, day lifecycle, micro-batches, stateful means.

A day's rows arrive as files; a finished day is read with an ``availableNow`` trigger, a running one with a
processing-time trigger.  Checkpoints take the place of a write-ahead log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import match

WAIT = "30 milliseconds"


def source(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def subscribe(stream: DataFrame, key: str, keys: str = "*", table: str | None = None, tables: str = "*", head: bool = False) -> DataFrame:
    """New rows of whole keys (or, with ``head``, of key prefixes) and tables."""
    k = F.col(key).cast("string")
    return stream.where(match.subject_filter(k, F.col(table) if table else F.lit("*"), keys, tables if table else "*", head))


def known_only(stream: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the catalog; others are dropped."""
    return stream.join(catalog.select(key).distinct(), key, "left_semi")


def run_day(df: DataFrame, sink: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, partition: str | None = None, timeout: int = 120) -> None:
    """Everything that is there now, in micro-batches, to Parquet (or to ``each``); ends with the day."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", sink)
    q = (w.partitionBy(partition) if partition and not each else w).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the day did not end in {timeout} s")


def drain(df: DataFrame, root: str, mode: str = "append", timeout: int = 300) -> DataFrame:
    """Run a stream until all that is there is read, and give the result so far.

    Every batch has its own folder and replaces it when it is run again, so a retry adds nothing.  In complete
    mode each batch is the whole result, and the last one counts.  A later call with the same ``root`` goes on
    where the last one ended."""
    spark, schema = df.sparkSession, df.schema

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not end")
    last = [x for x in _children(spark, f"{root}/out") if x.startswith("batch=")]
    if not last:
        return spark.createDataFrame([], schema)
    names = sorted(last, key=lambda x: int(x.split("=")[1]))
    return spark.read.schema(schema).parquet(*[f"{root}/out/{x}" for x in (names[-1:] if mode == "complete" else names)])


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


class Subscriptions:
    """Who reads which keys.  A reader has one subscription: a new one replaces it."""

    def __init__(self):
        self.of: dict[str, tuple[str, bool]] = {}

    def subscribe(self, reader: str, keys: str, head: bool = False) -> bool:
        """False if the reader already has just this subscription."""
        fresh = self.of.get(reader) != (keys, head)
        self.of[reader] = (keys, head)
        return fresh

    def unsubscribe(self, reader: str) -> bool:
        return self.of.pop(reader, None) is not None

    def apply(self, stream: DataFrame, reader: str, key: str) -> DataFrame:
        """The rows that a reader gets; none after it has unsubscribed."""
        if reader not in self.of:
            return stream.where(F.lit(False))
        keys, head = self.of[reader]
        return subscribe(stream, key, keys, head=head)


def from_position(rows: DataFrame, time: str, after, live_from) -> DataFrame:
    """Rows after a reader's position, with ``kind``: 'history' before the running day, 'live' from it on."""
    return rows.where(F.col(time) > after).withColumn("kind", F.when(F.col(time) < live_from, "history").otherwise("live"))


def caught_up(rows: DataFrame, time: str, name: str, live_from) -> DataFrame:
    """(what, nth): rows of history in time order, a marker, then live ones.  The order is one task's: this is
    for what one reader gets."""
    step = F.when(F.col(time) < live_from, 0).otherwise(2)
    named = rows.select(F.col(name).cast("string").alias("what"), F.col(time).alias("at"), step.alias("step"))
    marker = rows.sparkSession.range(1).select(F.lit("caught up").alias("what"), F.lit(None).cast(rows.schema[time].dataType).alias("at"), F.lit(1).alias("step"))
    return named.union(marker).withColumn("nth", F.row_number().over(Window.orderBy("step", "at", "what")).cast("long"))


def replay_days(rows: DataFrame, time: str, order: list[str], first: str, last: str) -> DataFrame:
    """Rows from one day to another with ``day``, their place in it (``nth``) and the day's place among those that
    have rows (``nth_day``).  Days are numbered apart, so no task sorts more than a day."""
    day = F.date_format(time, "yyyy-MM-dd")
    part = rows.withColumn("day", day).where(F.col("day").between(first, last))
    days = part.select("day").distinct().withColumn("nth_day", F.row_number().over(Window.orderBy("day")).cast("long"))
    nth = F.row_number().over(Window.partitionBy("day").orderBy(time, *order)).cast("long")
    return part.withColumn("nth", nth).join(days, "day")


def live(df: DataFrame, sink: str, checkpoint: str, wait: str = WAIT):
    """A running query; ``stop()`` ends the subscription."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=wait).format("parquet").option("path", sink).start()


def dedupe_late(df: DataFrame, time: str, delay: str, identity: list[str]) -> DataFrame:
    """One row of each identity among those at most ``delay`` apart; later repeats are late."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(identity)


def windowed(df: DataFrame, time: str, value: str, keys: list[str], width: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = df.withWatermark(time, delay) if df.isStreaming else df
    return g.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, time: str, value: str, keys: list[str], gap: str, delay: str = "0 seconds") -> DataFrame:
    g = df.withWatermark(time, delay) if df.isStreaming else df
    return g.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def running_mean(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The warm-up mean of each key, kept as state: (key, n, mean) after each batch of a stream."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, m = state.get if state.exists else (0, 0.0)
        for x in pd.concat(list(batches)).sort_values(order)[value]:
            if abs(x) < 1e-7:
                continue
            weight = 0.1 if n < 10 else 1.0 / (n + 1) if n < 100 else 0.01
            n, m = n + 1, float(x) if n == 0 else m * (1 - weight) + float(x) * weight
        state.update((n, m))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [m]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def rolling_sum(df: DataFrame, key: str, order: list[str], value: str, name: str, n: int) -> DataFrame:
    """(key, name, total): at each row the sum of its key's last ``n`` values, which are the state.  A batch's rows
    must not be earlier than those of the batches before."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        every = held + rows[value].tolist()
        totals = [sum(every[max(0, i - n + 1) : i + 1]) for i in range(len(held), len(every))]
        state.update((every[-(n - 1) :] if n > 1 else [],))
        yield pd.DataFrame({key: k[0], "name": rows[name].to_numpy(), "total": totals}).rename(columns={"name": name})

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, name)]
    out = ", ".join([*kinds, "total double"])
    return df.select(*dict.fromkeys([key, *order, value, name])).groupBy(key).applyInPandasWithState(run, out, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def result(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a finished stream has written; empty if it wrote nothing."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
