"""Joins in time: as-of, bounded carry, time-ordered merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeconv import convert_unit, finest


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, order: Sequence[str] = (), strict: bool = False, suffix: str = "_asof") -> DataFrame:
    """Each left row with the value and time of the last right row of its key at or before it (strictly
    before, if ``strict``).  Both sides are laid end to end and one ordered window carries the last right
    value forward: one shuffle, no row pairs."""
    columns = left.columns
    far = 0 if strict else 1  # left rows go before right rows of the same time, or after
    a = left.select(*columns, F.lit(far).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[time].dataType).alias("__t"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    blanks = [F.col(c) if c in (*keys, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns]
    b = right.select(*blanks, F.lit(1 - far).alias("__side"), F.col(value).alias("__v"), F.col(time).alias("__t"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    by = Window.partitionBy(*keys).orderBy(time, "__side", *[f"__o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__t").isNotNull(), F.struct("__v", "__t")), True).over(by)
    out = a.unionByName(b).withColumn("__l", last).where(F.col("__side") == far)
    return out.select(*columns, F.col("__l.__v").alias(value + suffix), F.col("__l.__t").alias(time + suffix))


def bounded_fill(rows: DataFrame, pushes: DataFrame, keys: Sequence[str], time: str, value: str, order: Sequence[str], limit: int = 5, out: str = "filled") -> DataFrame:
    """A pushed value belongs to the last row at or before it (the latest push of a row wins) and is carried
    to at most ``limit`` following rows; rows without a value hold 0."""
    columns = rows.columns
    a = rows.select(*columns, F.lit(0).alias("__side"), F.lit(None).cast(pushes.schema[value].dataType).alias("__v"))
    blanks = [F.col(c) if c in (*keys, time) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    b = pushes.select(*blanks, F.lit(1).alias("__side"), F.col(value).alias("__v"))
    line = Window.partitionBy(*keys).orderBy(time, "__side", *order)
    numbered = a.unionByName(b).withColumn("__row", F.sum(F.when(F.col("__side") == 0, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    own = numbered.where("__side = 1 and __row > 0").groupBy(*keys, "__row").agg(F.max_by("__v", F.struct(time, *[c for c in order if c in columns])).alias("__own"))
    joined = numbered.where("__side = 0").join(own, [*keys, "__row"], "left")
    carried = F.last("__own", True).over(Window.partitionBy(*keys).orderBy("__row").rowsBetween(-limit, 0))
    return joined.withColumn(out, F.coalesce(carried, F.lit(0.0))).select(*columns, out)


def time_merge(streams: Sequence[tuple[str, DataFrame, str | None, str | None, Sequence[str]]]) -> DataFrame:
    """(table, key, time, seq, payload...) of many tables in one order.  Each stream: name, rows with a
    ``key`` column, time column, its unit, and the columns that break ties.  Times become the finest unit
    among them (a date is its last instant); untimed rows have time 0; ties go by table, then by seq."""
    unit = finest([u for _, _, t, u, _ in streams if t])
    parts = []
    for nth, (name, df, time, own, ties) in enumerate(streams):
        at = convert_unit(F.col(time), own, unit).cast("long") if time else F.lit(0).cast("long")
        payload = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in ("key", time)]))
        parts.append(df.select(F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), at.alias("time"), F.lit(nth).alias("table_order"), F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 20, "0") for c in ties]).alias("seq"), payload.alias("payload")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replay(merged: DataFrame) -> DataFrame:
    """A merge in its total order (a range-partitioned sort)."""
    return merged.orderBy("time", "table_order", "seq")
