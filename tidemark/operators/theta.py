"""Joins on a key that few values share, with a further condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block on the left and on the right, about as many pairs as a task compares, rows that it reads, tasks.
BLOCK, TASK_PAIRS, TASK_ROWS, MOST_TASKS = (8192, 2048), 1 << 24, 1 << 20, 20_000
#: Keys of several blocks are broadcast up to this number (each has over 2048 rows).
FEW_KEYS = 1 << 20


def grid_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, condition: Column, block: tuple[int, int] = BLOCK) -> DataFrame:
    """The pairs of rows with the same key for which ``condition`` holds; no pair for a null key.

    A key has as many pairs as the product of its rows, so its rows are cut into blocks by their hash, and each
    block of the left meets each of the right in a cell of its own.  Cells are dealt over tasks by number: one
    key's pairs take as many tasks as they fill, and a task holds one block of the right at a time."""
    count = lambda df, key, n: df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias(n)).where("__k is not null")
    sizes = count(left, left_key, "__l").join(count(right, right_key, "__r"), "__k", "full").na.fill(0, ["__l", "__r"])
    sizes = sizes.withColumns({"__a": F.ceil(F.col("__l") / block[0]).cast("int"), "__b": F.ceil(F.col("__r") / block[1]).cast("int")})
    many = sizes.where("__a > 1 or __b > 1").select("__k", "__a", "__b")
    pairs, copies = (x or 0 for x in sizes.selectExpr("sum(double(__l) * __r)", "sum(double(__l) * __b + double(__r) * __a)").first())
    spread = min(MOST_TASKS, int(copies / TASK_ROWS) + 1)
    tasks = min(MOST_TASKS, int(pairs / min(TASK_PAIRS, block[0] * block[1])) + spread)
    told = F.broadcast(many) if many.count() <= FEW_KEYS else many

    def dealt(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        blocks = df.withColumn("__k", F.col(key)).where("__k is not null").join(told, "__k", "left").where(f"coalesce({other_n}, 1) > 0")
        blocks = blocks.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.coalesce(own_n, F.lit(1))).cast("int"))
        blocks = blocks.repartition(spread, "__k", own) if spread > 1 else blocks  # a file's rows can have many copies
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_n, F.lit(1)) - 1))).drop("__a", "__b").repartition(tasks, "__k", "__i", "__j")

    a, b = dealt(left, left_key, "__i", "__a", "__j", "__b"), dealt(right, right_key, "__j", "__b", "__i", "__a")
    return a.join(b, ["__k", "__i", "__j"]).where(condition).drop("__k", "__i", "__j")
