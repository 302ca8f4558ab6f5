"""What the operators of this subpackage share: written tables that cut lineage, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a join that are few enough to be sent to every executor; with more, both sides are dealt by key.
FEW_KEYS = 1 << 20
#: Bytes of one Arrow batch that carries texts to a Python worker, unless the session names another bound.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory of batches back, in the workers too


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder then stays
        pass


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` over batches bounded in bytes: rows of any length, thousands of them to a batch or one."""
    spark = df.sparkSession
    if spark.conf.get(_BATCHES) == _default_batches(spark):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def _default_batches(spark: SparkSession) -> str:
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_BATCHES)


def slices(batch: pa.RecordBatch, rows: int = 256) -> list[pa.RecordBatch]:
    """A batch in parts of some rows: what a worker holds and returns at a time."""
    return [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]


def materialise(df: DataFrame, name: str, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, so a lost
    executor costs a re-read, and work above it is not repeated for each use.  With ``onto``, a written table
    with the same columns, its rows are added to that table, which is to be read by the result from then on."""
    spark = df.sparkSession
    path = onto._tidemark_path if onto is not None else scratch_path(spark, name)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def join_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """The semi or anti join of ``df`` with a written table of keys.  They are counted first: only up to
    FEW_KEYS are broadcast, and then the rows of ``df`` (texts) stay where they are."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, on, how)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done with; it does so when their objects go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def steady(df: DataFrame, name: str) -> DataFrame:
    """``df`` if its partitions are those of a table that is read, the same whenever a task is run again; else
    it is written first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, name) if "Exchange" in plan or "Scan ExistingRDD" in plan else df


def forget(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    drop_path(df.sparkSession, df._tidemark_path)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates the large-star and small-star steps, each a partial-aggregated minimum per node and one
    equi-join, so no neighbourhood is gathered in one task; rounds grow with the logarithm of the
    longest path.  Each round's edges and minima are written tables: a join of two tables is one whose
    large partitions Spark can split, so a node with very many links is not one task's either.
    Self-links and nulls give no edge; an empty input gives an empty result.
    """
    now = _small_star(materialise(_oriented(edges), "cc"))
    before = _state(now)
    for _ in range(max_rounds):
        new = _small_star(_large_star(now))
        now, after = new, _state(new)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of its neighbours and itself; ``e`` goes."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
    out = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "cc")
    forget(e)
    forget(least)
    return out


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them; ``e`` goes."""
    least = materialise(e.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    linked = e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialise(linked.union(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
    forget(e)
    forget(least)
    return out
