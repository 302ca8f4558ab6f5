"""Exact top-k inner-product search with block-at-a-time pruning.

Each component x is one of two terms of dimension i, by its sign.  The candidates of a shard are put into
an order in which neighbours resemble each other and cut into ranges of documents.  A block keeps the
maximum weight of each of its terms, and a forward index (its documents' weights, row by row).  For a
query the blocks are ordered by the sum of the maxima of the query's terms, which bounds every score in
them; blocks are scored in that order until the next bound is below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

BLOCK_DOCS = 32
#: Components of the candidates in a shard and of the queries in a chunk: what one task holds of each.  With
#: n vectors of d components, n d / SHARD_VALUES copies of each query and as many times the queries' share of
#: each candidate are dealt.
SHARD_VALUES = CHUNK_VALUES = 1 << 20
#: Blocks scored between two looks at the bounds.
STEP = 8


def resembling(docs: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which each range of ``size`` resembles itself: halves along the widest
    dimension, again and again."""
    out, todo = [], [np.arange(len(docs))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = docs[at]
        by = np.argsort(own[:, np.argmax(own.std(axis=0))], kind="stable")
        half = (len(at) // 2 + size - 1) // size * size
        todo += [at[by[half:]], at[by[:half]]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class BlockIndex:
    """Whole-number document vectors, in ranges of documents."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, size: int = BLOCK_DOCS):
        order = resembling(docs, size)
        self.ids, self.docs = ids[order], docs[order]
        self.starts = np.arange(0, len(ids), size)
        self.most = np.maximum.reduceat(self.docs, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.docs, self.starts, axis=0)
        self.size = size
        self.scored = 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Summed term maxima of each (query, block)."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, own: int | None, query: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by score and then smaller id; not the query's own id."""
        order = np.argsort(-bounds, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.docs.dtype)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            if len(scores) == k:
                some = some[bounds[some] >= scores[-1]]
                if not len(some):
                    break
            rows = np.concatenate([np.arange(self.starts[b], min(self.starts[b] + self.size, len(self.ids))) for b in some.tolist()])
            self.scored += len(rows)
            new, new_ids = self.docs[rows] @ query, self.ids[rows]
            keep = new_ids != own if own is not None else slice(None)
            ids, scores = np.concatenate([ids, new_ids[keep]]), np.concatenate([scores, new[keep]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers; as doubles where every sum stays exact, else as Python integers."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return m.astype(np.float64) if not len(m) or float(np.abs(m.astype(np.float64)).max()) ** 2 * dim < 2**53 else m.astype(object)


def _search(k: int):
    def run(key: tuple, docs: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        dim = key[0].as_py()
        d, q = _matrix(docs["v"], dim), _matrix(queries["q"], dim)
        if object in (d.dtype, q.dtype) or np.abs(d).max() * np.abs(q).max() * dim >= 2**53:
            d, q = d.astype(object), q.astype(object)
        index = BlockIndex(docs["vec_id"].to_numpy(), d) if d.dtype != object else None
        out: list[tuple] = []
        for at in range(0, len(q), 128):
            part = q[at : at + 128]
            bounds = index.bounds(part) if index else None
            for i, own in enumerate(queries["query_id"][at : at + 128].to_pylist()):
                if index:
                    ids, scores = index.search(own, part[i], bounds[i], k)
                    out += [(own, x, y) for x, y in zip(ids.tolist(), scores.tolist(), strict=True)]
                else:
                    every = sorted((-int(sum(a * b for a, b in zip(row, part[i], strict=True))), v) for row, v in zip(d, docs["vec_id"].to_pylist(), strict=True) if v != own)
                    out += [(own, v, -s) for s, v in every[:k]]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.Table.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in cols], schema=schema)

    return run


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of each component as a double; vectors that are null or empty,
    or hold a null or non-finite component, and rows without an id are left out."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.size(x).alias("dim"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of ``vectors`` (vec_id, embedding) with the largest
    inner products with each row of ``queries`` (same columns); ties go to the smaller vec_id; a query's
    own id is no candidate.

    Both sides are dealt into shards and chunks of bounded size by hash, and each shard meets each chunk
    in a task of its own; the shards' best k are merged by rank.  Vectors are compared at equal length.
    Rows repeated with one id are one vector (the first by value).  Scores are exact; they must fit a long.
    """
    docs = materialise(quantised(vectors, scale).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v"), "vectors")
    asked = docs.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    n_docs, n_asked, dim = docs.count(), asked.count(), docs.agg(F.max("dim")).first()[0] or 1
    shards, chunks = max(1, -(-n_docs * dim // SHARD_VALUES)), max(1, -(-n_asked * dim // CHUNK_VALUES))
    shard, chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(chunks))
    left = docs.withColumn("shard", shard).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("chunk", chunk.cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = right.select(*[F.col(c).alias(f"asked_{c}") for c in ("dim", "shard", "chunk")], F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = left.groupBy("dim", "shard", "chunk").cogroup(right.groupBy("asked_dim", "asked_shard", "asked_chunk")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
