"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are the pairs of neighbouring character classes in it (letters by case, digits, white space,
each mark of ASCII punctuation, other characters) and how often words repeat.  Square roots of their
frequencies, weighted by inverse document frequency, are projected on the leading singular vectors of a
bounded labelled sample.  The sample's vectors are broadcast (their number is a parameter); each document's
cosine with every one of them is computed in blocks, and its nearest neighbours vote with their labels,
weighted by similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, release, slices

#: Labelled rows of each class in the sample (those least by a hash of their id).
SAMPLE = 2000
NEIGHBOURS = 12
DIMENSIONS = 40
POWER = 8

_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13]] = 5
_CLASS[32] = 3
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 6 + _i
CLASSES = 38
TERMS = CLASSES * CLASSES + 4
#: Rows of the sample that the driver weighs at once.
ROWS = 256
#: Bytes of a text looked at at once; a text of any length takes memory for so many, and eight bytes a line.
PART = 1 << 18
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LINE = re.compile(rb"[^\n]+")


def _repeats(raw: bytes) -> tuple[int, int, int]:
    """(words, those equal to the next one, those equal to the second next one)."""
    n = once = twice = 0
    before: list[bytes] = []
    found = _WORD.finditer(raw)
    while part := [m[0] for m in islice(found, 4096)]:
        n += len(part)
        words = before + part
        # a pair counts in the part that holds its second word
        once += sum(map(eq, words[max(len(before) - 1, 0) :], words[max(len(before), 1) :]))
        twice += sum(map(eq, words[max(len(before) - 2, 0) :], words[max(len(before), 2) :]))
        before = words[-2:]
    return n, once, twice


def _repeated_lines(raw: bytes) -> float:
    import xxhash

    lines = np.fromiter((xxhash.xxh64_intdigest(m[0]) for m in _LINE.finditer(raw)), dtype=np.uint64)
    return 1 - len(np.unique(lines)) / len(lines) if len(lines) else 0.0


def terms(text: bytes | None) -> np.ndarray:
    """Relative frequencies of a whole text's terms, as square roots.  An empty text is the shortest there is."""
    raw = text or b""
    pairs, codes = np.zeros(CLASSES * CLASSES), np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(codes) - 1, PART):
        c = _CLASS[codes[at : at + PART + 1]].astype(np.int16)
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    n, once, twice = _repeats(raw)
    out = np.concatenate([pairs / max(len(codes) - 1, 1), [once / max(n, 1), twice / max(n, 1), _repeated_lines(raw), 1 / (1 + n)]])
    return np.sqrt(out)


class Model:
    def __init__(self, features: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        """``features``: rows of ``terms``; ``labels``: 0 or 1.  Some rows are worked on at a time."""
        n = len(features)
        self.labels = labels.astype(float)
        self.idf = np.log((1 + n) / (1 + (features > 0).sum(axis=0))) + 0.1
        if n:
            self.mean = features.mean(axis=0, dtype=float) * self.idf
            spread, part = np.zeros((features.shape[1], features.shape[1])), np.empty((features.shape[1], features.shape[1]))
            for at in range(0, n, ROWS):
                x = features[at : at + ROWS] * self.idf - self.mean
                spread += np.matmul(x.T, x, out=part)
            del part
            _, vectors = np.linalg.eigh(spread)
            self.axes = vectors[:, ::-1][:, :dimensions].astype(np.float32)
            del spread, vectors
        else:
            self.mean, self.axes = np.zeros(features.shape[1]), np.zeros((features.shape[1], dimensions), np.float32)
        self.points = np.concatenate([self.project(features[at : at + ROWS]) for at in range(0, max(n, 1), ROWS)])

    def project(self, features: np.ndarray) -> np.ndarray:
        v = ((features * self.idf - self.mean) @ self.axes).astype(np.float32)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 0)

    def score(self, features: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest; 0.5 where nothing is alike.

        Cosines count to five digits.  Where several points are equally near at the k-th place, all of them
        vote and share the places that are left, so no order of the sample decides.
        """
        if not len(self.points):
            return np.full(len(features), 0.5)
        cosine = np.round(self.project(features) @ self.points.T, 5)
        k = min(k, len(self.labels))
        kth = np.partition(cosine, -k, axis=1)[:, -k, None]
        places = (cosine > kth).astype(float)
        tied = cosine == kth
        places += tied * ((k - places.sum(axis=1, keepdims=True)) / tied.sum(axis=1, keepdims=True))
        weight = places * np.clip(cosine, 0, None).astype(float) ** POWER
        total = weight.sum(axis=1)
        return np.where(total > 0, np.clip(weight @ self.labels / np.where(total > 0, total, 1), 0, 1), 0.5)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, none of them held out.  A document with
    several labels counts as their majority (ties as 1); null labels are left out."""
    told = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rank = F.xxhash64("doc_id", F.lit(6))
    chosen = [told.where(F.col("y") == y).orderBy(rank, "doc_id").limit(sample) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t.as_py()).astype("<f4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], names=["doc_id", "terms", "y"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    release(docs.sparkSession)  # the driver has the least to hold when the sample comes
    rows = map_arrow(texts, run, "doc_id long, terms binary, y int").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    features = np.empty((len(order), TERMS), dtype="<f4")
    for i, x in zip(place, rows.column("terms"), strict=True):
        features[i] = np.frombuffer(x.as_buffer(), dtype="<f4")
    labels = rows.column("y").to_numpy()[order]
    del rows
    return Model(features, labels)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), at_least: float | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and each whole text's score (double, 0 to 1).  Rows that score below
    ``at_least`` are left out by the worker, so their texts don't come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                texts = part.column("text").cast(pa.binary())
                found = shared.value.score(np.array([terms(t.as_py()) for t in texts]))
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.float64())], names=[*keep, "score"])
                yield out if at_least is None else out.filter(pa.array(found >= at_least))

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return map_arrow(source, run, ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null and empty texts are scored like any other, as the shortest there are.  A text of any length is read
    in parts.  A null doc_id is not held out.  Without labels every score is 0.5.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
