"""SentencePiece encoding and decoding, with distinct sampled segmentations.

A text's segmentations form a lattice: an edge is a piece that matches at a position (or the byte pieces
of a character that no piece holds).  A segmentation's probability is the product of its pieces'
probabilities over the lattice's total.  Sampling k of them without replacement is taking the k largest
of their log-probabilities plus independent Gumbel noise.  These are found by an A* search from the start
of the text: a prefix's priority is the largest perturbed value among its completions, which is exact
because a maximum of Gumbels is a Gumbel at the log of their total weight (the lattice's backward sums),
and the children's values are drawn given their parent's.  So no segmentation is listed but those
returned, and the (k+1)-th value kappa gives each one's inclusion score 1 - exp(-exp(log p - kappa)).
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks (words) whose lattices one worker keeps; emptied when full.
CACHE_ENTRIES = 60_000
_CHUNKS = re.compile("▁*[^▁]+|▁+")


class Sampler:
    """Lattices over one model's pieces.  ``temperature`` flattens (over 1) or sharpens the choice."""

    def __init__(self, model_file: str, temperature: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.model.get_piece_size()
        pieces = [(self.model.id_to_piece(i), i) for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.bytes = {int(p[3:5], 16): i for p, i in pieces if self.model.is_byte(i)}
        plain = [(p, i) for p, i in pieces if not self.model.is_byte(i)]
        if any("▁" in p.lstrip("▁") for p, _ in plain):
            raise ValueError("pieces must not reach over a space")
        # the files of merge models hold ranks for scores; Zipf's law turns a rank into a probability
        scores = np.array([self.model.get_score(i) for _, i in plain])
        if scores.min() < -1000:
            scores = -np.log(2 - scores)
        scores = (scores - np.logaddexp.reduce(scores)) / temperature
        self.pieces = {p: (i, float(s)) for (p, i), s in zip(plain, scores, strict=True)}
        self.byte_score = float(scores.min()) - 5.0
        self.longest = max(map(len, self.pieces))
        self.lattices: dict[str, tuple[list, float]] = {}

    def lattice(self, chunk: str) -> tuple[list, float]:
        """(for each position: the steps (log probability given the position, end, ids)), log of the total."""
        found = self.lattices.get(chunk)
        if found:
            return found
        n, get = len(chunk), self.pieces.get
        sums, steps = [0.0] * (n + 1), [()] * n
        for at in range(n - 1, -1, -1):
            out = [(x[1] + sums[end], end, (x[0],)) for end in range(at + 1, min(n, at + self.longest) + 1) if (x := get(chunk[at:end]))]
            if not out or out[0][1] != at + 1:
                ids = tuple(self.bytes[b] for b in chunk[at].encode())
                out.append((self.byte_score * len(ids) + sums[at + 1], at + 1, ids))
            most = max(s for s, _, _ in out)
            sums[at] = most + log(sum(exp(s - most) for s, _, _ in out))
            steps[at] = [(s - sums[at], end, ids) for s, end, ids in out]
        if len(self.lattices) >= CACHE_ENTRIES:
            self.lattices.clear()
        if n <= 48:
            self.lattices[chunk] = (steps, sums[0])
        return steps, sums[0]

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float]]:
        """Up to k distinct segmentations: (ids, log probability, inclusion score), best perturbed first.

        All segmentations come, with score 1, where there are k or fewer.  An empty text has one, empty.
        """
        norm = self.model.normalize(text)
        chunks = _CHUNKS.findall(norm)
        lattices = [self.lattice(c)[0] for c in chunks]
        ends = [len(c) for c in chunks]
        rng = np.random.default_rng(seed)
        noise: list[float] = []
        # waiting: (-G, serial, log p, chunk, position, path), the k+1 best only; a path is (ids, path before)
        waiting: list[tuple] = [(-rng.gumbel(), 0, 0.0, 0, 0, None)]
        done: list[tuple] = []
        serial, last = 0, len(chunks)
        while waiting and len(done) <= k:
            minus, _, p, c, at, path = waiting.pop(0)
            g, room = -minus, k - len(done)
            while c < last:
                steps = lattices[c][at]
                if len(steps) == 1:
                    _, to, ids = steps[0]
                else:
                    if len(noise) < len(steps):
                        noise = rng.gumbel(size=1024).tolist() + noise
                    drawn = [s[0] + noise.pop() for s in steps]
                    top = max(drawn)
                    best = drawn.index(top)
                    floor = -waiting[room - 1][0] if len(waiting) >= room > 0 else None
                    for i, x in enumerate(drawn):
                        if i == best:
                            continue
                        # the value given that the largest of them is g
                        d = x - top
                        if d >= 0:
                            d = -1e-12
                        v = g - p - x + log1p(-exp(d))
                        value = g - max(0.0, v) - log1p(exp(-abs(v)))
                        if room and (floor is None or value > floor):
                            s, to, ids = steps[i]
                            serial += 1
                            nc, nat = (c + 1, 0) if to == ends[c] else (c, to)
                            insort(waiting, (-value, serial, p + s, nc, nat, (ids, path)))
                            del waiting[room:]
                            floor = -waiting[room - 1][0] if len(waiting) >= room else None
                    s, to, ids = steps[best]
                    p += s
                path = (ids, path)
                c, at = (c + 1, 0) if to == ends[c] else (c, to)
            done.append((g, p, path))
        kappa = done[k][0] if len(done) > k else None
        out = []
        for _, p, path in done[:k]:
            parts = []
            while path:
                parts.append(path[0])
                path = path[1]
            ids = [i for part in reversed(parts) for i in part]
            out.append((ids, p, 1.0 if kappa is None else -np.expm1(-exp(min(p - kappa, 700.0)))))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def sample_segmentations(rows: DataFrame, keys: tuple[str, ...], model_file: str, k: int = 3, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """For each row of ``rows`` (the long columns ``keys`` and text): the keys, rank, ids, log_prob,
    inclusion and decoded, for up to ``k`` distinct segmentations.

    The noise is seeded by the values of the keys and ``seed`` alone, so a row's result does not depend on
    where it is computed, and rows with equal keys and texts have equal results.  Null texts are empty and
    have one segmentation, of no piece; null keys count as -1 for the seed.
    """
    schema = pa.schema([*((c, pa.int64()) for c in keys), ("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model_file, temperature)
        for b in batches:
            names = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True))
            out: list[tuple] = []
            for key, row_seed, text in zip(names, b.column(len(keys)).to_pylist(), b.column(len(keys) + 1), strict=True):
                for rank, (ids, p, score) in enumerate(sampler.sample(text.as_py() or "", k, row_seed), 1):
                    out.append((*key, rank, ids, p, score, sampler.decode(ids)))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    row_seed = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) for c in keys]).bitwiseAND((1 << 62) - 1).alias("row_seed")
    source = rows.select(*[F.col(c).cast("long").alias(c) for c in keys], row_seed, F.col("text"))
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", rank int, ids array<int>, log_prob double, inclusion double, decoded string")
