"""Exact substring deduplication with longest-previous-factor (LPF) arrays.

LPF[i] is the length of the longest string at position i that also starts earlier.  In suffix order the
best earlier start is the previous or the next entry with a smaller position (PSV, NSV), so
LPF[i] = max(lcp(i, PSV), lcp(i, NSV)).  Bytes under a position with LPF >= ``length`` are removed.

To run this over a corpus, every window of ``length`` bytes is dealt by content: its key is the least
hash of the ``GRAM``-byte strings in it, so equal windows meet wherever they are.  Neighbouring windows
with one key form a segment.  Only segments whose key occurs again are looked at.  Copies of a whole segment
are put together before anything is gathered (they need no bytes to be told); the different segments of a key
go, as bytes, to suffix arrays of bounded size, whose LPF arrays say which windows start earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, slices

GRAM = 32
#: Bytes of text hashed, and of segments sorted, at once; a longer text is hashed in overlapping parts.
BLOCK_BYTES = 1 << 20
#: Blocks whose equal segments are joined before they are dealt: a passage has one row at most in so many.
JOINED_BLOCKS = 8
#: Segments of one key that one suffix array takes; windows of keys with more are also told by their hashes.
KEY_SEGMENTS = 2048

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def _words(text: np.ndarray, reach: int) -> np.ndarray:
    """The eight bytes at every position of a text and ``reach`` beyond it, as one number each."""
    padded = np.concatenate([text, np.zeros(reach + 8, dtype=np.uint8)])
    return np.ndarray(len(text) + reach, dtype=">u8", buffer=padded.data, strides=(1,))


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes of bytes sorted by their first ``depth`` bytes (all, if None), ties by position.

    Prefix doubling from eight bytes on: ranks of k bytes give ranks of 2k.  Suffixes with equal prefixes share
    a rank.  Sorted keys are eight bytes a position, all else is four.
    """
    n = len(text)
    depth = n if depth is None else depth
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        fresh = np.empty(n, dtype=np.int32)
        fresh[order] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]]), dtype=np.int32)
        return fresh

    k = min(8, depth)
    # what lies beyond the end counts as less than any byte: how many of the bytes exist decides last
    first = _words(text, 0).astype(np.uint64) >> np.uint64(64 - 8 * k)
    rank = ranked(first)
    if k > 1:
        exist = np.minimum(np.arange(n, 0, -1), k)
        rank = ranked(rank.astype(np.int64) * 16 + exist)
    while k < depth and rank.max() < n:
        step = min(k, depth - k)
        key = rank.astype(np.int64) * (n + 2)
        if step < n:
            key[: n - step] += rank[step:]
        rank, k = ranked(key), k + step
    return np.argsort(rank, kind="stable"), rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the last one before it that is smaller, or -1.  All entries jump at once: what lies
    between an entry and its candidate is never smaller, so an entry may go on from its candidate's."""
    seen = np.append(values, np.iinfo(values.dtype).min)  # at -1: smaller than any
    before = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(seen[before] >= values)
    while len(open_):
        before[open_] = before[before[open_]]
        open_ = open_[seen[before[open_]] >= values[open_]]
    return before


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the first one after it that is smaller, or -1."""
    back = previous_smaller(values[::-1])[::-1]
    return np.where(back < 0, -1, len(values) - 1 - back)


def common_prefix(words: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at i and at j, up to ``most``; ``words``: ``_words``."""
    out = np.full(len(i), most, dtype=np.int32)
    open_ = np.arange(len(i))
    for at in range(0, most, 8):
        differ = words[i[open_] + at] ^ words[j[open_] + at]
        ends = differ != 0
        high = np.frexp(differ[ends].astype(np.float64))[1] - 1  # the highest differing bit, or one above it
        high -= (differ[ends].astype(np.uint64) >> np.minimum(high, 63).astype(np.uint64) == 0).astype(high.dtype)
        out[open_[ends]] = np.minimum(at + (63 - np.minimum(high, 63)) // 8, most)
        open_ = open_[~ends]
        if not len(open_):
            break
    return out


def factors(text: np.ndarray, at: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """The LPF array, up to ``most``, of the positions ``at`` of some bytes: the longest prefix of each suffix
    that also starts at a position with a smaller ``place`` (equal places are one position).

    The previous and the next entry in suffix order with a smaller place hold the longest such prefixes.
    """
    if not len(at):
        return np.zeros(0, dtype=np.int32)
    rank = suffix_array(text, most)[1][at]
    by = np.lexsort((place, rank))
    own, where, words = place[by], at[by], _words(text, most + 8)
    out = np.zeros(len(at), dtype=np.int32)
    for near in (previous_smaller(own), next_smaller(own)):
        some = np.flatnonzero(near >= 0)
        out[by[some]] = np.maximum(out[by[some]], common_prefix(words, where[some], where[near[some]], most))
    return out


def longest_previous_factor(text: bytes) -> np.ndarray:
    """LPF of every position of one text."""
    codes, every = np.frombuffer(text, dtype=np.uint8), np.arange(len(text))
    found = factors(codes, every, every, len(text))
    return np.minimum(found, len(text) - every)  # no prefix goes beyond the end


def window_keys(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes: the least hash of the GRAM-byte strings in it, and whether the
    string that it starts with has that hash."""
    h, k, step = _BYTE[text], 1, 0
    while k < GRAM:
        h = h[:-k] * _ODD[step] + h[k:]
        h ^= h >> np.uint64(29)
        k, step = 2 * k, step + 1
    h *= _ODD[8]
    h ^= h >> np.uint64(32)
    least, width, k = h, length - GRAM + 1, 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if width > k:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    return least, h[: len(least)] == least


_ODD_BASE = int(_ODD[9])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(b, BLOCK_BYTES + 4096) for b in (_ODD_BASE, pow(_ODD_BASE, -1, 1 << 64)))


def _digests(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's content: random numbers of its bytes, times powers of an odd base."""
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[text] * _UP[: len(text)], out=sums[1:])
    h = (sums[end] - sums[begin]) * _DOWN[begin]
    h ^= (end - begin).astype(np.uint64) * _ODD[10]
    h ^= h >> np.uint64(32)
    return h * _ODD[11]


_SEGMENT = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def _block_segments(block: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """Segments of some pieces (document, offset, bytes): key, content hash, document, first window, number of
    windows, and whether it goes on where the one before it ends."""
    text = np.frombuffer(b"".join(t for _, _, t in block), dtype=np.uint8)
    keys, leads = window_keys(text, length)
    new = np.ones(len(keys) + 1, dtype=bool)
    # a segment's windows share one place of that string, so no window occurs twice in a segment
    new[1:-1] = (keys[1:] != keys[:-1]) | leads[:-1]
    sizes = np.array([len(t) for _, _, t in block])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    new[begins[begins < len(keys)]] = True
    first = np.flatnonzero(new)
    which = np.searchsorted(ends, first[:-1], side="right")
    stop = np.minimum(first[1:], ends[which] - length + 1)
    first = first[:-1]
    ok = stop > first
    first, stop, which = first[ok], stop[ok], which[ok]
    offset = np.array([o for _, o, _ in block]) - begins
    follows = np.zeros(len(first), dtype=bool)
    follows[1:] = (first[1:] == stop[:-1]) & (which[1:] == which[:-1])
    ids = np.array([d for d, _, _ in block], dtype=np.int64)[which]
    return keys[first], _digests(text, first, stop + (length - 1)), ids, first + offset[which], (stop - first).astype(np.int32), follows


def _joined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The segments of some blocks.  Equal ones after the first are told by a null content hash: they are
    known to repeat, and neighbours that all are make one row."""
    h, s, ids, start, n, follows = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((start, ids, s, h))
    head = np.ones(len(h), dtype=bool)
    head[1:] = (h[order[1:]] != h[order[:-1]]) | (s[order[1:]] != s[order[:-1]])
    first = np.empty(len(h), dtype=np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    known = (ids[first] != ids) | (start[first] != start)  # a repeated row has the same place
    inner = np.zeros(len(h), dtype=bool)
    inner[1:] = known[1:] & known[:-1] & follows[1:]
    heads = np.flatnonzero(~inner)
    windows = np.add.reduceat(n, heads) if len(heads) else n
    columns = [h[heads].view(np.int64), pa.array(s[heads].view(np.int64), mask=known[heads]), ids[heads], start[heads], windows.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SEGMENT, strict=True)], schema=_SEGMENT)


def _find_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, parts = [], 0, []

        def close() -> None:
            if block:
                parts.append(_block_segments(block, length))
                block.clear()

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                for at in range(0, len(text) - length + 1, BLOCK_BYTES // 2):
                    piece = text[at : at + BLOCK_BYTES // 2 + length - 1]
                    if size + len(piece) > BLOCK_BYTES:
                        close()
                        size = 0
                    block.append((d, at, piece))
                    size += len(piece)
                    if len(parts) == JOINED_BLOCKS:
                        yield _joined(parts)
                        parts.clear()
        close()
        if parts:
            yield _joined(parts)

    return run


_BYTES = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary()), ("split", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _cut_segments(length: int):
    """Rows (document, text, its list of segments) -> the bytes of those segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for d, t, found in zip(b.column(0), b.column(1), b.column(2), strict=True):
                doc, text = d.as_py(), t.as_py()
                for x in found.values.to_pylist():
                    out.append((x["h"], x["salt"], doc, x["start"], text[x["start"] : x["start"] + x["n"] + length - 1], x["split"]))
                    if len(out) == 4096:
                        yield _batch(out, _BYTES)
                        out = []
        if out:
            yield _batch(out, _BYTES)

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("hash", pa.binary())])


def _settle(rows: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Some whole groups of segments: the windows whose LPF over them is ``length``.

    Of split keys, windows that are first here are given by hash."""
    rows.sort(key=lambda r: (r[2], r[3]))
    raw = b"".join(r[4] for r in rows)
    sizes = np.array([len(r[4]) for r in rows])
    ends = np.cumsum(sizes)
    windows = sizes - length + 1  # those inside one segment
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (ends - sizes)[owner] + inside
    ids, start = np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64)[owner] + inside
    # places in the corpus, numbered; segments may overlap, and rows may repeat
    by = np.lexsort((start, ids[owner]))
    moved = np.zeros(len(at), dtype=np.int32)
    moved[1:] = (ids[owner[by[1:]]] != ids[owner[by[:-1]]]) | (start[by[1:]] != start[by[:-1]])
    place = np.empty(len(at), dtype=np.int32)
    place[by] = np.cumsum(moved)
    del by, moved, inside
    again = factors(np.frombuffer(raw, dtype=np.uint8), at, place, length) >= length
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    cut = np.concatenate([[False], owner[1:] != owner[:-1]]) & again  # a run ends with its segment
    first = np.flatnonzero((edge[:-1] == 1) | cut)
    last = np.flatnonzero(again & ((edge[1:] == -1) | np.append(cut[1:], False)))
    nothing = pa.nulls(len(first), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(ids[owner[first]]), pa.array(start[first]), pa.array((last - first + 1).astype(np.int32)), nothing], schema=_FOUND)
    split = np.array([bool(r[5]) for r in rows])
    if split.any():
        import xxhash

        left = np.flatnonzero(split[owner] & ~again)
        for some in (left[i : i + 8192] for i in range(0, len(left), 8192)):
            found = pa.array([xxhash.xxh3_128_digest(raw[x : x + length]) for x in at[some].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[some]]), pa.array(start[some]), pa.array(np.ones(len(some), np.int32)), found], schema=_FOUND)


def _settle_groups(length: int):
    """Sorted by key and salt: whole groups are gathered up to a block, then settled together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for b in batches:
            for part in slices(b, 1024):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if size >= BLOCK_BYTES and (row[0], row[1]) != group:
                        yield from _settle(held, length)
                        held, size = [], 0
                    group = (row[0], row[1])
                    held.append(row)
                    size += len(row[4])
        if held:
            yield from _settle(held, length)

    return run


def repeated_windows(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, spans): where windows of ``length`` bytes start that also start earlier, as an array of
    (start, n windows), for the documents that have any.  ``docs``: (doc_id, text as binary), no nulls.

    The result is not written: read with ``docs`` in one plan, both uses of the texts share a shuffle."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    segments = map_arrow(docs, _find_segments(length), "h long, s long, doc_id long, start long, n int")
    known = F.col("s").isNull()
    key = [F.when(known, F.xxhash64("doc_id", "start")).otherwise(F.col("h")).alias("h"), known.alias("known"), "s", "doc_id", "start", "n"]
    dealt = segments.select(*key)
    by = Window.partitionBy("h", "known").orderBy("s", "doc_id", "start")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("doc_id", "start")
    later = F.min(place).over(Window.partitionBy("h", "known", "s")) != place
    told = dealt.select("*", (F.min("s").over(whole) != F.max("s").over(whole)).alias("mixed"), F.count("*").over(whole).alias("rows")).withColumn("repeats", F.col("known") | later)
    told = materialise(told.where("repeats or mixed").drop("known", "s", "mixed"), "repeats")
    open_ones = told.where("not repeats").withColumn("salts", F.ceil(F.col("rows") / KEY_SEGMENTS).cast("int"))
    open_ones = open_ones.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int")).withColumn("split", F.col("salts") > 1)
    wanted = open_ones.groupBy("doc_id").agg(F.collect_list(F.struct("h", "salt", "start", "n", "split")).alias("found"))
    bytes_of = map_arrow(docs.join(wanted, "doc_id"), _cut_segments(length), "h long, salt int, doc_id long, start long, bytes binary, split boolean")
    found = map_arrow(bytes_of.repartition("h", "salt").sortWithinPartitions("h", "salt"), _settle_groups(length), "doc_id long, start long, n int, hash binary")
    alone = F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("start").cast("string")).cast("binary")
    first = Window.partitionBy(F.coalesce("hash", alone)).orderBy("doc_id", "start")
    found = found.withColumn("nth", F.rank().over(first)).where("hash is null or nth > 1")
    spans = told.where("repeats").select("doc_id", "start", "n").union(found.select("doc_id", "start", "n"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _merged(spans: list[dict] | None, length: int, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, n in sorted((x["start"], x["n"]) for x in spans or ()):
        b = min(a + n + length - 1, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _clean(length: int, as_text: bool):
    """Rows (document, text, its windows) -> (document, n_bytes, kept, removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 128):
                sizes, kept, runs = [], [], []
                for t, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    text = t.as_py() or b""
                    cuts = _merged(spans, length, len(text))
                    runs.append([{"start": x, "stop": y} for x, y in cuts])
                    edges = [0, *(e for c in cuts for e in c), len(text)]
                    left = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                    sizes.append(len(text))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(runs, _RUNS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "removed"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, ``n_bytes`` of the text as UTF-8, ``kept`` (what stays of
    it) and ``removed`` (array of start, stop byte offsets).  ``as_text``: ``kept`` is a string, without what is left
    of characters that a cut parts.

    Every byte under a window of ``length`` bytes that also starts earlier, in a smaller doc_id or earlier
    in the same document, goes; windows are judged on the input.  Null texts are empty.  Rows with a null
    doc_id, or one that they share with another text, have no place in the order: they stay whole and take
    part in nothing.  Repeated rows are one document, and each has its result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    named = rows.where("doc_id is not null")
    text_hash = F.xxhash64("bytes")
    clash = named.groupBy("doc_id").agg((F.min(text_hash) != F.max(text_hash)).alias("clash")).where("clash").select("doc_id")
    clash = materialise(clash, "clashing-ids")
    placed = named.join(clash, "doc_id", "left_anti")
    apart = named.join(clash, "doc_id", "left_semi").union(rows.where("doc_id is null"))
    joined = placed.join(repeated_windows(placed, length), "doc_id", "left").select("doc_id", "bytes", "spans")
    joined = joined.union(apart.select("doc_id", "bytes", F.lit(None).cast("array<struct<start: long, n: int>>")))
    kept = "string" if as_text else "binary"
    return map_arrow(joined, _clean(length, as_text), f"doc_id long, n_bytes long, kept {kept}, removed array<struct<start: long, stop: long>>")
