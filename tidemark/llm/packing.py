"""Sum-of-squares online packing of token sequences into windows.

Let N(h) be the number of open windows filled to level h.  Each arriving piece of s tokens goes to the
level that makes the sum of the squared N(h) least: opening a window, or filling one of level h to h + s.
The counts are an array by level, so a placement reads one vector and keeps no list of windows.

At most ``OPEN_WINDOWS`` windows are open.  When so many are and none has room for a piece, the piece is cut
where it fills a window, and what is left of it opens the next: of the levels to fill up, again the one that
makes the sum of squares least.  So windows close as the stream goes on, and memory is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, steady

#: Marks the end of a document.
END_ID = 1
OPEN_WINDOWS = 8


class SumOfSquares:
    """Online packer of one stream; ``place`` returns the window that it fills, if any.  Pieces are
    (name, first token, tokens)."""

    def __init__(self, size: int, most: int = OPEN_WINDOWS):
        self.size, self.most = size, most
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]
        self.opened = 0

    def level(self, s: int) -> int:
        """The level to fill, wholly or in part; 0 opens a window.  Ties go to the fullest."""
        n, size = self.count, self.size
        to = np.arange(size) + s
        # moving one window from h to h + s, or to what is left of the piece: 2 (N(to) - N(h) + 1)
        change = 2 * (n[np.where(to > size, to - size, to)] - n[:size] + 1)
        if s < size:
            change[size - s] = 1 - 2 * n[size - s]  # a full window counts as none
        change[0] = 2 * n[s] + 1 if s < size else 0
        fits = (n[:size] > 0) & (to <= size)
        fits[0] = self.opened < self.most
        if not fits.any():
            fits = n[:size] > 0
        change[~fits] = np.iinfo(np.int64).max
        return size - 1 - int(np.argmin(change[::-1]))

    def place(self, name, s: int, at: int = 0) -> list | None:
        h = self.level(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
            self.opened -= 1
        take = min(s, self.size - h)
        window.append((name, at, take))
        if h + take < self.size:
            self._keep(window, h + take)
            return None
        if take < s:
            self._keep([(name, at + take, s - take)], s - take)
        return window

    def _keep(self, window: list, level: int) -> None:
        self.open[level].append(window)
        self.count[level] += 1
        self.opened += 1

    def rest(self) -> list:
        """The pieces of all open windows, fullest window first."""
        return [p for h in range(self.size, 0, -1) for w in self.open[h] for p in w]


def pack_stream(docs, encode, size: int, first_sequence: int) -> Iterator[tuple]:
    """(doc_id, start, length, crc32, doc_tokens, sequence_id, offset) for documents (id, text).

    Whole windows are cut off a document first; what is left of it is placed by ``SumOfSquares``.  When
    the stream ends, the pieces of the few windows still open are laid end to end and cut freely: whole
    windows, then powers of two, which need no padding.  So no token of padding is ever needed.
    """
    packer, sequence = SumOfSquares(size), first_sequence
    end = np.array([END_ID], dtype="<u4").tobytes()

    def piece(doc, start, ids, total, seq, offset):
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset

    for doc, text in docs:
        ids = encode(text) + end
        total = len(ids) // 4
        whole = total - total % size
        for start in range(0, whole, size):
            yield piece(doc, start, ids[4 * start : 4 * (start + size)], total, sequence, 0)
            sequence += 1
        if whole < total:
            full = packer.place((doc, whole, ids[4 * whole :], total), total - whole)
            offset = 0
            for (d, start, part, n), at, s in full or ():
                yield piece(d, start + at, part[4 * at : 4 * (at + s)], n, sequence, offset)
                offset += s
            sequence += bool(full)
    left = packer.rest()
    room, used, remaining = 0, 0, sum(s for _, _, s in left)
    for (d, start, ids, n), at, s in left:
        stop = at + s
        while at < stop:
            if used == room:
                sequence += room > 0
                room, used = (size if remaining >= size else 1 << (remaining.bit_length() - 1)), 0
            take = min(room - used, stop - at)
            yield piece(d, start + at, ids[4 * at : 4 * (at + take)], n, sequence, used)
            at, used, remaining = at + take, used + take, remaining - take


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_file: str, size: int = 2048) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), see ``pack_stream``.

    Each partition is packed on its own, in the order in which it is read, and numbers its sequences from
    its partition number, so nothing is shuffled and a lost task is simply run again.  Null and blank
    texts are the end mark alone; a null doc_id stays null; repeated rows are packed each.  A worker holds a
    few texts and OPEN_WINDOWS windows; a text of any length is encoded whole.  Partitions must be the same
    when computed again: ``docs`` that aren't read from a table as they are get written first.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tidemark.llm.pieces import WordPieces

        encoder = WordPieces(tokenizer_file)
        rows = ((d, t.as_py() or "") for b in batches for part in slices(b) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True))
        out: list[tuple] = []
        for x in pack_stream(rows, encoder.encode_packed, size, TaskContext.get().partitionId() << 36):
            out.append(x)
            if len(out) >= 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return map_arrow(steady(docs.select("doc_id", F.col("text")), "pack"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
