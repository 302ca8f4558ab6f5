"""Token counts by section, from one encoding of the whole document.

A document is encoded once.  Each token's byte span follows from the lengths of the tokens before it; the
spans are joined to the sections' spans by an interval join on sorted bounds (two binary searches for all
tokens of a document).  A token that crosses a boundary is allocated by rule:
  'most'   to the section with most of its bytes, the earlier one on a tie (the default)
  'first'  to the section of its first byte
  'share'  to each section by its share of the token's bytes
Under each rule a document's counts sum to its number of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

RULES = ("most", "first", "share")
_LINES = re.compile(rb"[^\n]*\n+|[^\n]+")


def line_sections(text: bytes) -> list[tuple[int, int]]:
    """Lines with their line ends (further line ends belong to the line before them) as byte spans."""
    return [m.span() for m in _LINES.finditer(text)]


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) for each section.  ``lengths``: bytes of each token, in order; ``starts``: where
    the sections start, rising from 0, each lasting to the next.  ``crossing`` counts, at the section where
    they begin, the tokens that reach into another."""
    n = len(starts)
    stop = np.cumsum(lengths)
    begin = stop - lengths
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, np.maximum(stop - 1, begin), side="right") - 1
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    inside = first == last
    tokens = np.bincount(first[inside], minlength=n).astype(float)
    bounds = np.append(starts, stop[-1] if len(stop) else 0)
    for a, b, x, y in zip(begin[~inside].tolist(), stop[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist(), strict=True):
        shares = np.minimum(bounds[x + 1 : y + 2], b) - np.maximum(bounds[x : y + 1], a)
        if rule == "share":
            tokens[x : y + 1] += shares / (b - a)
        else:
            tokens[x + int(np.argmax(shares))] += 1
    return tokens, crossing


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, rule: str = "most", sections: Callable[[bytes], list[tuple[int, int]]] = line_sections) -> DataFrame:
    """One row per section of each document: doc_id, section (from 0), start and stop (byte offsets in the
    UTF-8 text), n_tokens, n_crossing.

    ``sections`` must cover the text without gaps.  Null and empty texts have no section and give no row.
    Repeated rows give repeated rows; a null doc_id stays null.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.pieces import BytePieces

        encoder = BytePieces(ranks_file, pattern)
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema]
            nulls: list[np.ndarray] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                raw = text.encode()
                if not raw:
                    continue
                spans = np.array(sections(raw), dtype=np.int64)
                tokens, crossing = attribute(encoder.token_bytes[encoder.encode(text)], spans[:, 0], rule)
                n = len(spans)
                for into, x in zip(parts, (np.full(n, d or 0), np.arange(n), spans[:, 0], spans[:, 1], tokens, crossing), strict=True):
                    into.append(x)
                nulls.append(np.full(n, d is None))
            columns = [pa.array(np.concatenate(p) if p else [], f.type, mask=np.concatenate(nulls) if nulls and i == 0 else None) for i, (p, f) in enumerate(zip(parts, schema, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, section int, start long, stop long, n_tokens double, n_crossing long")


def field_token_counts(docs: DataFrame, fields: tuple[str, ...], ranks_file: str, pattern: str, rule: str = "most", mark: str = "\n") -> DataFrame:
    """One row per field of each document: doc_id, field, start and stop (characters in the fields' joined text),
    n_tokens, n_crossing.

    The fields are joined by ``mark``, which belongs to the field before it, and encoded once; the tokens' byte spans
    are joined to the fields' spans.  Null fields are empty; a field without characters has no tokens, and the
    counts of a document sum to its tokens.  A document without any characters has 0 in each field.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.pieces import BytePieces

        encoder = BytePieces(ranks_file, pattern)
        for b in batches:
            out: list[tuple] = []
            for d, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = [(v or "") + mark for v in values[:-1]] + [values[-1] or ""]
                text = "".join(parts)
                sizes, stops = np.array([len(p.encode()) for p in parts]), np.cumsum([len(p) for p in parts]).tolist()
                held = np.flatnonzero(sizes)
                tokens, crossing = np.zeros(len(parts)), np.zeros(len(parts), dtype=np.int64)
                if len(held):
                    starts = (np.cumsum(sizes) - sizes)[held]
                    tokens[held], crossing[held] = attribute(encoder.token_bytes[encoder.encode(text)], starts, rule)
                out += list(zip([d] * len(parts), fields, [0, *stops[:-1]], stops, tokens.tolist(), crossing.tolist(), strict=True))
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return map_arrow(docs.select("doc_id", *[F.col(f).cast("string") for f in fields]), run, "doc_id long, field string, start long, stop long, n_tokens double, n_crossing long")
