"""Rows as packed little-endian bytes, by a declared table: ingest, output and the choice of output formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.plans.schema import Table
from tidemark.sources import text

#: Bytes of records, with what lies beside them, that are worked on at once.
SLICE = 4 << 20


def layout(table: Table) -> np.dtype:
    """The packed record of a table's fields."""
    kinds = {"F": "f", "P": "f", "U": "u", "C": "S"}
    return np.dtype([(f.name, f"<{kinds.get(f.type, 'i')}{f.size}", (f.count,) if f.count > 1 else ()) for f in table.fields])


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a string or binary array begins, with the end of the last, and the bytes."""
    values = values.cast(pa.large_binary())
    _, places, raw = values.buffers()
    places = np.frombuffer(places, dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return places, np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)


def rows_from_bytes(df: DataFrame, column: str, table: Table) -> DataFrame:
    """Each value of ``column`` holds whole records, one after the other, and becomes that many rows beside the
    other columns.  Values whose length isn't a multiple of the record's are left out, as a whole."""
    record, kept = layout(table), [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(len(kept))), 0).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((sizes > 0) & (sizes % record.itemsize == 0)))
            places, raw = _binary(b.column(len(kept)))
            rows, ends = raw[places[0] : places[-1]].view(record), (places[1:] - places[0]) // record.itemsize
            step = max(1, SLICE // (record.itemsize + sum(b.column(j).nbytes for j in range(len(kept))) // max(1, b.num_rows)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                of = pa.array(np.searchsorted(ends, np.arange(at, at + len(part)), side="right")) if kept else None
                beside = [b.column(j).take(of) for j in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*beside, *(_column(part[f.name], f) for f in table.fields)], names=[*kept, *(f.name for f in table.fields)])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{f.name}` {f.spark().dataType.simpleString()}" for f in table.fields]
    return df.select(*kept, column).mapInArrow(run, ", ".join(kinds))


def _column(values: np.ndarray, field) -> pa.Array:
    kind, values = to_arrow_type(field.element()), np.ascontiguousarray(values).reshape(-1)
    flat = _text(values) if field.type == "C" else pa.array(values)
    flat = flat.cast(pa.float64()).cast(kind) if field.type == "P" else flat.cast(kind)
    return flat if field.count == 1 else pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, field.count, dtype=np.int32), flat)


def _text(values: np.ndarray) -> pa.Array:
    """Bytes up to their last one that isn't zero, as text; what isn't UTF-8 is left out."""
    sizes, width = np.char.str_len(values), values.dtype.itemsize
    raw = values.view(np.uint8).reshape(-1, width)[np.arange(width) < sizes[:, None]]
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    try:
        return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(places), pa.py_buffer(raw)]).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array(np.char.decode(values, "utf-8", "ignore").tolist(), pa.string())


def rows_to_bytes(df: DataFrame, table: Table, out: str = "bytes") -> DataFrame:
    """The table's fields of each row as one packed record, beside the other columns."""
    record, names = layout(table), [f.name for f in table.fields]
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // max(1, record.itemsize))
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                rows = np.zeros(b.num_rows, dtype=record)
                for f in table.fields:
                    rows[f.name] = _values(b.column(b.schema.get_field_index(f.name)), f, record[f.name].base)
                places = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(record.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(places), pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), packed], names=[*kept, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, *names).mapInArrow(run, f"{kinds + ', ' if kinds else ''}`{out}` binary")


def _values(values: pa.Array, field, kind: np.dtype) -> np.ndarray | list:
    """A field's values as they are stored: as a whole where the column's type allows, else one by one."""
    if field.count > 1 and pa.types.is_list(values.type) and not values.null_count and pc.all(pc.equal(pc.list_value_length(values), field.count)).as_py():
        flat = _numbers(values.flatten(), kind)
        if flat is not None:
            return flat.reshape(-1, field.count)
    if field.count == 1 and field.type == "C" and pa.types.is_string(values.type) and not values.null_count:
        places, raw = _binary(values)
        at = np.arange(kind.itemsize)
        held = at < np.diff(places)[:, None]
        chars = np.zeros(held.shape, dtype=np.uint8)
        chars[held] = raw[(places[:-1, None] + at)[held]]
        return chars.view(kind).reshape(-1)
    whole = _numbers(values, kind) if field.count == 1 else None
    return whole if whole is not None else [v.encode()[: field.size] if field.type == "C" else v for v in values.to_pylist()]


def _numbers(values: pa.Array, kind: np.dtype) -> np.ndarray | None:
    if values.null_count:
        return None
    if kind.kind in "iu" and pa.types.is_integer(values.type):
        return values.cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False)  # fails for what doesn't fit
    if kind.kind == "f" and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type)):
        return values.to_numpy(zero_copy_only=False)
    return None


def format_column(kind: str, table: Table) -> Column:
    """A row's fields as text, in the format that a word's first letter names: json, array, csv; else with blanks."""
    names, letter = [f.name for f in table.fields], kind[:1].lower()
    if letter == "j":
        return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    if letter == "a":
        return text.as_json_array([F.col(c) for c in names])
    if letter == "c":
        return F.to_csv(F.struct(*names))
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in names])


def formatted(df: DataFrame, kind: str, table: Table, out: str = "value") -> DataFrame:
    """The table's fields in a format, beside the other columns; 'zip', 'struct' and 'bytes' are packed records."""
    if kind[:1].lower() in ("z", "s", "b"):
        return rows_to_bytes(df, table, out)
    names = [f.name for f in table.fields]
    return df.select(*[c for c in df.columns if c not in names], format_column(kind, table).alias(out))
