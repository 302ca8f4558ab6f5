"""Table definitions: ``{"fields": {name: [type, bytes, count, decimals, flags]}}`` -> Spark schema.

Types: I int, U uint, C text, F float, P price, T ms, W us, S second, M minute, D date.  Flags: I index,
O unique.  Left out: 4 bytes, count 1, 0 decimals (3 for a price).  The first T/S/M/D field is the time
field and the index; otherwise the last field flagged I is the index.  A field with an unknown type or a
size outside 1..65535 is skipped.  Raw (stored) time values stay integers until ``decoded``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = {"int": "I", "uint": "U", "char": "C", "float": "F", "price": "P", "wsec": "W", "msec": "T", "second": "S", "minute": "M", "date": "D"}
TIMES = "TSMD"
_INT = {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}
_UINT = {1: T.ShortType(), 2: T.IntegerType(), 4: T.LongType(), 8: T.DecimalType(20, 0)}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: int = 4
    count: int = 1
    decimals: int = 0
    flags: str = ""

    def element(self) -> T.DataType:
        if self.type == "I":
            return _INT[self.size]
        if self.type == "U":
            return _UINT[self.size]
        if self.type == "F":
            return T.DoubleType() if self.size == 8 else T.FloatType()
        if self.type == "P":
            return T.DecimalType(18, 6)
        return T.StringType() if self.type == "C" else T.LongType() if self.type in "WT" or self.size == 8 else T.IntegerType()

    def spark(self) -> T.StructField:
        kind = T.ArrayType(self.element()) if self.count > 1 else self.element()
        return T.StructField(self.name, kind, True, {"type": self.type, "size": self.size, "count": self.count, "decimals": self.decimals, "flags": self.flags})


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    time: str | None = None
    index: str | None = None
    unique: tuple[str, ...] = field(default=())

    @property
    def grain(self) -> str:
        """How rows are laid out: by year for dates, by date for finer times, not at all without time."""
        kind = next((f.type for f in self.fields if f.name == self.time), None)
        return "none" if kind is None else "year" if kind == "D" else "date"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def partition(self, index: Column | None = None) -> Column | None:
        """The partition value of an index value."""
        kind = next((f.type for f in self.fields if f.name == self.time), None)
        c = F.col(self.index) if index is None and self.index else index
        if kind is None:
            return None
        if kind == "D":
            return F.floor(c / 10000).cast("int")
        seconds = {"T": c / 1000, "S": c, "M": c * 60}[kind]
        return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyyMMdd").cast("int")


def parse(name: str, spec: dict | str) -> Table:
    spec = json.loads(spec) if isinstance(spec, str) else spec
    fields, marked, unique = [], None, []
    for label, row in spec["fields"].items():
        row = list(row) + [None] * (5 - len(row))
        kind = NAMES.get(str(row[0]).lower(), str(row[0]).upper())
        size, count = row[1] or 4, row[2] or 1
        allowed = {"I": _INT, "U": _UINT, "F": (4, 8), "P": (4, 8), "W": (8,), "T": (8,), "S": (4, 8), "M": (4,), "D": (4,), "C": range(1, 65536)}.get(kind)
        if allowed is None or size not in allowed or not 1 <= count <= 65535:
            continue
        decimals = row[3] or (3 if kind == "P" else 0)
        flags = str(row[4] or "").upper()
        fields.append(Field(label, kind, size, count, decimals, flags))
        marked = label if "I" in flags else marked
        if "O" in flags:
            unique.append(label)
    time = next((f.name for f in fields if f.type in TIMES), None)
    return Table(name, tuple(fields), time, time or marked, tuple(unique))


def _unary(f):
    """``f`` as a function of one argument, whatever defaults it has."""
    return lambda c: f(c)


def same_layout(a: Table, b: Table) -> bool:
    return a.fields == b.fields


def convert(df: DataFrame, source: Table, target: Table, fill: bool = True) -> DataFrame:
    """Rows of one definition as another's, by field name: missing fields are zero (null without ``fill``),
    extra ones go, arrays keep what both counts hold, numbers are cast, times change their unit, text only
    becomes text, and anything else is left zero."""
    from tidemark.functions.timeconv import convert_unit

    have = {f.name: f for f in source.fields}
    out = []
    for f in target.fields:
        zero = F.lit("") if f.type == "C" else F.lit(0)
        value, s = None, have.get(f.name)
        if s is not None:
            def one(c: Column, s: Field = s, f: Field = f) -> Column | None:
                if s.type in "IUFP" and f.type in "IUFP":
                    return c.cast(f.element())
                if s.type == "C" and f.type == "C":
                    return F.substring(c, 1, f.size)
                if s.type in TIMES + "W" and f.type in TIMES + "W":
                    return convert_unit(c, s.type, f.type).cast(f.element())
                return None

            c = F.col(s.name)
            if s.count > 1 and f.count > 1:
                value = F.slice(F.transform(c, _unary(one)), 1, min(s.count, f.count)) if one(F.lit(0)) is not None else None
            elif s.count > 1:
                value = one(c[0])
            elif f.count > 1:
                value = F.array(one(c)) if one(c) is not None else None
            else:
                value = one(c)
        if f.count > 1:
            empty = F.array_repeat((zero if fill else F.lit(None)).cast(f.element()), f.count)
            value = empty if value is None else F.slice(F.concat(F.coalesce(value, F.array().cast(T.ArrayType(f.element()))), empty), 1, f.count)
        elif value is None:
            value = (zero if fill else F.lit(None)).cast(f.element())
        elif fill:
            value = F.coalesce(value, zero.cast(f.element()))
        out.append(value.alias(f.name))
    kept = [F.col(c) for c in df.columns if c not in have]
    return df.select(*kept, *out)
