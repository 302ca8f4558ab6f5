"""dBase III tables as a Spark data source: ``spark.read.format("dbf").load(path)``, in row ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

ROWS = 100_000


def header(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(rows, bytes of the header, bytes of a row, fields as name, type, length, decimals)."""
    rows, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= len(data) and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0", 1)[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    return rows, head, size, fields


def _value(kind: str, decimals: int, raw: bytes):
    text = raw.decode("utf-8", "replace").strip()
    if kind in "NF":
        try:
            return float(text) if decimals or kind == "F" else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _head(self) -> tuple:
        with open(self.options["path"], "rb") as f:
            start = f.read(32)
            return header(start + f.read(max(0, struct.unpack_from("<H", start, 8)[0] - 32)))

    def schema(self) -> StructType:
        kinds = {"N": LongType(), "F": DoubleType(), "L": BooleanType()}
        return StructType([StructField(n, DoubleType() if k == "N" and d else kinds.get(k, StringType())) for n, k, _, d in self._head()[3]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(self.options["path"], self._head())


class DbfReader(DataSourceReader):
    def __init__(self, path: str, head: tuple):
        self.path, self.head = path, head

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + ROWS, self.head[0]))) for a in range(0, max(self.head[0], 1), ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        (a, b), (_, head, size, fields) = partition.value, self.head
        with open(self.path, "rb") as f:
            f.seek(head + a * size)
            for _ in range(a, b):
                row = f.read(size)
                if len(row) < size:
                    return
                if row[:1] == b"*":
                    continue
                at, out = 1, []
                for _, kind, n, d in fields:
                    out.append(_value(kind, d, row[at : at + n]))
                    at += n
                yield tuple(out)
