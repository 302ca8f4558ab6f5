"""Text sources and sinks: CSV, JSON rows, relaxed configuration files, INI."""

from __future__ import annotations

import configparser
import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None, quoted: bool = False) -> DataFrame:
    """Columns are named by the first line; without ``quoted`` a quote mark is an ordinary character."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", '"' if quoted else "")
    return (r.schema(schema) if schema else r).csv(path)


def stream_csv(spark: SparkSession, folder: str, schema: str, sep: str = ",", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("sep", sep).option("header", True).option("quote", "").option("maxFilesPerTrigger", files).csv(folder)


def csv_line(columns: Sequence[Column], decimals: Sequence[int | None], sep: str = ",") -> Column:
    """A row as text, numbers with fixed decimals; nulls are empty."""
    parts = [F.coalesce((c if d is None else F.format_string(f"%.{d}f", c.cast("double"))).cast("string"), F.lit("")) for c, d in zip(columns, decimals, strict=True)]
    return F.concat_ws(sep, *parts)


def write_csv(df: DataFrame, path: str, decimals: dict[str, int]) -> None:
    cols = [F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")).alias(c) if c in decimals else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def rows_from_objects(df: DataFrame, column: str, schema: T.StructType, fill: bool = True) -> DataFrame:
    """JSON objects -> rows; array fields come as an array or as name0, name1, ...; missing is zero."""
    wide = T.StructType([x for f in schema for x in ([T.StructField(f.name, f.dataType)] + ([T.StructField(f"{f.name}{i}", f.dataType.elementType) for i in range((f.metadata or {}).get("count", 0))] if isinstance(f.dataType, T.ArrayType) else []))])
    parsed = df.select(*[c for c in df.columns if c != column], F.from_json(column, wide).alias("__j"))
    out = []
    for f in schema:
        c = F.col(f"__j.{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            n = (f.metadata or {}).get("count", 0)
            c = F.coalesce(c, F.array(*[F.coalesce(F.col(f"__j.{f.name}{i}"), F.lit(0).cast(f.dataType.elementType)) for i in range(n)]))
        elif fill:
            c = F.coalesce(c, (F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0)).cast(f.dataType))
        out.append(c.alias(f.name))
    return parsed.select(*[c for c in df.columns if c != column], *out)


def rows_from_arrays(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON arrays, [v, ...] or [[v, ...], ...] -> rows; rows of another width are left out."""
    text = F.when(F.col(column).rlike(r"^\s*\[\s*\["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    rows = df.select(*[c for c in df.columns if c != column], F.explode(F.from_json(text, "array<array<string>>")).alias("__r"))
    rows = rows.where(F.size("__r") == len(schema))
    return rows.select(*[c for c in df.columns if c != column], *[F.col("__r")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def as_json_array(columns: Sequence[Column]) -> Column:
    """A row as the text of a JSON array."""
    parts = []
    for c in columns:
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.regexp_extract(text, r"(?s)^\{\"v\":(.*)\}$", 1))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def keyed_document(df: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One JSON text per key: the fields' places and the rows as arrays, always nested."""
    row = as_json_array([F.col(f) for f in fields])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("__r")))), lambda x: x["__r"])
    head = json.dumps({f: i for i, f in enumerate(fields)}, separators=(",", ":"))
    return df.groupBy(key).agg(F.concat(F.lit('{"fields":' + head + ',"'), F.col(key).cast("string"), F.lit('":['), F.concat_ws(",", rows), F.lit("]}")).alias("document"))


def json_get(text: Column, path: str, default=None, kind: str = "string") -> Column:
    """A value by dotted path; numbers in the path are array places."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    found = F.get_json_object(text, "$" + steps).cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def deep_merge(a: dict, b: dict) -> dict:
    """New keys are added, objects merged, other values replaced."""
    return a | {k: deep_merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def merge_json(a: str | Column, b: str | Column) -> Column:
    """Two JSON texts merged by ``deep_merge``, as text; where one is null or no object, the other.  Spark has no
    such function: rows go to Python in Arrow batches."""
    import pandas as pd

    def one(x: str | None, y: str | None) -> str | None:
        try:
            left = json.loads(x) if x else None
        except ValueError:
            left = None
        try:
            right = json.loads(y) if y else None
        except ValueError:
            right = None
        if not isinstance(left, dict) or not isinstance(right, dict):
            return y if isinstance(right, dict) else x if isinstance(left, dict) else None
        return json.dumps(deep_merge(left, right), separators=(",", ":"), ensure_ascii=False)

    def merged(x, y):
        return pd.Series([one(i, j) for i, j in zip(x, y, strict=True)], dtype=object)

    merged.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(merged, "string")(a, b)


_MARK = re.compile(r'\s+|#[^\n]*|"((?:[^"\\]|\\.)*)"|([{}\[\]:,])|([^\s{}\[\]:,#"]+)')


def parse_conf(text: str, folder: str | None = None) -> list:
    """Relaxed JSON: '#' comments, unquoted text, optional commas, ``include file``, several documents."""
    found = [(m[1] is not None, m[1] if m[1] is not None else m[2] or m[3]) for m in _MARK.finditer(text) if m[1] is not None or m[2] or m[3]]
    at = 0

    def scalar(quoted: bool, s: str):
        if quoted:
            return json.loads(f'"{s}"')
        low = s.lower()
        if low in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[low]
        return int(s) if re.fullmatch(r"[-+]?\d+", s) else float(s) if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", s) else s

    def value():
        nonlocal at
        quoted, s = found[at]
        at += 1
        if quoted or s not in "{[":
            return scalar(quoted, s)
        return members("}") if s == "{" else items()

    def items() -> list:
        nonlocal at
        out = []
        while found[at] != (False, "]"):
            if found[at] == (False, ","):
                at += 1
            else:
                out.append(value())
        at += 1
        return out

    def members(end: str | None) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(found) and found[at] != (False, end):
            if found[at] == (False, ","):
                at += 1
                continue
            if found[at] == (False, "include"):
                out = deep_merge(out, read_conf(str(Path(folder or ".") / found[at + 1][1]))[0])
                at += 2
                continue
            name = found[at][1]
            if found[at + 1] != (False, ":"):
                raise ValueError(f"':' expected after {name!r}")
            at += 2
            out[name] = value()
        at += end is not None
        return out

    documents = []
    while at < len(found):
        if found[at] in ((False, "{"), (False, "[")):
            documents.append(value())
        elif found[at] == (False, ","):
            at += 1
        else:
            documents.append(members(None))
    return documents


def read_conf(path: str) -> list:
    p = Path(path)
    return parse_conf(p.read_text(encoding="utf-8"), str(p.parent))


def read_ini(path: str) -> dict[str, dict[str, str]]:
    c = configparser.ConfigParser(interpolation=None, strict=False)
    c.optionxform = str
    c.read(path, encoding="utf-8")
    return {s: dict(c.items(s)) for s in c.sections()}
