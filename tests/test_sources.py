import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.engine import Engine
from tidemark.sources import text
from tidemark.sources.dbf import DbfSource

DAY = {"fields": {"time": ["D", 4, 1, 0, "IO"], "price": ["F", 8]}}


def test_relaxed_configuration(tmp_path):
    (tmp_path / "more.conf").write_text("extra : 5\n")
    (tmp_path / "a.conf").write_text("# a comment\nname : value one : [1, 2.5, \"x # y\"]\n nested : { a : true  b : { c : null } }\ninclude more.conf\n")
    assert text.read_conf(str(tmp_path / "a.conf")) == [{"name": "value", "one": [1, 2.5, "x # y"], "nested": {"a": True, "b": {"c": None}}, "extra": 5}]
    assert text.parse_conf('{"a{b": 1}\n{c: 2}') == [{"a{b": 1}, {"c": 2}]
    assert text.deep_merge({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": 3}) == {"a": {"b": 1, "d": 2}, "c": 3}


def test_ini(tmp_path):
    (tmp_path / "a.ini").write_text("[One]\nKey=1\n[two]\nx = y\n")
    assert text.read_ini(str(tmp_path / "a.ini")) == {"One": {"Key": "1"}, "two": {"x": "y"}}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code|name|\nA1|"q|\n')
    row = text.read_csv(spark, str(tmp_path / "a.csv"), "|").first()
    assert row.code == "A1" and row.name == '"q'
    text.write_csv(spark.createDataFrame([("a", 1.005)], "k string, v double"), str(tmp_path / "out"), {"v": 1})
    assert text.read_csv(spark, str(tmp_path / "out")).first().v == "1.0"


def test_json_rows(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("ask", T.ArrayType(T.IntegerType()), True, {"count": 2})])
    df = spark.createDataFrame([('{"a": 1, "ask0": 7, "ask1": 8}',), ('{"b": "x", "ask": [1, 2]}',), (None,)], "j string")
    assert [tuple(x) for x in text.rows_from_objects(df, "j", schema).collect()] == [(1, "", [7, 8]), (0, "x", [1, 2]), (0, "", [0, 0])]
    two = T.StructType(schema.fields[:2])
    arrays = spark.createDataFrame([('[1, "x"]',), ('[[2, "y"], [3], [4, "z"]]',)], "j string")
    assert [tuple(x) for x in text.rows_from_arrays(arrays, "j", two).collect()] == [(1, "x"), (2, "y"), (4, "z")]


def test_dbf(spark, tmp_path):
    fields = [(b"CODE", b"C", 6, 0), (b"PRICE", b"N", 8, 2), (b"N", b"N", 5, 0), (b"OK", b"L", 1, 0)]
    rows = [b" ABC      12.50    7T", b"*GONE      1.00    1F", b" D                  ?"]
    head = 32 + 32 * len(fields) + 1
    data = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(rows), head, 21) + b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([s, d]) + b"\0" * 14 for n, k, s, d in fields) + b"\r" + b"".join(rows)
    (tmp_path / "t.dbf").write_bytes(data)
    spark.dataSource.register(DbfSource)
    assert [tuple(x) for x in spark.read.format("dbf").load(str(tmp_path / "t.dbf")).collect()] == [("ABC", 12.5, 7, True), ("D", None, None, None)]


def test_engine(spark):
    e = Engine(spark)
    assert e.create("day", DAY) and not e.create("day", DAY)
    rows = lambda *r: spark.createDataFrame(list(r), e.frames["day"].schema)
    e.set("day", rows(("SH1", 20240101, 1.0, 1), ("SH1", 20240102, 2.0, 2), ("SZ1", 20240101, 3.0, 3)))
    e.set("day", rows(("SH1", 20240102, 5.0, 4)))
    assert [(x.key, x.price) for x in e.get("day").orderBy("key").collect()] == [("SH1", 5.0), ("SZ1", 3.0)]
    assert e.get("day", "SH", range=(20240101, -1), head=True, fields="price").count() == 2
    assert e.get("day", "sh1", where=(20240102, -1)).first().price == 1.0
    assert {x.key for x in e.keys("day").collect()} == {"SH1", "SZ1"}
    e.delete("day", "SZ1")
    assert e.gets(["day"])["day"].count() == 1
    assert [x.time for x in e.replay(["day"], {"day": "D"}).collect()] == [20240101, 20240102]
    e.put("x", 1)
    assert e.value("x") == 1 and e.value("y") is None
    assert e.show().count() == 2
    e.drop("day")
    with pytest.raises(KeyError):
        e.get("day")


def test_keyed_document(spark):
    df = spark.createDataFrame([("k", 2, 'q"'), ("k", 1, None)], "key string, n int, s string")
    assert text.keyed_document(df, "key", ["n", "s"], ["n"]).first().document == '{"fields":{"n":0,"s":1},"k":[[1,null],[2,"q\\""]]}'
    assert df.select(text.csv_line([F.col("n"), F.col("s")], [1, None]).alias("x")).first().x == '2.0,q"'


def test_merge_json(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":[1]}}', '{"a":{"c":[2],"d":null}}'), (None, '{"x":1}'), ('{"x":1}', "broken"), ("[1]", None)], "a string, b string")
    assert [r.m for r in df.select(text.merge_json("a", "b").alias("m")).collect()] == ['{"a":{"b":1,"c":[2],"d":null}}', '{"x":1}', '{"x":1}', None]
