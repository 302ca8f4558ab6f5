"""Stores, logs, streams in batches, picking trees, binary rows, schedules."""

import struct
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import match, predicates, write
from tidemark.plans import partitions
from tidemark.plans.engine import Engine
from tidemark.plans.schema import parse
from tidemark.sources import binary
from tidemark.streaming import schedule, stream


def _rows(spark, rows):
    return spark.createDataFrame(rows, "key string, day int, year int, v int")


def test_deleted_partitions_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = _rows(spark, [("a", 20200101, 2020, 1), ("a", 20210101, 2021, 2), ("b", 20220101, 2022, 3), ("a", 20220102, 2022, 4)])
    write.write_table(rows, path, "year", "key", "day")
    gone = F.col("day").between(20210000, 20220101)
    write.rewrite_partitions(spark, path, "year", rows.where(gone), lambda df: write.delete(df, gone))
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 4]
    write.rewrite_partitions(spark, path, "year", rows.where("year = 2022"), lambda df: write.delete(df, F.col("key") == "a"))
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1]
    assert not [x for x in tmp_path.iterdir() if "staging" in x.name]


def test_journal_survives_its_writer(spark, tmp_path):
    log = write.Journal(spark, f"file://{tmp_path}/log")
    assert log.recover() is None
    numbers = [log.append(_rows(spark, [("a", 1, 1, i)])) for i in range(3)]
    assert numbers == [1, 2, 3]
    log.applied(1)
    again = write.Journal(spark, f"file://{tmp_path}/log")
    assert sorted((r.entry, r.v) for r in again.recover().collect()) == [(2, 1), (3, 2)]
    again.applied(3)
    assert again.recover() is None and again.append(_rows(spark, [("a", 1, 1, 9)])) == 4


def test_day_store_has_one_writer(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = write.DayStore(spark, path, "key", "v"), write.DayStore(spark, path, "key", "v")
    with pytest.raises(RuntimeError, match="no day"):
        one.set(_rows(spark, []))
    one.start(20231231)
    with pytest.raises(RuntimeError, match="has a writer"):
        two.start(20240101)
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1)], "key string, v int")
    one.set(rows)
    one.set(rows.limit(1))
    assert one.running().count() == 4  # repeats stay
    one.stop()
    two.start(20240101)
    two.set(rows)
    two.stop()
    one.merge(2023)
    assert one.read(20230101, 20231231).count() == 4 and one.read(20230101, 20241231).count() == 7


def test_engine_saves(spark, tmp_path):
    e = Engine(spark)
    e.create("t", {"fields": {"date": ["D", 4], "v": ["F", 8]}})
    e.set("t", spark.createDataFrame([("a", 20200101, 1.0, 1), ("b", 20210101, 2.0, 2)], "key string, date int, v double, seq long"))
    e.delete("t", "b")
    e.save("t", f"file://{tmp_path}/t")
    assert [tuple(r) for r in e.frames["t"].collect()] == [("a", 20200101, 1.0, 1)]
    assert (tmp_path / "t" / "year=2020").is_dir() and not (tmp_path / "t" / "year=2021").exists()


def test_batches_replace_themselves(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "k string, v int"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    count = lambda: stream.drain(stream.source(spark, f"{root}/in", schema, 1).groupBy("k").agg(F.count("*").alias("n")), f"{root}/c", "complete")
    put(("a", 1), ("b", 1))
    assert {r.k: r.n for r in count().collect()} == {"a": 1, "b": 1}
    put(("a", 2))
    put(("a", 3))
    assert {r.k: r.n for r in count().collect()} == {"a": 3, "b": 1}
    whole = stream.drain(stream.source(spark, f"{root}/in", schema, 1), f"{root}/d")
    assert whole.count() == 4
    # the last batch is run again, as after a loss between its output and its commit
    newest = max((tmp_path / "d" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert stream.drain(stream.source(spark, f"{root}/in", schema, 1), f"{root}/d").count() == 4


def test_subscriptions(spark):
    rows = spark.createDataFrame([("a1",), ("b2",)], "key string")
    s = stream.Subscriptions()
    assert s.subscribe("x", "a", head=True) and not s.subscribe("x", "a", head=True)
    assert [r.key for r in s.apply(rows, "x", "key").collect()] == ["a1"]
    assert s.subscribe("x", "b2") and [r.key for r in s.apply(rows, "x", "key").collect()] == ["b2"]
    assert s.unsubscribe("x") and not s.unsubscribe("x") and s.apply(rows, "x", "key").count() == 0


def test_fan_out(spark):
    rows = spark.createDataFrame([("SH600", 1), ("sz1", 2), ("s", 3), (None, 4)], "key string, v int")
    told = spark.createDataFrame([("p", "sh"), ("q", "*"), ("r", "SH6"), ("t", "sz1x"), ("u", None)], "who string, pattern string")
    out = match.fan_out(rows, "key", told)
    assert sorted((r.who, r.v) for r in out.collect()) == [("p", 1), ("q", 1), ("q", 2), ("q", 3), ("r", 1)]
    assert match.fan_out(rows, "key", told.limit(0)).count() == 0
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_fan_out_does_not_gather_rows_by_prefix(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("v"), F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("key")).write.parquet(f"file://{tmp_path}/rows")
    rows, told = spark.read.parquet(f"file://{tmp_path}/rows"), spark.createDataFrame([("p", "*"), ("q", "A"), ("r", "a2"), ("s", "b")], "who string, pattern string")
    few = match.fan_out(rows, "key", told)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning" not in plan  # rows stay where they are
    many = match.fan_out(rows, "key", told, few=2)
    assert few.columns == many.columns and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert few.groupBy("who").count().orderBy("who").collect() == [("p", 4000), ("q", 4000), ("r", 1333)]
    shares = [line for line in many._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert shares and all("__s" in line for line in shares)


def test_picking_tree(spark):
    df = spark.range(20).select(F.col("id").cast("int").alias("i"))
    methods = {"least": lambda d, a: d.orderBy("i").limit(a["n"]), "most": lambda d, a: d.orderBy(F.desc("i")).limit(a["n"]), "even": lambda d, a: d.where("i % 2 = 0")}
    pick = lambda tree: sorted(r.i for r in predicates.select(df, tree, methods, ["i"]).collect())
    assert pick({"$least": {"n": 10, "$most": {"n": 2}}}) == [8, 9]  # the child picks from its parent's rows
    assert pick({"$least": {"n": 4, "$even": {}, "$most": {"n": 1}}, "$most": {"n": 1}}) == [0, 2, 3, 19]
    assert len(pick({})) == 20
    with pytest.raises(ValueError, match="no method"):
        pick({"$other": {}})


def test_binary_rows(spark):
    t = parse("t", {"fields": {"a": ["I", 2], "b": ["F", 4, 2], "c": ["C", 3], "p": ["P", 8]}})
    rows = spark.createDataFrame([(1, 7, [0.5, 1.5], "xyz", 1.25), (2, -1, [2.0, 0.0], "é", 0.0)], "id int, a smallint, b array<float>, c string, p double")
    packed = binary.rows_to_bytes(rows, t)
    assert [len(r.bytes) for r in packed.collect()] == [21, 21]
    back = sorted(binary.rows_from_bytes(packed, "bytes", t).collect())
    assert [(r.id, r.a, r.b, r.c, float(r.p)) for r in back] == [(1, 7, [0.5, 1.5], "xyz", 1.25), (2, -1, [2.0, 0.0], "é", 0.0)]
    both = packed.groupBy().agg(F.aggregate(F.array_sort(F.collect_list("bytes")), F.lit(b""), lambda x, y: F.concat(x, y)).alias("bytes"))
    assert binary.rows_from_bytes(both, "bytes", t).count() == 2
    assert binary.rows_from_bytes(both.select(F.concat("bytes", F.lit(b"x")).alias("bytes")), "bytes", t).count() == 0
    assert binary.formatted(rows, "csv", parse("u", {"fields": {"a": ["I", 2], "c": ["C", 3]}})).where("id = 1").first().value == "7,xyz"


def test_binary_rows_are_worked_on_together(spark, monkeypatch):
    t = parse("t", {"fields": {"a": ["I", 4], "c": ["C", 3], "x": ["F", 8, 2]}})
    told = [(i, ("x", "yé", "four", "", "é" * 2, "a\0b")[i % 6], [i / 2, -1.0]) for i in range(3000)]
    rows = spark.createDataFrame(told, "a int, c string, x array<double>").coalesce(1)
    raw = [bytes(r.bytes) for r in binary.rows_to_bytes(rows, t).collect()]
    assert raw == [struct.pack("<i3sdd", a, c.encode()[:3], *x) for a, c, x in told] and len(raw[0]) == 23
    held = [raw[0], None, b"", raw[1] + raw[2], raw[3][:-1], *raw[3:], raw[0][:4] + b"\xff\xc3z" + raw[0][7:]]  # two aren't whole records, one isn't UTF-8
    text = lambda c: c.encode()[:3].decode("utf-8", "ignore")
    want = [(a, text(c), x) for a, c, x in told] + [(0, "z", [0.0, -1.0])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(held)], "n long, bytes binary").coalesce(1)
    back = sorted(binary.rows_from_bytes(df, "bytes", t).collect(), key=lambda r: r.n)
    assert [(r.a, r.c, r.x) for r in back] == want and [r.n for r in back] == [0, 3, 3, *range(5, len(held))]
    monkeypatch.setattr(binary, "SLICE", 1 << 14, raising=False)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array(held, pa.binary())], names=["n", "bytes"])
    out = list(binary.rows_from_bytes(df, "bytes", t)(iter([batch])))
    assert [(r["a"], r["c"], r["x"]) for b in out for r in b.to_pylist()] == want and 1 < len(out) < 12  # not a batch for each value


def test_days_and_segments(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([(i, datetime(2024, 1, 5 + i // 4, 6 * (i % 4))) for i in range(16)], "i int, t timestamp")  # Friday to Monday
    partitions.write_segments(rows, path, "t")
    assert sorted(r.i for r in partitions.read_days(spark, path, 20240105, 20240108, weekends=False).collect()) == [0, 1, 2, 3, 12, 13, 14, 15]
    assert sorted(r.i for r in partitions.read_days(spark, path, 20240106, 20240107, segments=(1, 2)).collect()) == [5, 6, 9, 10]


def test_schedules():
    at = lambda h, m=0, s=0: datetime(2024, 1, 1, h, m, s)
    assert schedule.Schedule("once").due(at(1)) and not schedule.Schedule("once").due(at(2), at(1))
    assert schedule.Schedule("notice").due(at(1), None, 2) and not schedule.Schedule("notice").due(at(1))
    night = schedule.Schedule("gap", 1000, 2200, 600)
    assert night.due(at(23)) and night.due(at(5)) and not night.due(at(12)) and not night.due(at(23, 0, 0), at(23, 0, 0)) and night.due(at(23, 0, 1), at(23, 0, 0))
    assert schedule.Schedule("plan", minutes=(930,)).due(at(9, 30), at(9, 29)) and not schedule.Schedule("plan", minutes=(930,)).due(at(9, 30, 40), at(9, 30))
    assert [m[0] for m in schedule.handshake(1, "*", "*", iter([1, 2]))] == ["start", "keys", "tables", "wait", "rows", "rows", "stop"]
