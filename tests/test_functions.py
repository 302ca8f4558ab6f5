import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric, strings, timeconv
from tidemark.operators import match, predicates, write
from tidemark.plans.schema import convert, parse, same_layout


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("source", "target", "value", "expected"),
    [("D", "T", 20210512, 1620863999999), ("D", "S", 20210512, 1620863999), ("D", "M", 20210512, 27014399), ("D", "Y", 20210512, 2021), ("M", "T", 27013000, 1620780059999), ("M", "S", 27013000, 1620780000), ("S", "T", 1620780000, 1620780000999), ("T", "S", 1620780059999, 1620780059), ("T", "M", 1620780059999, 27013000), ("T", "D", 1620780059999, 20210512)],
)
def test_time_units(spark, source, target, value, expected):
    assert _one(spark, timeconv.convert_unit(F.lit(value), source, target)) == expected


def test_workdays(spark):
    after = lambda d: str(_one(spark, timeconv.next_workday(F.lit(d).cast("date"))))
    assert [after("2024-01-05"), after("2024-01-06"), after("2024-01-07"), after("2024-01-08")] == ["2024-01-08", "2024-01-08", "2024-01-08", "2024-01-09"]


def test_price(spark):
    assert _one(spark, numeric.price(F.lit(128.561), 3)) == 128.561
    assert _one(spark, numeric.price_scale(F.lit(128.561), 3)) == 3
    assert _one(spark, numeric.price_scale(F.lit(0.0), 3)) == 0
    assert _one(spark, numeric.price_scale(F.lit(268435455.0), 2)) == 0
    assert _one(spark, numeric.price(F.lit(300000000.0), 2)) is None
    assert _one(spark, numeric.price(F.lit(300000000.0), 2, wide=True)) == 300000000.0


def test_overlap_touches(spark):
    f = lambda *x: _one(spark, numeric.overlaps(*[F.lit(float(v)) for v in x]))
    assert f(0, 1, 1, 2) and f(0, 2, 1, 3) and not f(0, 1, 1.5, 2)


def test_strings(spark):
    pairs = {"SH": "SSE", "SZ": "SZE"}
    assert _one(spark, strings.affix_swap(F.lit("SH600600"), pairs)) == "600600.SSE"
    assert _one(spark, strings.affix_swap(F.lit("600600.SSE"), pairs)) == "SH600600"
    assert _one(spark, strings.divide(F.lit("a.b.c"), ".")) == ["a", "b.c"]
    assert _one(spark, strings.replace_first(F.lit("abab"), "b", "x")) == "axab"
    assert _one(spark, strings.replace_first(F.lit("aaa"), "b", "x")) == ""
    assert _one(spark, strings.hash_bucket(F.lit("é1"), 7)) == sum(b % 7 for b in "é1".encode()) % 7
    assert _one(spark, strings.hash_bucket(F.lit(""), 7)) == 0


def test_matching(spark):
    k = spark.createDataFrame([("SH600600",), ("SZ300001",), ("SZ000001",)], "key string")
    keys = lambda c: {x.key for x in k.where(c).collect()}
    assert keys(match.in_list(F.col("key"), "sh600600,SZ000001")) == {"SH600600", "SZ000001"}
    assert keys(match.has_prefix(F.col("key"), "SH,SZ300")) == {"SH600600", "SZ300001"}
    assert match.is_multi("SH*") and not match.is_multi("SH600600.day")


def test_predicate_tree(spark):
    truth = dict(f1=True, f2=False, f3=False, f11=False, f12=True, f121=True, f122=False, f31=True)
    methods = predicates.Registry({k: (lambda a, v=v: F.lit(v)) for k, v in truth.items()})
    tree = {"$f1": {"$f11": {}, "$f12": {"$f121": {}, "$f122": {}}}, "$f2": {}, "$f3": [("$f31", {}), ("$f31", {}), ("$f31", {})]}
    assert _one(spark, methods.fold(tree)) is True
    assert _one(spark, methods.fold({"$f2": {}, "$f3": {"$f31": {}}})) is False
    assert not methods.register("f1", lambda a: F.lit(False))
    with pytest.raises(ValueError, match="no method"):
        methods.fold({"$other": {}})


def test_schema_conversion(spark):
    a = parse("a", {"fields": {"open": ["I", 4], "close": ["F", 8, 1, 3], "ask": ["I", 4, 5], "name": ["C", 4]}})
    b = parse("b", {"fields": {"open": ["U", 8], "close": ["F", 4, 1, 2], "ask": ["I", 4, 10], "name": ["C", 8], "agop": ["I", 4]}})
    rows = spark.createDataFrame([(1111, 18446744073709551615.0, [100, 101, 102, 103, 104], "123"), (2222, 4444.0, [200, 201, 202, 203, 204], "2345")], a.schema)
    x, y = convert(rows, a, b).orderBy("open").collect()
    assert (int(x.open), x.ask, x.name, x.agop) == (1111, [100, 101, 102, 103, 104, 0, 0, 0, 0, 0], "123", 0)
    assert (int(y.open), y.close, y.ask[:5]) == (2222, 4444.0, [200, 201, 202, 203, 204])
    assert not same_layout(a, b)


def test_index_choice():
    t = parse("t", {"fields": {"code": ["char", 16, 1, 0, "O"], "n": ["I", 4, 1, 0, "I"], "at": ["msec", 8], "bad": ["?", 4], "p": ["price", 4]}})
    assert (t.index, t.time, t.unique, t.grain) == ("at", "at", ("code",), "date")
    assert [f.name for f in t.fields] == ["code", "n", "at", "p"] and t.fields[-1].decimals == 3
    assert parse("u", {"fields": {"n": ["I", 4, 1, 0, "I"]}}).index == "n"


def test_upsert_is_idempotent_and_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2)], "key string, idx int, v string, seq long")
    new = spark.createDataFrame([("a", 2, "z", 3), ("a", 2, "w", 4), ("b", 1, None, 5)], old.schema)
    once = write.upsert(old, new, ["key", "idx"], "seq")
    twice = write.upsert(once, new, ["key", "idx"], "seq")
    expected = {("a", 1, "x", 1), ("a", 2, "w", 4), ("b", 1, None, 5)}
    assert {tuple(x) for x in once.collect()} == {tuple(x) for x in twice.collect()} == expected
    assert write.delete(once, F.col("v") == "w").count() == 2


def test_partitions_are_rewritten_and_compacted(spark, tmp_path):
    t = parse("t", {"fields": {"time": ["T", 8, 1, 0, "I"], "value": ["I", 4]}})
    times = [1620793979000, 1620793979500, 1620793979999, 1620793985999, 1620794000999, 1620795500999, 1620795510999, 1620905510999, 1621315510999, 1511925510999]
    rows = spark.createDataFrame([("k", x, i) for i, x in enumerate(times, 1)], "key string, time long, value int").withColumn("date", t.partition())
    path = str(tmp_path / "table")
    write.write_table(rows, path, "date", "key", "time")
    assert spark.read.parquet(path).select("date").distinct().count() == 4
    write.rewrite_partitions(spark, path, "date", rows.where("value = 9").select("date"), lambda df: df.where("value <> 9").unionByName(df.withColumn("value", F.lit(90))))
    assert sorted(x.value for x in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 90]
    write.compact(spark, path, "date")
    assert len(list((tmp_path / "table").glob("date=20210512/*.parquet"))) == 1
    from tidemark.plans.partitions import read_range

    found = read_range(spark, path, "time", 1620793979500, 1620794000999, "date")
    assert sorted(x.value for x in found.collect()) == [2, 3, 4, 5]
    assert "PartitionFilters: [isnotnull(date" in found._jdf.queryExecution().toString()


def test_embedded_times(spark):
    df = spark.createDataFrame([("a_20240229.csv",), ("x20240229T1", ), ("no 123",), ("20240229103059123",), ("20241399",)], "s string")
    got = [r.t for r in df.select(F.date_format(timeconv.embedded_time(F.col("s")), "yyyy-MM-dd HH:mm:ss.SSS").alias("t")).collect()]
    assert got == ["2024-02-29 00:00:00.000", "2024-02-29 00:00:00.000", None, "2024-02-29 10:30:59.123", None]
