"""Range and where rules, against the rule written out and against fixed cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import lookup, theta

DATES = [20191010, 20191110, 20191210, 20200110, 20200210, 20200310, 20200310, 20210315, 20210320, 20210320, 20210410, 20210410]
TIMES = [1630087372600, 1630087572600, 1630087672600, 1630187272600, 1630187372600, 1630187372600, 1630187572600, 1630287372600, 1630287372600, 1630287372600, 1630288372600, 1630288372600]


def _table(spark, values):
    return spark.createDataFrame([("a", v, i + 1) for i, v in enumerate(values)], "key string, idx long, seq long")


def _seqs(df):
    return sorted(x.seq for x in df.collect())


@pytest.fixture(scope="module")
def dates(spark):
    return _table(spark, DATES).cache()


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ((0, 0, False), []), ((0, -1, False), range(1, 13)), ((20191009, 0, False), []), ((20200310, 0, False), [6, 7]), ((20200310, 20210320, False), range(6, 11)), ((20200311, 20210411, False), range(8, 13)),
        ((20181010, 20200310, False), range(1, 8)), ((20200311, 20200311, False), []), ((20200311, 20200311, True), [7]), ((20210411, 20210411, True), [12]), ((20200311, -1, False), range(8, 13)), ((20200311, -1, True), range(7, 13)),
        ((20210316, -1, False), range(9, 13)), ((-1, 0, False), [11, 12]), ((-3, -1, False), range(9, 13)), ((-99, -1, False), range(1, 13)),
    ],
)
def test_range_on_dates(dates, args, expected):
    start, stop, prev = args
    assert _seqs(lookup.range_rows(dates, ["key"], "idx", start, stop, prev, ["idx", "seq"])) == list(expected)


@pytest.mark.parametrize(("start", "offset", "expected"), [(20210315, 0, [8]), (20200310, 0, [6, 7]), (20200311, 0, []), (20210411, -1, [12]), (20200310, -1, [5]), (20200310, -2, [4]), (20191010, -1, []), (20200310, 1, [])])
def test_where_on_dates(dates, start, offset, expected):
    assert _seqs(lookup.where_rows(dates, ["key"], "idx", start, offset, ["idx", "seq"])) == expected


def test_range_on_milliseconds(spark):
    t = _table(spark, TIMES)
    get = lambda a, b, p=False: _seqs(lookup.range_rows(t, ["key"], "idx", a, b, p, ["idx", "seq"]))
    assert get(1630187372600, 0) == [5, 6]
    assert get(1630187272600, 1630287372600) == list(range(4, 11))
    assert get(1630187472600, -1) == list(range(7, 13))
    assert get(1630187472600, -1, True) == list(range(6, 13))


def _rule(values, start, stop, prev):
    k = sorted(values)
    if not k:
        return []
    lo = k[max(0, len(k) + start)] if start < 0 else start
    hi = k[-1] if stop < 0 else lo if stop == 0 else stop
    found = [i for i, v in enumerate(k) if lo <= v <= hi]
    if prev and lo not in k:
        before = [i for i, v in enumerate(k) if v < lo]
        if before and k[before[-1]] <= hi:
            found = [before[-1], *found]
    return [i + 1 for i in found]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(1, 9), max_size=8), start=st.integers(-3, 10), stop=st.integers(-1, 10), prev=st.booleans())
def test_range_is_the_rule(spark, values, start, stop, prev):
    t = _table(spark, sorted(values))
    assert _seqs(lookup.range_rows(t, ["key"], "idx", start, stop, prev, ["idx", "seq"])) == _rule(values, start, stop, prev)


def test_positions_and_projection(spark):
    t = spark.createDataFrame([(i, [i, i + 1]) for i in range(6)], "pos int, a array<int>")
    assert [x.pos for x in lookup.positional(t, ["pos"], -2, 5).collect()] == [4, 5]
    assert [x.pos for x in lookup.positional(t, ["pos"], 1, 2).collect()] == [1, 2]
    assert lookup.project(t, "a.1,pos").columns == ["a_1", "pos"]
    with pytest.raises(ValueError, match="unknown field"):
        lookup.project(t, "nothing")


def test_grid_join_deals_a_key_over_tasks(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 50 > 1, 1).when(F.col("id") % 50 > 0, F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).alias("x"))
    right = spark.range(400).select(F.col("id").alias("b"), F.when(F.col("id") % 20 > 1, 1).when(F.col("id") % 20 > 0, F.col("id") % 11).alias("m"), (F.col("id") * 53 % 97).alias("y"))
    repeated = right.unionAll(right.where("b < 60"))
    met = theta.grid_join(left, repeated, "k", "m", F.col("x") > F.col("y"), block=(100, 40))
    plain = left.join(repeated, (F.col("k") == F.col("m")) & (F.col("x") > F.col("y")))
    assert met.columns == plain.columns and sorted(map(tuple, met.collect())) == sorted(map(tuple, plain.collect()))
    of_task = [r["count"] for r in met.where("k = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(of_task) > 100 and max(of_task) < sum(of_task) / 20  # an equal hash would put the key into one task
    assert theta.grid_join(left, right.limit(0), "k", "m", F.col("x") > F.col("y")).count() == 0
