import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, buckets, iterative, rolling, series

DRIFT = [8.5, 9.1, 9.6, 10.0, 10.3, 10.5, 10.6, 11.3, 11.2, 11.0, 10.7, 10.3, 9.8]
I2 = [8.1, 6.5, 3.1, 0.1, 1.3, 2.1, 3.5, 4.9, 5.1, 6.1, 7.1, 8.9]


def _series(spark, values):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, t int, v double")


@pytest.mark.parametrize(("values", "expected"), [(range(2, 17, 2), 0.875), (range(3, 11), 0.7), (range(1001, 1009), 0.00694), ([1001, 1010, 1030, 1050, 1060, 1075, 1090, 1100], 0.09379), ([1, 2], 0.0), ([0, 0, 0], 0.0)])
def test_slope_rate(spark, values, expected):
    assert series.slope_rate(_series(spark, values), ["k"], ["t"], "v").first().slope_rate == pytest.approx(expected, abs=6e-6)


@pytest.mark.parametrize(("n", "expected"), [(5, 0.026315789), (8, 0.055346961), (13, -0.066209499)])
def test_drift(spark, n, expected):
    row = series.cubic_drift(_series(spark, DRIFT[:n]), ["k"], ["t"], "v").first()
    y = np.array(DRIFT[:n])
    fit = np.polynomial.Polynomial.fit(np.arange(n, dtype=float), y / y.mean(), 3)
    drift, acceleration = fit.deriv(1)(n - 1), fit.deriv(2)(n - 1)
    assert row.drift == pytest.approx(expected, abs=1e-9) and drift == pytest.approx(expected, abs=1e-9)
    assert row.acceleration == pytest.approx(acceleration, abs=1e-9)


def test_mean_density(spark):
    x = _series(spark, [0.697, 0.774, 0.634, 0.608, 0.556, 0.403, 0.481, 0.437])
    m = series.mean_std(x, ["k"], "v").withColumn("d", series.density(F.lit(0.697), F.col("mean_v"), F.col("std_v"))).first()
    assert (round(m.mean_v, 5), round(m.std_v, 5), round(m.d, 5)) == (0.57375, 0.12921, 1.95901)


def test_lagged_correlation(spark):
    rows = spark.createDataFrame([("k", i + 1, float(i + 1), v) for i, v in enumerate(I2)], "k string, pos int, a double, b double")
    assert rows.select(series.correlation("a", "b").alias("c")).first().c == pytest.approx(0.3306, abs=5e-5)
    best = series.lagged(rows, ["k"], "pos", "a", "b", 5).first()
    assert best.lag == 3 and best.value == pytest.approx(0.9934, abs=5e-5)


@pytest.mark.parametrize(("values", "expected"), [(range(2, 17, 2), 13.445783133), (range(1, 11), 8.454545455)])
def test_fibonacci(spark, values, expected):
    assert series.fibonacci_average(_series(spark, values), ["k"], ["t"], "v").first().fib_avg == pytest.approx(expected, abs=1e-9)


def test_nearest_difference_and_trend(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert f(series.nearest_difference(a(0.21, 0.20, 0.15, 0.18, 0.1, -0.1))) == pytest.approx(-0.28)
    assert f(series.nearest_difference(a(1))) == 0
    assert [f(series.trend(a(3, 2, 1))), f(series.trend(a(1, 2, 3))), f(series.trend(a(1, 2, 2))), f(series.trend(a(1)))] == [1, -1, 0, 0]
    assert f(series.warm_mean(a(4, 0, 14))) == pytest.approx(4 * 0.9 + 14 * 0.1)
    assert iterative.speed(np.array([-5, -10, -14, -12, -11, 0, 0])) == -2


def test_combinations(spark):
    c = series.combinations(spark, [[1, 2, 3]] * 4).collect()
    assert len(c) == 81 and tuple(c[0]) == (1, 1, 1, 1) and tuple(c[1]) == (1, 1, 1, 2) and tuple(c[-1]) == (3, 3, 3, 3)
    levels = [series.ratio_levels(x, 5, 0.1, 10.0) for x in (5.0, 3.0, 9.0)]
    assert series.combinations(spark, levels).count() == 1331


def test_rolling(spark):
    last = rolling.rolling(_series(spark, [2, 1, 3, 4, 5, 5, 6, 7, 5, 8]), ["k"], ["t"], "v", 4).orderBy(F.desc("t")).first()
    assert (last.roll_sum, last.roll_avg, last.roll_min, last.roll_max) == (26, 6.5, 5, 8)
    assert rolling.rolling(_series(spark, [5, 1, 3]), ["k"], ["t"], "v", 2).orderBy(F.desc("t")).first().roll_max == 3
    norm = [x.norm for x in rolling.minmax_normalise(_series(spark, [1, 2, 3]), ["k"], "v").orderBy("t").collect()]
    assert norm == pytest.approx([0.001, 0.5, 0.999])


def test_feature_fill(spark):
    rows = spark.createDataFrame([("k", t) for t in (10, 20, 30, 40, 50)], "k string, time int")
    push = lambda *p: spark.createDataFrame([("k", t, v) for t, v in p], "k string, time int, v double")
    fill = lambda p, limit=5: [x.filled for x in asof.bounded_fill(rows, p, ["k"], "time", "v", [], limit).orderBy("time").collect()]
    assert fill(push((15, 0.123), (18, 0.125), (35, 0.134), (50, 0.145))) == [0.125, 0.125, 0.134, 0.134, 0.145]
    assert fill(push((30, 0.111))) == [0, 0, 0.111, 0.111, 0.111]
    assert fill(push((5, 0.9), (10, 0.5)), 1) == [0.5, 0.5, 0, 0, 0]


def test_replay_is_ordered(spark):
    at = 1620780000
    d = spark.createDataFrame([("600600", 20210512, 1)], "key string, t int, n int")
    m = spark.createDataFrame([("600600", at // 60 + i, 2 + i) for i in range(2)], d.schema)
    s = spark.createDataFrame([("600600", at + 10 * i, i) for i in range(20)], d.schema)
    ms = spark.createDataFrame([("600600", at * 1000 + 500 * i, i) for i in range(400)], "key string, t long, n int")
    out = asof.replay(asof.time_merge([("sdate", d, "t", "D", ["n"]), ("sminu", m, "t", "M", ["n"]), ("sssec", s, "t", "S", ["n"]), ("smsec", ms, "t", "T", ["n"])])).collect()
    assert len(out) == 423 and [x.time for x in out] == sorted(x.time for x in out)
    assert out[-1].table == "sdate" and out[-1].time % 86400000 == 86399999


def test_splits(spark):
    x = _series(spark, [-4, -3, -2, -1, 0, 1, 2, 3, 4, 5, 6])
    g = {r.v: r.bucket for r in buckets.signed_groups(x, ["k"], "v", 2, ["t"]).collect()}
    assert g == {-4: 0, -3: 0, -2: 1, -1: 1, 0: 2, 1: 3, 2: 3, 3: 3, 4: 4, 5: 4, 6: 4}
    cuts = [r.cut for r in buckets.quantile_cuts(_series(spark, range(1, 9)), ["k"], "v", 1).collect()]
    assert cuts == [4.5]
    assert [(r.lo, r.hi) for r in buckets.equal_width_splits(_series(spark, [0, 10]), ["k"], "v", 2, 0).orderBy("nth").collect()] == [(0, 5), (5, 10)]


def test_nearest_trend():
    y = np.array([101.95, 101.80, 100.10, 99.60, 101.5, 104.4, 101.3, 101.2, 101.1, 101.0])
    # back from 101.0 the rise to 104.4 is the first one of more than 1 percent that ends
    assert iterative.nearest_trend(y, 0.01)[:2] == (-1, 5) and iterative.nearest_trend(y, 0.01)[2] == pytest.approx((101.0 - 104.4) / 101.0)
    # from 101.95 the low of 99.60 comes first, the high of 104.4 later
    assert iterative.nearest_trend(y, 0.01, forward=True)[:2] == (-1, 3)
    assert iterative.nearest_trend(np.arange(1.0, 6), 0.01, forward=True)[:2] == (-1, 4)  # a pure rise, forward
    assert iterative.nearest_trend(np.arange(1.0, 6), 0.01)[:2] == (1, 0)
    # the change is measured from the first value: 104 isn't 5 percent above 100, 106 is, and 107 after it goes on
    assert iterative.nearest_trend(np.array([100.0, 104, 103, 106, 107, 90]), 0.05, forward=True)[:3] == (1, 4, pytest.approx(0.07))
    # no turning point: the line over all of it, in the bounds given
    flat = iterative.nearest_trend(np.array([100.0, 101, 102]), 0.05, 100, 102)
    assert flat[:2] == (0, 0) and flat[2] == pytest.approx((102 - (2 * 0.001 / 0.998 + 100)) / 102) and flat[3] == pytest.approx(0.499)
    assert iterative.nearest_trend(np.array([5.0, 6]), 0.01) == (0, 0, 0.01, 0.0)


def test_bits():
    assert iterative.trend_bits(np.array([1.0, 2, 2, 1]), 3) == 0b011  # the newest step falls: the highest bit
    assert iterative.trend_bits(np.array([3.0, 1, 2]), 2) == 0b10
    assert iterative.trend_bits(np.arange(9.0), 8) == -1 and iterative.trend_bits(np.array([1.0]), 3) == 0
    # 1 9 2 8 -> 5 5.5 5 by neighbours
    assert iterative.trend_bits(np.array([1.0, 9, 2, 8]), 2) == 0b01
    assert iterative.resample(np.array([0.0, 2, 4]), 9).tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4]
    assert iterative.resample(np.array([0.0, 2, 4]), 4).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert iterative.pair_bits(np.array([9.0, 0, 5, 1]), np.array([0.0, 1, 5, 2]), 4) == 0b010


def test_speed():
    assert iterative.speed(np.array([0.005, 1, 2, 3])) == 1  # mean step 0.998, first step 0.995
    assert iterative.speed(np.array([0.005, 3, 4])) == 2  # mean step 1.9975, first step 2.995
    assert iterative.speed(np.array([10, 8, 7])) == 1 and iterative.speed(np.array([5.0, 10, 14, 12, 11])) == 2
    assert iterative.speed(np.array([1, 0.01, 0.5, -3])) == 1 and iterative.speed(np.array([1, 0.009, 5])) == 0
    assert iterative.speed(np.array([0.0, 0.01, -0.01])) == 0


def test_factor_codes(spark):
    code = lambda v, **x: series.factor_codes(_series(spark, v), ["k"], ["t"], "v", **x).first().code
    assert code([1, 2, 3, 4, 5]) == 1111 and code([5, 4, 3, 2, 1]) == 1000
    assert code([1, 2, 3, 2, 1, 2, 3, 3]) == 1110  # newest first: 3 3, 2 3, then the fall 2 1
    assert code([1, 2, 3, 2, 3, 2]) == 1 and code([1, 2]) == 0  # one confirmed move only
    assert code([1, 1, 1, 9], sums=True) == 1 and code([1, 1, 1, 9]) == 0
    assert [iterative.factor_decode(c) for c in (1011, 1110, 1000, 111)] == [6, 3, 0, 0]
    two = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate([(1, 0), (1, 2), (3, 3), (4, 5)])], "k string, t int, a int, b int")
    assert series.factor_pair(two, ["k"], ["t"], "a", "b").first().code == 1010
    assert series.factor_pair(two.limit(2), ["k"], ["t"], "a", "b").first().code == 0


def test_rolling_drift(spark):
    out = rolling.rolling_drift(_series(spark, DRIFT), ["k"], ["t"], "v", 8).orderBy("t").collect()
    assert [x.drift for x in out[:4]] == [0, 0, 0, 0] and out[7].drift == pytest.approx(5.5346961)
    for i in (5, 9, 12):
        own = series.cubic_drift(_series(spark, DRIFT[max(0, i - 7) : i + 1]), ["k"], ["t"], "v").first().drift
        assert out[i].drift == pytest.approx(100 * own)


def test_quadratic(spark):
    y = np.array(DRIFT)
    assert tuple(series.quadratic(_series(spark, y), ["k"], ["t"], "v").first())[1:] == pytest.approx(tuple(np.polynomial.polynomial.polyfit(np.arange(len(y)), y, 2)))
    assert tuple(series.quadratic(_series(spark, [1, 2]), ["k"], ["t"], "v").first())[1:] == (0, 0, 0)
