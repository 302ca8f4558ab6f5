"""Every engine query against its SQL on the smallest data set."""

import math
import os

import duckdb
import pytest

from tidemark import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in by) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    found = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, found.fetchall())


def test_sketches_are_kept_by_type_only(spark, tmp_path):
    rows = spark.createDataFrame([(t, u) for t in ("a", "b", None) for u in (*range(300), *range(0, 300, 3), None)] + [("c", None)], "event_type string, user_id long")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    df = queries.QUERIES["x_approx_distinct"](spark, str(tmp_path))
    assert {r.event_type: r.near for r in df.collect()} == {"a": True, "b": True, "c": True, None: True}
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    sketched = [line for line in plan if "approx_count_distinct" in line]
    assert sketched and not [line for line in sketched if "user_id" in line.partition("functions=")[0]]
