"""Registered queries of the engine's operators, each with the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import numeric, strings, timeconv
from tidemark.operators import asof, buckets, lookup, match, predicates, rolling, series, theta, write
from tidemark.plans import partitions
from tidemark.plans.schema import convert, parse
from tidemark.sources import binary, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the data set; calendar functions are pinned to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def r(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


def ntz(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


ORDERS = ("o_orderkey", "o_custkey")


def _orders(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", day("o_orderdate").alias("o_orderdate"), "o_totalprice")


_O = "o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice"

# ---------------------------------------------------------------- A: scans, ingest, catalog


@query("SELECT event_id, epoch_us(ts) AS ts_us, event_type, value FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def a1_keyed_scan(spark, d):
    e = table(spark, d, "events")
    return e.where((F.col("user_id") == 7) & (F.col("ts") >= ntz("2024-01-05")) & (F.col("ts") < ntz("2024-01-12"))).select("event_id", micros("ts").alias("ts_us"), "event_type", "value")


@query(f"SELECT {_O} FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)".replace("QUALIFY o_orderdate", "QUALIFY orders.o_orderdate").replace("max(o_orderdate)", "max(orders.o_orderdate)"))
def a2_latest_per_key(spark, d):
    return _orders(lookup.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-02-28' GROUP BY 1")
def a3_time_partitioned_scan(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate").between(ntz("1996-03-01"), ntz("1998-02-28")))
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 10) ORDER BY p_partkey LIMIT 5")
def a4_positional_rows(spark, d):
    return lookup.positional(table(spark, d, "part"), ["p_partkey"], -10, 5).select("p_partkey", "p_name")


@query("SELECT r_name AS key, pos, value FROM (SELECT r_name, unnest([0, 1]) AS pos, unnest([CAST(r_regionkey AS VARCHAR), r_name]) AS value FROM region)")
def a5_blob_list(spark, d):
    g = table(spark, d, "region").select(F.col("r_name").alias("key"), F.posexplode(F.array(F.col("r_regionkey").cast("string"), "r_name")).alias("pos", "value"))
    return g


@query("SELECT n_nationkey, concat_ws(',', CAST(n_nationkey AS VARCHAR), n_name, printf('%.2f', CAST(n_regionkey AS DOUBLE))) AS line FROM nation")
def a13_csv_line(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", text.csv_line([F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")], [None, None, 2]).alias("line"))


@query("SELECT event_id, event_type, round(value, 2) AS value FROM events WHERE event_type <> 'view'")
def a12_csv_stream(spark, d):
    """Written as CSV, read as a stream of files, filtered on the way."""
    from tidemark.streaming import stream

    root = _stream_root(spark)
    e = table(spark, d, "events").select("event_id", "event_type", F.round("value", 2).alias("value"))
    text.write_csv(e.repartition(3), root + "/in", {"value": 2})
    return stream.drain(text.stream_csv(spark, root + "/in", "event_id long, event_type string, value double").where("event_type <> 'view'"), root)


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def a11_csv_file(spark, d):
    """Written with fixed decimals, read whole."""
    path = _stream_root(spark) + "/orders"
    text.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, {"o_totalprice": 2})
    return text.read_csv(spark, path, schema="o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing FROM events")
def a15_json_path(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", text.json_get(F.col("props"), "k", kind="long").alias("k"), text.json_get(F.col("props"), "missing", -1, "long").alias("missing"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, 0 AS absent FROM events")
def a18_rows_from_objects(spark, d):
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("k", LongType()), StructField("absent", IntegerType())])
    return text.rows_from_objects(table(spark, d, "events").select("event_id", "props"), "props", schema)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0")
def a19_rows_from_arrays(spark, d):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    c = table(spark, d, "customer")
    wide = F.when(F.col("c_custkey") % 3 == 0, F.lit(",1")).otherwise(F.lit(""))
    one = F.format_string('[%d,"%s",%d%s]', "c_custkey", "c_name", "c_nationkey", wide)
    schema = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_nationkey", LongType())])
    return text.rows_from_arrays(c.select(F.when(F.col("c_custkey") % 2 == 0, one).otherwise(F.concat(F.lit("["), one, F.lit("]"))).alias("j")), "j", schema)


@query("SELECT n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']' AS row_text FROM nation")
def a22_row_as_array(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", text.as_json_array([F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")]).alias("row_text"))


@query("""SELECT n_regionkey, '{"fields":{"n_nationkey":0,"n_name":1},"' || n_regionkey || '":[' ||
          string_agg('[' || n_nationkey || ',"' || n_name || '"]', ',' ORDER BY n_nationkey) || ']}' AS document FROM nation GROUP BY n_regionkey""")
def a22_keyed_document(spark, d):
    return text.keyed_document(table(spark, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, 0 AS seq FROM orders UNION ALL
          SELECT o_orderkey, o_custkey, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
          SELECT -o_orderkey, o_custkey, o_totalprice, 2 FROM orders WHERE o_orderkey % 7 = 0)
          SELECT o_orderkey, o_custkey, round(arg_max(o_totalprice, seq), 4) AS o_totalprice FROM b GROUP BY 1, 2""")
def a23_upsert_batch(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.withColumn("seq", F.lit(0))
    again = o.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    fresh = o.where("o_orderkey % 7 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    new = again.withColumn("seq", F.lit(1)).union(fresh.withColumn("seq", F.lit(2)))  # the key 0 is in both
    out = write.upsert(old, new, ["o_orderkey", "o_custkey"], "seq")
    return out.select("o_orderkey", "o_custkey", r("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT CAST(strftime(l_shipdate, '%Y') AS BIGINT) AS year, count(*) AS n, count(DISTINCT l_suppkey) AS keys FROM lineitem GROUP BY 1")
def a24_partition_routing(spark, d):
    t = parse("ship", {"fields": {"l_date": ["D", 4, 1, 0, "IO"], "l_suppkey": ["I", 8]}})
    li = table(spark, d, "lineitem").select(timeconv.date_int(F.col("l_shipdate")).alias("l_date"), "l_suppkey")
    return li.groupBy(t.partition().cast("long").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("keys"))


@query("SELECT 'stk_day' AS tbl, unnest(['time', 'open', 'volume']) AS field, unnest(['D', 'P', 'U']) AS kind, unnest([4, 4, 8]) AS bytes")
def a28_show_catalog(spark, d):
    from tidemark.plans.engine import Engine

    e = Engine(spark)
    e.create("stk_day", {"fields": {"time": ["date", 4, 1, 0, "IO"], "open": ["P", 4, 1, 2], "volume": ["U", 8], "bad": ["?", 4]}})
    return e.show().select(F.col("table").alias("tbl"), "field", F.col("type").alias("kind"), "bytes")


@query("SELECT DISTINCT user_id FROM events")
def a31_distinct_keys(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


@query("SELECT event_type, user_id, event_id, value FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def a32_last_row_of_many(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return lookup.last_rows(e, ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", "value")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE NOT (l_suppkey = 3 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31') GROUP BY 1")
def a33_delete_range(spark, d):
    gone = (F.col("l_suppkey") == 3) & F.col("l_shipdate").between(ntz("1996-01-01"), ntz("1997-12-31"))
    return write.delete(table(spark, d, "lineitem"), gone).groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT count(*) AS n FROM events WHERE user_id NOT IN (1, 2, 3)")
def a34_remove_keys(spark, d):
    return write.delete(table(spark, d, "events"), F.col("user_id").isin(1, 2, 3)).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem WHERE l_suppkey = 5 AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def a43_date_range(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_suppkey") == 5)
    return lookup.range_rows(li, ["l_suppkey"], "l_shipdate", ntz_value("1997-01-01"), ntz_value("1997-06-30")).select("l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("l_shipdate"))


def ntz_value(s: str):
    from datetime import datetime

    return datetime.fromisoformat(s)


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'")
def a44_one_day(spark, d):
    e = table(spark, d, "events")
    return e.where((F.col("ts") >= ntz("2024-01-09")) & (F.col("ts") < ntz("2024-01-10"))).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-13' AND dayofweek(ts) NOT IN (0, 6)")
def a7_daily_files(spark, d):
    """Daily folders, written and read back; Saturdays and Sundays are passed over."""
    path = _stream_root(spark) + "/days"
    partitions.write_segments(table(spark, d, "events"), path, "ts")
    return partitions.read_days(spark, path, 20240103, 20240112, weekends=False).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' AND hour(ts) BETWEEN 6 AND 17")
def a8_segments(spark, d):
    """Segments of six hours, written in two parts that come after each other."""
    path, e = _stream_root(spark) + "/segments", table(spark, d, "events")
    for odd in (0, 1):
        partitions.write_segments(e.where(F.col("event_id") % 2 == odd), path, "ts", 6)
    return partitions.read_days(spark, path, 20240105, 20240107, segments=(1, 2)).select("event_id", "user_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::INTEGER AS o_date FROM orders WHERE o_orderdate BETWEEN DATE '1995-03-01' AND DATE '1996-06-30'")
def a6_structured_range(spark, d):
    """Yearly folders, of which two are read."""
    path = _stream_root(spark) + "/years"
    o = table(spark, d, "orders").select("o_orderkey", timeconv.date_int(F.col("o_orderdate")).cast("int").alias("o_date"))
    write.write_table(o.withColumn("year", F.floor(F.col("o_date") / 10000).cast("int")), path, "year", "o_orderkey", "o_date")
    return partitions.read_range(spark, path, "o_date", 19950301, 19960630, "year").select("o_orderkey", "o_date")


@query("SELECT o_orderkey, o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_totalprice FROM orders")
def a10_journal(spark, d):
    """Two batches are logged, the first is applied, then the writer is lost: what is left in the log is applied."""
    root, o = _stream_root(spark), table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    log = write.Journal(spark, root + "/log")
    first = log.append(o)
    done = o.withColumn("entry", F.lit(first))
    log.applied(first)
    log.append(o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return write.upsert(done, log.recover(), ["o_orderkey"], "entry").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def a20_binary_rows(spark, d):
    """Rows packed into bytes and unpacked again."""
    t = parse("o", {"fields": {"o_orderkey": ["I", 8], "o_custkey": ["I", 8], "o_totalprice": ["F", 8], "o_orderstatus": ["C", 4]}})
    packed = binary.rows_to_bytes(table(spark, d, "orders").select(*[f.name for f in t.fields]), t)
    return binary.rows_from_bytes(packed, "bytes", t)


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j, '[' || o_custkey || ',"' || o_orderstatus || '"]' AS a, o_custkey || ',' || o_orderstatus AS c, o_custkey || ' ' || o_orderstatus AS t FROM orders""")
def a21_formats(spark, d):
    t = parse("o", {"fields": {"o_custkey": ["I", 8], "o_orderstatus": ["C", 4]}})
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kinds = {"j": "json", "a": "array", "c": "csv", "t": "text"}
    return o.select("o_orderkey", *[binary.format_column(k, t).alias(n) for n, k in kinds.items()])


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-02-02' OR ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-02'")
def a37_day_store(spark, d):
    """Days are started, written in two parts, stopped, and merged."""
    e, path = table(spark, d, "events"), _stream_root(spark) + "/store"
    store = write.DayStore(spark, path, "user_id", "ts")
    for day in (20240101, 20240130, 20240131, 20240201):
        of_day = e.where(timeconv.date_int(F.col("ts")) == day)
        store.start(day)
        for odd in (0, 1):
            store.set(of_day.where(F.col("event_id") % 2 == odd))
        store.stop()
    store.merge(2024)
    return store.read(20240101, 20240201).select("event_id", "day")


# ---------------------------------------------------------------- B: projections and predicates


@query("SELECT value, event_id FROM events")
def b1_projection(spark, d):
    return lookup.project(table(spark, d, "events"), "value,event_id")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS embedding_0, CAST(embedding[4] AS DOUBLE) AS embedding_3 FROM embeddings")
def b3_array_element(spark, d):
    p = lookup.project(table(spark, d, "embeddings"), ["vec_id", "embedding.0", "embedding.3"])
    return p.select("vec_id", *[F.col(c).cast("double").alias(c) for c in ("embedding_0", "embedding_3")])


@query(f"SELECT {_O} FROM orders WHERE orders.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
def b4_range_inclusive(spark, d):
    return _orders(lookup.range_rows(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ntz_value("1996-01-01"), ntz_value("1996-03-31")))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rn, max(o_orderdate) OVER (PARTITION BY o_custkey) AS hi FROM orders),
          lo AS (SELECT o_custkey, min(o_orderdate) AS lo FROM k WHERE rn <= 3 GROUP BY 1)
          SELECT 'last3' AS form, o_orderkey FROM k JOIN lo USING (o_custkey) WHERE o_orderdate >= lo
          UNION ALL SELECT 'since', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
          UNION ALL SELECT 'point', o_orderkey FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-05'
          UNION ALL SELECT 'newest', o_orderkey FROM k WHERE o_orderdate = hi""")
def b5_range_sentinels(spark, d):
    o = table(spark, d, "orders")
    forms = {"last3": (-3, -1), "since": (ntz_value("2001-01-01"), -1), "point": (ntz_value("1997-05-05"), 0), "newest": (-1, 0)}
    parts = [lookup.range_rows(o, ["o_custkey"], "o_orderdate", *b).select(F.lit(n).alias("form"), "o_orderkey") for n, b in forms.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""WITH i AS (SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'),
          p AS (SELECT * FROM orders o WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate = TIMESTAMP '1997-01-01')
                QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
          SELECT o_orderkey, o_custkey FROM i UNION ALL SELECT o_orderkey, o_custkey FROM p""")
def b6_range_ifprev(spark, d):
    o = table(spark, d, "orders")
    return lookup.range_rows(o, ["o_custkey"], "o_orderdate", ntz_value("1997-01-01"), ntz_value("1997-12-31"), True, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = TIMESTAMP '1996-07-01'")
def b7_where_equal(spark, d):
    return lookup.where_rows(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ntz_value("1996-07-01")).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey, CAST(-row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS back
          FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' QUALIFY back >= -2""")
def b8_where_offset(spark, d):
    o = table(spark, d, "orders")
    parts = [lookup.where_rows(o, ["o_custkey"], "o_orderdate", ntz_value("1998-01-01"), n, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.lit(n).alias("back")) for n in (-1, -2)]
    return parts[0].union(parts[1])


@query("SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3")
def b10_first_rows_of_day(spark, d):
    e = table(spark, d, "events").where(F.col("ts") >= ntz("2024-01-10"))
    return lookup.first_rows(e, ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


@query("SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 9 AND p_brand LIKE 'Brand#1%') OR lower(p_name) LIKE '%a%' AND p_size = 20")
def b11_scoped_predicates(spark, d):
    tree = [("$group", {"field": "p_size", "min": 5, "max": 9, "$match": {"field": "p_brand", "value": "brand#1"}}), ("$same", {"field": "p_size", "value": 20, "$contain": {"field": "p_name", "value": "a"}})]
    return predicates.standard().filter(table(spark, d, "part").withColumn("p_name", F.lower("p_name")), tree).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size > 3 AND p_size <= 10) AND (p_brand = 'Brand#11' OR p_brand = 'Brand#12')")
def b12_search_tree(spark, d):
    return table(spark, d, "part").where(predicates.search({"p_size": "(3,10]", "p_brand": ["Brand#11", "Brand#12"]})).select("p_partkey")


@query("""SELECT l_returnflag, count(*) AS n FROM lineitem WHERE (l_quantity >= 30 AND (l_returnflag IN ('A', 'R') OR l_discount >= 0.05)) OR l_tax = 0.08 GROUP BY 1""")
def b13_predicate_tree(spark, d):
    tree = """{"$group": {"field": "l_quantity", "min": 30, "$in": {"field": "l_returnflag", "values": ["A", "R"]}, "$group": {"field": "l_discount", "min": 0.05}},
               "$same": {"field": "l_tax", "value": 0.08}}"""
    methods = predicates.Registry({k: (lambda a, m=m: m(dict(a))) for k, m in predicates.standard().methods.items()})
    return methods.filter(table(spark, d, "lineitem"), tree).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT n_name FROM nation WHERE lower(n_name) IN ('france', 'nation_3', 'japan', 'nation_12') OR n_nationkey = 0")
def b15_key_list(spark, d):
    return table(spark, d, "nation").where(match.in_list(F.col("n_name"), "FRANCE,nation_3,Japan,NATION_12") | (F.col("n_nationkey") == 0)).select("n_name")


@query("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) LIKE 'brand#2%' OR lower(p_brand) LIKE 'brand#41%'")
def b16_key_prefix(spark, d):
    return table(spark, d, "part").where(match.has_prefix(F.col("p_brand"), "brand#2,BRAND#41")).select("p_partkey", "p_brand")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE '%i%' OR event_type LIKE '%rro%' GROUP BY 1")
def b17_key_contains(spark, d):
    return table(spark, d, "events").where(match.has_part(F.col("event_type"), "I,rro")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE lower(c_mktsegment) LIKE 'a%' OR lower(c_mktsegment) LIKE 'b%' GROUP BY 1")
def b18_subject_filter(spark, d):
    return table(spark, d, "customer").where(match.subject_filter(F.col("c_mktsegment"), F.lit("customer"), "A,B", "customer")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size BETWEEN 10 AND 20 AS inside, (least(p_size, 30) - 20 > 0.001 OR p_size = 20) AS meets FROM part""")
def b20_between_overlap(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", numeric.between(F.col("p_size"), 20, 10).alias("inside"), numeric.overlaps(F.col("p_size"), F.lit(0), F.lit(20), F.lit(30)).alias("meets"))


@query("SELECT c_custkey, regexp_matches(substr(c_name, 10), '^[0-9]+$') AS digits, regexp_matches(strftime(DATE '2024-01-01' + CAST(c_nationkey AS INTEGER), '%Y%m%d'), '^[0-9]{8,}$') AS dated FROM customer")
def b21_shape_tests(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", strings.is_number(F.substr("c_name", F.lit(10))).alias("digits"), strings.is_date(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey").cast("int")), "yyyyMMdd")).alias("dated"))


@query("""WITH n AS (SELECT event_id, event_type, value FROM events WHERE value > 20), a AS (SELECT event_id FROM n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5)
          SELECT event_id FROM a UNION SELECT event_id FROM n WHERE event_type = 'click' UNION SELECT event_id FROM events WHERE user_id = 7""")
def b14_filter_lists(spark, d):
    """Nodes that pick rows: the largest five of each type or all clicks, of those above 20; or a user's."""
    top = lambda df, a: df.withColumn("__n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where(F.col("__n") <= a["n"]).drop("__n")
    methods = {"above": lambda df, a: df.where(F.col("value") > a["min"]), "top": top, "type": lambda df, a: df.where(F.col("event_type") == a["is"]), "user": lambda df, a: df.where(F.col("user_id") == a["is"])}
    tree = '{"$above": {"min": 20, "$top": {"n": 5}, "$type": {"is": "click"}}, "$user": {"is": 7}}'
    return predicates.select(table(spark, d, "events"), tree, methods, ["event_id"]).select("event_id")


# ---------------------------------------------------------------- C: joins in time


@query("""WITH c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
          SELECT p.event_id, epoch_us(c.ts) AS click_us, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
          ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts > c.ts""")
def c1_asof_join(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(left, e.where("event_type = 'click'"), ["user_id"], "ts", "value", ["event_id"], strict=True)
    return out.select("event_id", F.unix_micros(F.col("ts_asof").cast("timestamp")).alias("click_us"), F.col("value_asof").alias("click_value"))


@query("SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def c2_dictionary_resolution(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, substr(p_name, 1, 8) AS p_name, CAST(p_size AS BIGINT) AS p_size, 0 AS extra FROM part")
def c3_schema_mapping(spark, d):
    a = parse("a", {"fields": {"p_name": ["C", 64], "p_size": ["I", 4], "p_type": ["C", 20]}})
    b = parse("b", {"fields": {"p_name": ["C", 8], "p_size": ["I", 8], "extra": ["I", 4]}})
    return convert(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type"), a, b)


@query("""WITH m AS (SELECT 'orders' AS tbl, 0 AS t, CAST(o_custkey AS VARCHAR) AS key, epoch_ms(o_orderdate) + 86399999 AS time_ms, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS seq FROM orders
          UNION ALL SELECT 'events', 1, CAST(user_id AS VARCHAR), CAST(floor(epoch_us(ts) / 1000) AS BIGINT), lpad(CAST(event_id AS VARCHAR), 20, '0') FROM events
          UNION ALL SELECT 'part', 2, CAST(p_partkey AS VARCHAR), 0, lpad(CAST(p_partkey AS VARCHAR), 20, '0') FROM part)
          SELECT tbl, key, CAST(time_ms AS BIGINT) AS time_ms, seq FROM m""")
def c4_time_merge(spark, d):
    return asof.replay(_merged(spark, d)).select(F.col("table").alias("tbl"), "key", F.col("time").alias("time_ms"), "seq")


def _merged(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), timeconv.date_int(F.col("o_orderdate")).alias("date"), "o_orderkey")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(micros("ts") / 1000).alias("ms"), "event_id")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_partkey")
    return asof.time_merge([("orders", o, "date", "D", ["o_orderkey"]), ("events", e, "ms", "T", ["event_id"]), ("part", p, None, None, ["p_partkey"])])


@query("""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events WHERE event_type = 'view'),
          c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events WHERE event_type = 'click')
          SELECT user_id, count(*) AS n, round(sum(p.value * c.value), 2) AS product FROM p JOIN c USING (user_id, n) GROUP BY 1""")
def c5_position_pairs(spark, d):
    e = table(spark, d, "events")
    a, b = (series.numbered(e.where(F.col("event_type") == k), ["user_id"], ["ts", "event_id"], "n").select("user_id", "n", F.col("value").alias(k)) for k in ("view", "click"))
    return a.join(b, ["user_id", "n"]).groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum(F.col("view") * F.col("click")), 2).alias("product"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
          c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'),
          o AS (SELECT c.value, c.ts AS cts, p.event_id FROM c ASOF JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts),
          own AS (SELECT event_id, arg_max(value, cts) AS v FROM o GROUP BY 1),
          n AS (SELECT p.*, own.v FROM p LEFT JOIN own USING (event_id))
          SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0.0) AS filled FROM n""")
def c6_bounded_fill(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = asof.bounded_fill(e.where("event_type = 'purchase'").drop("value"), e.where("event_type = 'click'"), ["user_id"], "ts", "value", ["event_id"])
    return out.select("event_id", "filled")


@query("""WITH s(subscriber, pattern) AS (VALUES (1, 'cl'), (2, '*'), (3, 'purchase'), (4, 'v'), (5, 'zzz'))
          SELECT subscriber, count(*) AS n FROM events JOIN s ON s.pattern = '*' OR starts_with(event_type, s.pattern) GROUP BY 1""")
def c7_pattern_fanout(spark, d):
    s = spark.createDataFrame([(1, "cl"), (2, "*"), (3, "purchase"), (4, "v"), (5, "zzz")], "subscriber int, pattern string")
    return match.fan_out(table(spark, d, "events"), "event_type", s).groupBy("subscriber").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- D: aggregates and series


@query("SELECT event_type, round(avg(value), 6) AS avg_v, min(value) FILTER (abs(value) >= 1e-7) AS min_v, max(value) FILTER (abs(value) >= 1e-7) AS max_v FROM events GROUP BY 1")
def d1_stats_nonzero(spark, d):
    return series.stats_nonzero(table(spark, d, "events"), ["event_type"], "value").withColumn("avg_v", r("avg_v"))


@query("SELECT event_type, round(avg(value), 6) AS avg_v, round(median(value), 6) AS median_v FROM events GROUP BY 1")
def d2_mean_median(spark, d):
    return series.mean_median(table(spark, d, "events"), ["event_type"], "value").select("event_type", r("avg_v").alias("avg_v"), r("median_v").alias("median_v"))


@query("SELECT user_id, round(avg(value), 6) AS mean_v, round(coalesce(stddev_samp(value), 0), 6) AS std_v FROM events GROUP BY 1")
def d3_mean_std(spark, d):
    return series.mean_std(table(spark, d, "events"), ["user_id"], "value").select("user_id", r("mean_v").alias("mean_v"), r("std_v").alias("std_v"))


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)
          SELECT event_id, round(exp(-((value - m) ** 2) / (2 * s ** 2)) / (sqrt(2 * 3.1415927) * s), 8) AS density FROM events JOIN s USING (event_type)""")
def d4_density(spark, d):
    e = table(spark, d, "events")
    return e.join(series.mean_std(e, ["event_type"], "value"), "event_type").select("event_id", r(series.density(F.col("value"), F.col("mean_v"), F.col("std_v")), 8).alias("density"))


@query("""WITH p AS (SELECT user_id, value, [1, 1, 2, 3, 5, 8, 13, 21, 34, 55][CAST(floor((row_number() OVER w - 1) / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) * 10) AS INTEGER) + 1] AS f FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
          SELECT user_id, round(sum(f * value) / sum(f), 6) AS fib_avg FROM p GROUP BY 1""")
def d5_fibonacci_avg(spark, d):
    return series.fibonacci_average(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", r("fib_avg").alias("fib_avg"))


#: The warm-up mean of a list: its first value, then the weights by how many values came before.
_WARM = "CASE WHEN len({l}) = 0 THEN 0.0 ELSE list_reduce({l}, lambda m, x, i: CASE WHEN i <= 10 THEN m * (1 - 1.0::DOUBLE / 10) + x * (1.0::DOUBLE / 10) WHEN i <= 100 THEN m * (1 - 1.0::DOUBLE / i) + x * (1.0::DOUBLE / i) ELSE m * (1 - 1.0::DOUBLE / 100) + x * (1.0::DOUBLE / 100) END) END"


@query(f"WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) FILTER (abs(value) >= 1e-7) AS l FROM events GROUP BY 1) SELECT user_id, round({_WARM.format(l='l')}, 6) AS warm_mean FROM l")
def d6_warm_mean(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(series.as_array("value", ["ts", "event_id"]).alias("v"))
    return e.select("user_id", r(series.warm_mean(F.col("v"))).alias("warm_mean"))


@query(f"""WITH g AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS son, sum(l_extendedprice) AS mom FROM lineitem GROUP BY 1, 2),
          l AS (SELECT l_suppkey, list(son ORDER BY l_shipdate) AS s, list(mom ORDER BY l_shipdate) AS m FROM g WHERE abs(son) >= 1e-7 AND abs(mom) >= 1e-7 GROUP BY 1)
          SELECT l_suppkey, round({_WARM.format(l='s')} / {_WARM.format(l='m')}, 8) AS warm_ratio FROM l""")
def d7_warm_ratio(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("son"), F.sum("l_extendedprice").alias("mom"))
    pairs = li.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "son", "mom"))).alias("p"))
    return pairs.select("l_suppkey", r(series.warm_ratio(F.col("p")), 8).alias("warm_ratio"))


_PAIR = """p AS (SELECT l_linestatus AS k, l_shipdate AS t, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS b
          FROM lineitem GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS pos FROM p)"""


def _pairs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    p = li.groupBy(F.col("l_linestatus").alias("k"), F.col("l_shipdate").alias("t")).agg(of("A").alias("a"), of("R").alias("b"))
    return series.numbered(p, ["k"], ["t"])


@query(f"WITH {_PAIR} SELECT k, round(coalesce(corr(a, b), 0), 6) AS corr FROM s GROUP BY 1")
def d8_corr(spark, d):
    return _pairs(spark, d).groupBy("k").agg(r(series.correlation("a", "b")).alias("corr"))


_LAG = """, n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), g AS (SELECT k, unnest(range(0, CAST(floor(n * 0.382 + 1) AS INTEGER) + 1)) AS lag FROM n),
          j AS (SELECT g.k, g.lag, x.a, y.b FROM g JOIN s x ON x.k = g.k JOIN s y ON y.k = g.k AND y.pos = x.pos + g.lag),
          e AS (SELECT k, lag, {measure} AS v FROM j GROUP BY 1, 2),
          f AS (SELECT *, CASE WHEN v < lag(v) OVER (PARTITION BY k ORDER BY lag) THEN 1 ELSE 0 END AS fell FROM e),
          h AS (SELECT *, max(fell) OVER (PARTITION BY k ORDER BY lag) AS stop FROM f)
          SELECT k, CAST(max(lag) AS INTEGER) AS lag, round(arg_max(v, lag), 6) AS value FROM h WHERE stop = 0 GROUP BY 1"""
_DIRECTION = """CASE WHEN count(*) FILTER (a * b > 0) > count(*) - count(*) FILTER (a * b > 0) THEN (count(*) FILTER (a * b > 0) / CAST(count(*) AS DOUBLE) - 0.5) * 2
          WHEN count(*) FILTER (a * b > 0) < count(*) - count(*) FILTER (a * b > 0) THEN (-(count(*) - count(*) FILTER (a * b > 0)) / CAST(count(*) AS DOUBLE) - 0.5) * 2 ELSE 0.0 END"""


@query(f"WITH {_PAIR}" + _LAG.replace("{measure}", "round(coalesce(corr(a, b), 0), 9)"))
def d9_corr_lag(spark, d):
    measure = lambda a, b: F.round(series.correlation(a, b), 9)
    return series.lagged(_pairs(spark, d), ["k"], "pos", "a", "b", None, measure).select("k", F.col("lag").cast("int").alias("lag"), r("value").alias("value"))


def _moves(spark, d) -> DataFrame:
    w = Window.partitionBy("k").orderBy("t")
    p = _pairs(spark, d)
    return p.select("k", "t", "pos", (F.col("a") - F.lag("a").over(w)).alias("a"), (F.col("b") - F.lag("b").over(w)).alias("b")).where("pos > 1").withColumn("pos", F.col("pos") - 1)


_MOVE_SQL = _PAIR.split(", s AS")[0] + """, m AS (SELECT k, t, a - lag(a) OVER (PARTITION BY k ORDER BY t) AS a, b - lag(b) OVER (PARTITION BY k ORDER BY t) AS b FROM p),
          s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS pos FROM m WHERE a IS NOT NULL)"""


@query(f"WITH {_MOVE_SQL} SELECT k, round({_DIRECTION}, 6) AS agree FROM s GROUP BY 1")
def d10_direction(spark, d):
    return _moves(spark, d).groupBy("k").agg(r(series.direction("a", "b")).alias("agree"))


@query(f"WITH {_MOVE_SQL}" + _LAG.replace("{measure}", _DIRECTION))
def d11_direction_lag(spark, d):
    return series.lagged(_moves(spark, d), ["k"], "pos", "a", "b", None, series.direction).select("k", F.col("lag").cast("int").alias("lag"), r("value").alias("value"))


_MONTH = "m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS pos, count(*) OVER (PARTITION BY k) AS n FROM m)"


def _monthly(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.date_trunc("month", "o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("v"))


@query(f"""WITH {_MONTH}, a AS (SELECT k, avg(v) AS mean FROM s GROUP BY 1), x AS (SELECT k, n, pos - 1 - (n - 1) / 2.0 AS x, v / mean AS y FROM s JOIN a USING (k)),
          g AS (SELECT k, max(n) AS n, (max(n) - 1) / 2.0 AS e, sum(x ** 2) AS s2, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x ** 2 * y) AS t2 FROM x GROUP BY 1),
          b AS (SELECT *, (n * t2 - s2 * t0) / (n * s4 - s2 * s2) AS b2, t1 / s2 AS b1 FROM g)
          SELECT k, round((t0 - b2 * s2) / n - b1 * e + b2 * e * e, 6) AS c0, round(b1 - 2 * b2 * e, 6) AS c1, round(b2, 6) AS c2 FROM b""")
def d12_polynomial(spark, d):
    m = _monthly(spark, d)
    m = m.join(m.groupBy("k").agg(F.avg("v").alias("mean")), "k").withColumn("y", F.col("v") / F.col("mean"))
    return series.quadratic(m, ["k"], ["t"], "y").select("k", *[r(c).alias(c) for c in ("c0", "c1", "c2")])


@query(f"WITH {_MONTH} SELECT k, round(regr_slope(v, pos), 3) AS slope, round(regr_intercept(v, pos), 3) AS intercept FROM s GROUP BY 1")
def d13_slope(spark, d):
    return series.slope(_monthly(spark, d), ["k"], ["t"], "v").select("k", r("slope", 3).alias("slope"), r("intercept", 3).alias("intercept"))


@query(f"WITH {_MONTH} SELECT k, round(regr_slope(v, pos) / ((greatest(0, max(v)) - least(0, min(v))) / (count(*) - 1)), 6) AS slope_rate FROM s GROUP BY 1")
def d14_slope_rate(spark, d):
    return series.slope_rate(_monthly(spark, d), ["k"], ["t"], "v").select("k", r("slope_rate").alias("slope_rate"))


_CUBIC = f"""WITH {_MONTH}, a AS (SELECT k, avg(v) AS mean FROM s GROUP BY 1),
          x AS (SELECT k, n, pos - 1 - (n - 1) / 2.0 AS x, v / mean AS y FROM s JOIN a USING (k)),
          g AS (SELECT k, max(n) AS n, sum(x ** 2) AS s2, sum(x ** 4) AS s4, sum(x ** 6) AS s6, sum(y) AS t0, sum(x * y) AS t1, sum(x ** 2 * y) AS t2, sum(x ** 3 * y) AS t3 FROM x GROUP BY 1),
          c AS (SELECT k, (n - 1) / 2.0 AS e, (t1 * s6 - t3 * s4) / (s2 * s6 - s4 * s4) AS c1, (t3 * s2 - t1 * s4) / (s2 * s6 - s4 * s4) AS c3, (n * t2 - s2 * t0) / (n * s4 - s2 * s2) AS c2 FROM g)"""


@query(f"{_CUBIC} SELECT k, round(c1 + 2 * c2 * e + 3 * c3 * e * e, 6) AS drift FROM c")
def d15_drift(spark, d):
    return series.cubic_drift(_monthly(spark, d), ["k"], ["t"], "v").select("k", r("drift").alias("drift"))


@query(f"{_CUBIC} SELECT k, round(2 * c2 + 6 * c3 * e, 6) AS acceleration FROM c")
def d16_acceleration(spark, d):
    return series.cubic_drift(_monthly(spark, d), ["k"], ["t"], "v").select("k", r("acceleration").alias("acceleration"))


_CUBIC_NORM = _CUBIC.replace("a AS (SELECT k, avg(v)", "e0 AS (SELECT k, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1), z AS (SELECT k, pos, n, 0.001 + (v - lo) / (hi - lo) * 0.998 AS v FROM s JOIN e0 USING (k)), a AS (SELECT k, avg(v)").replace("AS mean FROM s GROUP BY 1", "AS mean FROM z GROUP BY 1").replace("AS y FROM s JOIN a", "AS y FROM z JOIN a")


@query(f"{_CUBIC_NORM} SELECT k, round(c1 + 2 * c2 * e + 3 * c3 * e * e, 6) AS drift, round(2 * c2 + 6 * c3 * e, 6) AS acceleration FROM c")
def d17_normalised_drift(spark, d):
    n = rolling.minmax_normalise(_monthly(spark, d), ["k"], "v")
    return series.cubic_drift(n, ["k"], ["t"], "norm").select("k", r("drift").alias("drift"), r("acceleration").alias("acceleration"))


@query(f"""WITH {_MONTH}, e AS (SELECT k, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1)
          SELECT k, round(regr_slope(0.001 + (v - lo) / (hi - lo) * 0.998, pos), 6) AS slope, round(regr_intercept(0.001 + (v - lo) / (hi - lo) * 0.998, pos), 6) AS rate FROM s JOIN e USING (k) GROUP BY 1""")
def d18_norm_slope(spark, d):
    n = rolling.minmax_normalise(_monthly(spark, d), ["k"], "v")
    return series.slope(n, ["k"], ["t"], "norm").select("k", r("slope").alias("slope"), r("intercept").alias("rate"))


@query(f"""WITH {_MONTH}, e AS (SELECT k, min(v) AS lo, max(v) AS hi, avg(v) AS mid FROM s GROUP BY 1),
          f AS (SELECT k, pos, CASE WHEN v >= mid THEN 0.5 + (v - mid) / (hi - mid) * 0.499 ELSE 0.5 - (mid - v) / (mid - lo) * 0.499 END AS y FROM s JOIN e USING (k))
          SELECT k, round(regr_slope(y, pos), 6) AS slope FROM f GROUP BY 1""")
def d19_drift_split(spark, d):
    n = rolling.split_normalise(_monthly(spark, d), ["k"], "v")
    return series.slope(n, ["k"], ["t"], "norm").select("k", r("slope").alias("slope"))


def _arrays(spark, d, n: int = 0) -> DataFrame:
    m = _monthly(spark, d)
    m = lookup.last_rows(m, ["k"], ["t"], n) if n else m
    return m.groupBy("k").agg(series.as_array("v", ["t"]).alias("v"))


#: Back from each key's last value a: the first new extreme that {far}, and where the new ones end.
_TURN = """, r AS (SELECT k, v, row_number() OVER w - 1 AS i, first_value(v) OVER w AS a, count(*) OVER p AS n, min(v) OVER p AS lo, max(v) OVER p AS hi FROM s WINDOW w AS (PARTITION BY k ORDER BY t DESC), p AS (PARTITION BY k)),
          x AS (SELECT *, coalesce(v > max(v) OVER q, false) AS up, coalesce(v < min(v) OVER q, false) AS dn FROM r WINDOW q AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          h AS (SELECT k, min(i) FILTER (up AND (v - a) / a > {far}) AS u0, min(i) FILTER (dn AND (a - v) / a > {far}) AS d0 FROM x GROUP BY 1),
          e AS (SELECT k, max(n) AS n, max(u0) AS u0, max(d0) AS d0, min(i) FILTER (NOT up AND i > u0) AS u1, min(i) FILTER (NOT dn AND i > d0) AS d1 FROM x JOIN h USING (k) GROUP BY 1),
          g AS (SELECT k, n, CASE WHEN u0 IS NOT NULL THEN coalesce(u1, n) - 1 END AS u, CASE WHEN d0 IS NOT NULL THEN coalesce(d1, n) - 1 END AS d FROM e),
          f AS (SELECT *, least(coalesce(u, n - 1), coalesce(d, n - 1)) AS far_i FROM g)"""


@query(f"""WITH {_MONTH}{_TURN.format(far="0.05")}, l AS (SELECT k, regr_slope(0.001 + (v - lo) / (hi - lo) * 0.998, far_i - i) AS c1, regr_intercept(0.001 + (v - lo) / (hi - lo) * 0.998, far_i - i) AS c0 FROM x JOIN f USING (k) WHERE i <= far_i GROUP BY 1)
          SELECT k, CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN far_i = u THEN -1 ELSE 1 END AS direction, CAST(f.n - 1 - far_i AS INTEGER) AS start,
                 round(CASE WHEN far_i = f.n - 1 THEN (a - ((hi - lo) * c0 / 0.998 + lo)) / a ELSE (a - v) / a END, 6) AS change, round(c1, 6) AS slope
          FROM f JOIN x USING (k) JOIN l USING (k) WHERE i = far_i""")
def d20_nearest_trend(spark, d):
    from tidemark.operators import iterative

    def one(y):
        direction, start, change, slope = iterative.nearest_trend(y, 0.05, y.min(), y.max())
        return direction, start, round(change, 6), round(slope, 6)

    return iterative.per_key(_monthly(spark, d), ["k"], ["t"], "v", one, "direction int, start int, change double, slope double")


@query(f"WITH {_MONTH}{_TURN.format(far='-1')} SELECT k, round(CASE WHEN u IS NULL AND d IS NULL THEN 0 ELSE a - v END, 2) AS difference FROM f JOIN x USING (k) WHERE i = far_i")
def d21_nearest_diff(spark, d):
    return _arrays(spark, d).select("k", r(series.nearest_difference(F.col("v")), 2).alias("difference"))


#: One step of the resampling of a list to {n} points.
_RESAMPLE = "CASE WHEN len({l}) < {n} THEN list_transform(range(1, 2 * len({l})), lambda i: CASE WHEN i % 2 = 1 THEN {l}[(i + 1) // 2] ELSE ({l}[i // 2] + {l}[i // 2 + 1]) / 2 END) ELSE list_transform(range(1, len({l})), lambda i: ({l}[i] + {l}[i + 1]) / 2) END"


@query(f"""WITH RECURSIVE {_MONTH}, w AS (SELECT k, list(v ORDER BY t) AS l FROM s GROUP BY 1 UNION ALL SELECT k, {_RESAMPLE.format(l="l", n=8)} FROM w WHERE len(l) <> 8 AND len(l) > 1)
          SELECT k, CAST(list_sum(list_transform(range(1, 8), lambda i: CASE WHEN l[i + 1] >= l[i] THEN 1 << (i - 1) ELSE 0 END)) AS INTEGER) AS bits FROM w WHERE len(l) = 8""")
def d22_trend_bits(spark, d):
    from tidemark.operators import iterative

    return iterative.per_key(_monthly(spark, d), ["k"], ["t"], "v", lambda y: iterative.trend_bits(y, 7), "bits int")


@query(f"""WITH RECURSIVE {_PAIR}, w AS (SELECT k, list(a ORDER BY t) AS a, list(b ORDER BY t) AS b FROM s GROUP BY 1 UNION ALL SELECT k, {_RESAMPLE.format(l="a", n=7)}, {_RESAMPLE.format(l="b", n=7)} FROM w WHERE len(a) <> 7 AND len(a) > 1)
          SELECT k, CAST(list_sum(list_transform(range(2, 8), lambda i: CASE WHEN a[i] >= b[i] THEN 1 << (i - 2) ELSE 0 END)) AS INTEGER) AS bits FROM w WHERE len(a) = 7""")
def d23_pair_bits(spark, d):
    from tidemark.operators import iterative

    m = _pairs(spark, d).groupBy("k").agg(series.as_array("a", ["t"]).alias("a"), series.as_array("b", ["t"]).alias("b"))

    def run(batches):
        for pdf in batches:
            pdf["bits"] = [iterative.pair_bits(x, y, 7) for x, y in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[["k", "bits"]]

    return m.mapInPandas(run, "k string, bits int")


def _factor_sql(name: str, sums: str) -> str:
    over, under = (" OR v > a + b + c", " OR v < a + b + c") if sums else ("", "")
    return f"""{name}_d AS (SELECT k, t, CASE WHEN v >= a AND (a > b{over}) THEN 1 WHEN v < a AND (a < b{under}) THEN 0 END AS d FROM g WHERE pos >= 3),
          {name}_n AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS nth FROM {name}_d WHERE d IS NOT NULL QUALIFY nth <= 3),
          {name} AS (SELECT k, CAST(string_agg(d, '' ORDER BY nth) AS INTEGER) + CASE WHEN count(*) = 3 THEN 1000 ELSE 0 END AS code FROM {name}_n GROUP BY 1)"""


@query(f"""WITH {_MONTH}, g AS (SELECT k, t, v, pos, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM s WINDOW w AS (PARTITION BY k ORDER BY t)),
          {_factor_sql("plain", "")}, {_factor_sql("eight", "sums")}, p3 AS (SELECT k, CASE WHEN v >= a THEN 1 ELSE 0 END AS d, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS nth FROM g QUALIFY nth <= 3),
          pair AS (SELECT k, CASE WHEN count(*) < 3 THEN 0 ELSE CAST(string_agg(d, '' ORDER BY nth) AS INTEGER) + 1000 END AS pair FROM p3 GROUP BY 1)
          SELECT DISTINCT s.k, coalesce(plain.code, 0) AS code, coalesce(eight.code, 0) AS eight, pair.pair FROM s LEFT JOIN plain USING (k) LEFT JOIN eight USING (k) LEFT JOIN pair USING (k)""")
def d24_factor_codes(spark, d):
    m = _monthly(spark, d)
    before = m.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    codes = series.factor_codes(m, ["k"], ["t"], "v").join(series.factor_codes(m, ["k"], ["t"], "v", sums=True, out="eight"), "k")
    return codes.join(series.factor_pair(before, ["k"], ["t"], "v", "before", "pair"), "k")


@query("""WITH m AS (SELECT o_custkey, o_orderdate, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
          s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rn FROM m QUALIFY rn <= 3),
          l AS (SELECT o_custkey, v - lead(v) OVER (PARTITION BY o_custkey ORDER BY rn) AS step FROM s)
          SELECT o_custkey, CASE WHEN count(step) = 0 THEN 0 WHEN min(step) > 0 THEN 1 WHEN max(step) < 0 THEN -1 ELSE 0 END AS trend FROM l GROUP BY 1""")
def d25_trend(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    a = lookup.last_rows(o, ["o_custkey"], ["o_orderdate"], 3).groupBy("o_custkey").agg(F.reverse(series.as_array("v", ["o_orderdate"])).alias("v"))
    return a.select("o_custkey", series.trend(F.col("v")).alias("trend"))


@query(f"""WITH {_MONTH}, x AS (SELECT k, v - avg(v) OVER (PARTITION BY k) AS x, row_number() OVER (PARTITION BY k ORDER BY t DESC) - 1 AS i, n FROM s),
          b AS (SELECT k, arg_min(CASE WHEN x > 0 THEN 1 ELSE -1 END, i) AS sign, min(i) AS i0 FROM x WHERE abs(x) > 0.01 GROUP BY 1),
          c AS (SELECT k, max(sign) AS sign, coalesce(min(i) FILTER (i > i0 AND sign * x < 0.01), max(n)) AS c FROM x JOIN b USING (k) GROUP BY 1),
          m2 AS (SELECT k, max(sign) AS sign, max(c) AS c, max(x) FILTER (i = 0) AS x0, max(x) FILTER (i = 1) AS x1, max(x) FILTER (i = c - 1) AS xn FROM x JOIN c USING (k) GROUP BY 1)
          SELECT s.k, CAST(coalesce(max(CASE WHEN c < 3 THEN 0 WHEN sign * ((xn - x0) / (c - 1) - (x1 - x0)) > 0 THEN sign ELSE 2 * sign END), 0) AS INTEGER) AS speed FROM s LEFT JOIN m2 USING (k) GROUP BY 1""")
def d26_speed(spark, d):
    from tidemark.operators import iterative

    return iterative.per_key(_monthly(spark, d), ["k"], ["t"], "v", lambda y: iterative.speed((y - y.mean())[::-1]), "speed int")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
          SELECT user_id, pos AS argmin, value AS least FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, pos) = 1""")
def d27_argmin(spark, d):
    return series.argmin(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("SELECT event_type, count(*) FILTER (value > 100 AND value >= 10) AS above, count(*) FILTER (value < 100 AND value >= 10) AS below FROM events GROUP BY 1")
def d28_threshold_counts(spark, d):
    return series.threshold_counts(table(spark, d, "events"), ["event_type"], "value", 100, 10)


@query("SELECT p0, p1, p2, p3 FROM (VALUES (1), (2), (3)) a(p0), (VALUES (1), (2), (3)) b(p1), (VALUES (1), (2), (3)) c(p2), (VALUES (1), (2), (3)) e(p3)")
def d29_combinations(spark, d):
    return series.combinations(spark, [[1, 2, 3]] * 4)


_RANK = "v AS (SELECT c_nationkey AS k, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"


def _balances(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), "c_custkey")


@query(f"""WITH {_RANK}, a AS (SELECT DISTINCT k, n, unnest([1, 2, 3, 4]) AS nth FROM v), b AS (SELECT k, n, nth, CAST(floor(n * nth / 5.0) AS BIGINT) AS i FROM a)
          SELECT b.k, CAST(nth AS INTEGER) AS nth, round((x.v + y.v) / 2, 6) AS cut FROM b JOIN v x ON x.k = b.k AND x.r = greatest(i - 1, 0) JOIN v y ON y.k = b.k AND y.r = least(i, b.n - 1)""")
def d30_quantile_cuts(spark, d):
    return buckets.quantile_cuts(_balances(spark, d), ["k"], "v", 4).select("k", "nth", r("cut").alias("cut"))


@query("""WITH p AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), s AS (SELECT k, v, round(sum(v) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING), 3) AS c, round(sum(v) OVER (PARTITION BY k), 3) AS t FROM p),
          n AS (SELECT *, unnest([1, 2, 3]) AS nth FROM s) SELECT k, CAST(nth AS INTEGER) AS nth, min(v) AS cut FROM n WHERE c >= t * nth / 4.0 - 0.0001 GROUP BY 1, 2""")
def d31_equal_sum_cuts(spark, d):
    return buckets.equal_sum_cuts(_balances(spark, d).where("v > 0"), ["k"], "v", 3)


_SPLITS = """a AS (SELECT DISTINCT k, n, unnest(range(0, 5)) AS e FROM v), b AS (SELECT a.k, e, v.v + CASE e WHEN 0 THEN -1e-9 WHEN 4 THEN 1e-9 ELSE 0 END AS lo FROM a JOIN v ON v.k = a.k AND v.r = least(CAST(floor(a.n * e / 4.0) AS BIGINT), a.n - 1)),
          c AS (SELECT k, CAST(e + 1 AS INTEGER) AS nth, lo, lead(lo) OVER (PARTITION BY k ORDER BY e) AS hi FROM b)"""


@query(f"WITH {_RANK}, {_SPLITS} SELECT k, nth, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c WHERE nth <= 4")
def d32_equal_count_splits(spark, d):
    return buckets.equal_count_splits(_balances(spark, d), ["k"], "v", 4).select("k", "nth", r("lo").alias("lo"), r("hi").alias("hi"))


_SIGNED = """z AS (SELECT CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS side, c_mktsegment AS k, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment, c_acctbal < 0 ORDER BY c_acctbal) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment, c_acctbal < 0) AS n FROM customer WHERE c_acctbal <> 0),
          a AS (SELECT DISTINCT side, k, n, unnest(range(0, 4)) AS e FROM z), b AS (SELECT a.side, a.k, e, z.v + CASE e WHEN 0 THEN -1e-9 WHEN 3 THEN 1e-9 ELSE 0 END AS lo FROM a JOIN z ON z.side = a.side AND z.k = a.k AND z.r = least(CAST(floor(a.n * e / 3.0) AS BIGINT), a.n - 1)),
          c AS (SELECT side, k, CAST(e + 1 AS INTEGER) AS nth, lo, lead(lo) OVER (PARTITION BY side, k ORDER BY e) AS hi FROM b)"""


def _segments(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_acctbal").alias("v"), "c_custkey")


@query(f"WITH {_SIGNED} SELECT side, k, nth, round(lo, 6) AS lo, round(hi, 6) AS hi FROM c WHERE nth <= 3")
def d33_signed_splits(spark, d):
    return buckets.signed_splits(_segments(spark, d), ["k"], "v", 3).select("side", "k", "nth", r("lo").alias("lo"), r("hi").alias("hi"))


@query("""WITH g AS (SELECT c_nationkey AS k, min(c_acctbal) - 0.001 AS lo, max(c_acctbal) + 0.001 AS hi FROM customer GROUP BY 1), e AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS nth FROM g)
          SELECT k, CAST(nth AS INTEGER) AS nth, round(lo + (hi - lo) / 5 * (nth - 1), 6) AS lo, round(lo + (hi - lo) / 5 * nth, 6) AS hi FROM e""")
def d34_equal_width(spark, d):
    return buckets.equal_width_splits(_balances(spark, d), ["k"], "v", 5).select("k", "nth", r("lo").alias("lo"), r("hi").alias("hi"))


@query(f"""WITH {_SIGNED} SELECT l.k, round(l.lo, 6) AS lower_lo, round(l.hi, 6) AS lower_hi, round(u.lo, 6) AS upper_lo, round(u.hi, 6) AS upper_hi
          FROM (SELECT * FROM c WHERE side = -1 AND nth <= 3) l JOIN (SELECT * FROM c WHERE side = 1 AND nth <= 3) u ON l.k = u.k""")
def d35_two_sided(spark, d):
    s = buckets.signed_splits(_segments(spark, d), ["k"], "v", 3)
    out = buckets.two_sided(s.where("side = -1"), s.where("side = 1"), ["k"])
    return out.select("k", *[r(c).alias(c) for c in ("lower_lo", "lower_hi", "upper_lo", "upper_hi")])


@query(f"""WITH {_SIGNED}, x AS (SELECT c_custkey, c_mktsegment AS k, c_acctbal AS v FROM customer),
          y AS (SELECT x.*, CAST(CASE WHEN v < 0 THEN (SELECT count(*) FROM c WHERE c.k = x.k AND side = -1 AND nth BETWEEN 2 AND 3 AND lo <= v) WHEN v = 0 THEN 3 ELSE 4 + (SELECT count(*) FROM c WHERE c.k = x.k AND side = 1 AND nth BETWEEN 2 AND 3 AND lo <= v) END AS INTEGER) AS bucket FROM x)
          SELECT c_custkey, bucket, row_number() OVER (PARTITION BY k, bucket ORDER BY c_custkey) AS nth FROM y""")
def d36_signed_groups(spark, d):
    return buckets.signed_groups(_segments(spark, d), ["k"], "v", 3, ["c_custkey"]).select("c_custkey", "bucket", "nth")


@query("SELECT p_partkey, CAST(list_sum([ascii(c) % 16 FOR c IN string_split(p_name, '')]) % 16 AS INTEGER) AS bucket FROM part")
def d37_hash_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.hash_bucket(F.col("p_name"), 16).cast("int").alias("bucket"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def d38_record_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, min(value) AS least FROM events GROUP BY 1")
def d39_timing_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"), F.max("value").alias("most"), F.min("value").alias("least"))


_BARS = """SELECT {key}, strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M') AS bucket, arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
          arg_max(value, struct_pack(a := ts, b := event_id)) AS close, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2"""


def _bars(spark, d, key: str, unit: str) -> DataFrame:
    b = rolling.bars(table(spark, d, "events"), [key], "ts", "value", unit, ["event_id"])
    return b.select(key, F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "open", "high", "low", "close", r("total", 4).alias("total"), "n")


@query(_BARS.format(key="event_type", unit="minute"))
def d40_bars_minute(spark, d):
    return _bars(spark, d, "event_type", "1 minute")


@query(_BARS.format(key="user_id", unit="day"))
def d40_bars_day(spark, d):
    return _bars(spark, d, "user_id", "day")


@query("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part")
def d41_distinct(spark, d):
    return table(spark, d, "part").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"))


# ---------------------------------------------------------------- E: windows

_E = "PARTITION BY user_id ORDER BY ts, event_id"
UE = (["user_id"], ["ts", "event_id"])


@query(f"SELECT event_id, round(sum(value) OVER w, 4) AS roll_sum, round(avg(value) OVER w, 6) AS roll_avg, min(value) OVER w AS roll_min, max(value) OVER w AS roll_max FROM events WINDOW w AS ({_E} ROWS 4 PRECEDING)")
def e1_rolling(spark, d):
    x = rolling.rolling(table(spark, d, "events"), *UE, "value", 5)
    return x.select("event_id", r("roll_sum", 4).alias("roll_sum"), r("roll_avg").alias("roll_avg"), "roll_min", "roll_max")


@query(f"SELECT event_id, round(avg(value) OVER ({_E} ROWS 2 PRECEDING), 6) AS last_avg FROM events")
def e2_last_k_avg(spark, d):
    return rolling.last_avg(table(spark, d, "events"), *UE, "value", 3).select("event_id", r("last_avg").alias("last_avg"))


@query(f"""WITH w AS (SELECT event_id, list(value) OVER ({_E} ROWS 19 PRECEDING) AS l FROM events),
          q AS (SELECT event_id, CAST(len(l) AS DOUBLE) AS n, (len(l) - 1) / 2.0 AS e, list_avg(l) AS m, list_transform(range(1, len(l) + 1), lambda i: i - 1 - (len(l) - 1) / 2.0) AS x, l FROM w),
          g AS (SELECT event_id, n, e, m, list_sum([z ** 2 FOR z IN x]) AS s2, list_sum([z ** 4 FOR z IN x]) AS s4, list_sum([z ** 6 FOR z IN x]) AS s6, n AS t0,
                       list_sum(list_transform(l, lambda v, i: v * x[i])) / m AS t1, list_sum(list_transform(l, lambda v, i: v * x[i] ** 2)) / m AS t2, list_sum(list_transform(l, lambda v, i: v * x[i] ** 3)) / m AS t3 FROM q),
          c AS (SELECT *, (t1 * s6 - t3 * s4) / nullif(s2 * s6 - s4 * s4, 0) AS c1, (t3 * s2 - t1 * s4) / nullif(s2 * s6 - s4 * s4, 0) AS c3, (n * t2 - s2 * t0) / nullif(n * s4 - s2 * s2, 0) AS c2 FROM g)
          SELECT event_id, round(CASE WHEN n < 5 OR abs(m) < 1e-7 THEN 0 ELSE 100 * (c1 + 2 * c2 * e + 3 * c3 * e * e) END, 4) AS drift FROM c""")
def e3_rolling_drift(spark, d):
    return rolling.rolling_drift(table(spark, d, "events"), *UE, "value", 20).select("event_id", r("drift", 4).alias("drift"))


@query(f"WITH s AS (SELECT event_id, user_id, ts, abs((value - lag(value) OVER ({_E})) / nullif(value, 0)) AS s FROM events) SELECT event_id, round(avg(s) OVER ({_E} ROWS 9 PRECEDING), 6) AS volatility FROM s")
def e4_volatility(spark, d):
    return rolling.volatility(table(spark, d, "events"), *UE, "value", 10).select("event_id", r("volatility").alias("volatility"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def e5_keep_last_n(spark, d):
    return write.keep_last(table(spark, d, "events"), *UE, 5).select("event_id", "user_id")


@query("WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(0.001 + (value - lo) / (hi - lo) * 0.998, 8) AS norm FROM events JOIN e USING (event_type)")
def e6_minmax_norm(spark, d):
    return rolling.minmax_normalise(table(spark, d, "events"), ["event_type"], "value").select("event_id", r("norm", 8).alias("norm"))


@query("""WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mid FROM events GROUP BY 1)
          SELECT event_id, round(CASE WHEN value >= mid THEN 0.5 + (value - mid) / (hi - mid) * 0.499 ELSE 0.5 - (mid - value) / (mid - lo) * 0.499 END, 8) AS norm FROM events JOIN e USING (event_type)""")
def e7_split_norm(spark, d):
    return rolling.split_normalise(table(spark, d, "events"), ["event_type"], "value").select("event_id", r("norm", 8).alias("norm"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part")
def e8_rank_desc(spark, d):
    return rolling.rank_desc(table(spark, d, "part"), ["p_brand"], "p_size", ["p_partkey"]).select("p_partkey", "rank")


@query(f"""WITH {_SIGNED}, x AS (SELECT c_custkey, c_mktsegment AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 0),
          y AS (SELECT x.*, (SELECT count(*) FROM c WHERE c.k = x.k AND side = -1 AND nth BETWEEN 2 AND 3 AND lo <= v) AS bucket FROM x)
          SELECT k, CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(sum(v), 2) AS total FROM y GROUP BY 1, 2""")
def e9_group_iteration(spark, d):
    g = buckets.signed_groups(_segments(spark, d), ["k"], "v", 3, ["c_custkey"]).where("bucket < 3")
    return g.groupBy("k", "bucket").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey, lag(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS two_back FROM orders")
def e10_offset_prev(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice", 2).over(w).alias("two_back"))


@query("SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER v AS BIGINT) AS quarter, round(percent_rank() OVER w, 8) AS share FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), v AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)")
def e11_builtin_ranks(spark, d):
    """Absent in the surveyed engine; Spark's own."""
    w, v = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(v).cast("long").alias("quarter"), r(F.percent_rank().over(w), 8).alias("share"))


# ---------------------------------------------------------------- F, G: order and sets


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def f1_ordered_dedupe(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("seq"))
    return write.ordered_last(o, "o_custkey", "seq").select("o_custkey", "o_orderkey").orderBy("o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def f2_top_desc(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT event_type, list_sort(list(value))[1:5] AS least5 FROM events GROUP BY 1".replace("list_sort(list(value))[1:5] AS least5", "round(list_sum(list_sort(list(value))[1:5]), 4) AS least5"))
def f3_sorted_values(spark, d):
    low = lookup.first_rows(table(spark, d, "events"), ["event_type"], ["value", "event_id"], 5)
    return low.groupBy("event_type").agg(r(F.sum("value"), 4).alias("least5"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS rn FROM lineitem), lo AS (SELECT l_suppkey, min(l_shipdate) AS lo FROM k WHERE rn <= 4 GROUP BY 1)
          SELECT l_suppkey, count(*) AS n FROM k JOIN lo USING (l_suppkey) WHERE l_shipdate >= lo GROUP BY 1""")
def f5_last_n_with_ties(spark, d):
    return lookup.last_n_values(table(spark, d, "lineitem"), ["l_suppkey"], "l_shipdate", 4).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 4 = 0)")
def f6_append(spark, d):
    o = table(spark, d, "orders")
    return write.append(o, o.where("o_orderkey % 4 = 0")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def f7_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return write.upsert(o.limit(0), o, ["o_custkey", "o_orderdate"], "o_orderkey").select("o_custkey", day("o_orderdate").alias("o_orderdate"), "o_orderkey")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def g1_union_distinct(spark, d):
    return match.union_distinct(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select("r_name"))


@query("SELECT p_partkey FROM part WHERE lower(p_brand) IN (SELECT DISTINCT lower(p_brand) FROM part WHERE p_size < 3)")
def g2_intersect_ci(spark, d):
    p = table(spark, d, "part")
    return match.intersect_ci(p, p.where("p_size < 3").select(F.upper("p_brand").alias("p_brand")), "p_brand").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def g3_key_set_match(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey")


@query("""WITH m AS (SELECT event_id, json_merge_patch('{"a": {"x": 1, "y": {"p": 2}}, "k": -1}', json_merge_patch(props, '{"a": {"y": {"q": "' || event_type || '"}, "z": 3}}')) AS j FROM events)
          SELECT event_id, j ->> '$.k' AS k, j ->> '$.a.x' AS x, j ->> '$.a.y.p' AS p, j ->> '$.a.y.q' AS q, j ->> '$.a.z' AS z FROM m""")
def g4_json_merge(spark, d):
    """Objects within objects are merged at every depth; other values are replaced."""
    patch = F.concat(F.lit('{"a": {"y": {"q": "'), F.col("event_type"), F.lit('"}, "z": 3}}'))
    m = table(spark, d, "events").select("event_id", text.merge_json(F.lit('{"a": {"x": 1, "y": {"p": 2}}, "k": -1}'), text.merge_json("props", patch)).alias("j"))
    return m.select("event_id", *[F.get_json_object("j", path).alias(name) for name, path in (("k", "$.k"), ("x", "$.a.x"), ("p", "$.a.y.p"), ("q", "$.a.y.q"), ("z", "$.a.z"))])


# ---------------------------------------------------------------- H: scalar functions


@query("""SELECT p_partkey, regexp_matches(p_name, '^[0-9]+$') AS num, lower(left(p_name, 3)) = lower(left(p_type, 3)) AS same3, starts_with(lower(p_type), 'sta') AS pre, string_split(p_brand, '#')[1] AS head, string_split(p_brand, '#')[2] AS tail,
          translate(p_brand, '#', '-') AS swapped, upper(p_name) AS up, lower(p_brand) AS low, instr(p_name, 'e') - 1 AS at, len(string_split(p_type, ' ')) AS toks, string_split(p_type, ' ')[2] AS second, regexp_matches(p_name, '[xyz]') AS any_xyz FROM part""")
def h1_strings(spark, d):
    p = table(spark, d, "part")
    c = F.col
    two = strings.divide(c("p_brand"), "#")
    return p.select(
        "p_partkey", strings.is_number(c("p_name")).alias("num"), strings.same_ci(c("p_name"), c("p_type"), 3).alias("same3"), strings.prefix_ci(c("p_type"), "STA").alias("pre"), two[0].alias("head"), two[1].alias("tail"), F.translate("p_brand", "#", "-").alias("swapped"), F.upper("p_name").alias("up"),
        F.lower("p_brand").alias("low"), strings.index_of(c("p_name"), "e").cast("long").alias("at"), strings.token_count(c("p_type"), " ").cast("long").alias("toks"), strings.token(c("p_type"), " ", 1).alias("second"), strings.has_any(c("p_name"), "xyz").alias("any_xyz"),
    )


@query("""SELECT p_partkey, 'f' || p_size AS name, p_brand AS args, CAST(regexp_extract(p_size || ' units', '^[0-9]+') AS BIGINT) AS lead_int,
          CASE WHEN instr(p_name, 'a') > 0 THEN regexp_replace(p_name, 'a', 'A') ELSE '' END AS once, CASE WHEN p_size % 2 = 0 THEN p_partkey || '.SSE' ELSE 'SZ' || p_partkey END AS swapped FROM part""")
def h1_calls_and_affixes(spark, d):
    p = table(spark, d, "part")
    call = strings.call_parts(F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit("("), F.col("p_brand"), F.lit(")")))
    code = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("SH"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".SZE")))
    return p.select("p_partkey", call["name"].alias("name"), call["args"].alias("args"), strings.leading_int(F.concat(F.col("p_size").cast("string"), F.lit(" units"))).alias("lead_int"), strings.replace_first(F.col("p_name"), "a", "A").alias("once"), strings.affix_swap(code, {"SH": "SSE", "SZ": "SZE"}).alias("swapped"))


@query("""SELECT event_id, year(ts) AS y, CAST(strftime(ts, '%Y%m') AS BIGINT) AS ym, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS ymd, CAST(strftime(ts, '%H%M%S') AS BIGINT) AS hms, CAST(strftime(ts, '%H%M') AS BIGINT) AS hm, second(ts) AS s,
          CAST(strftime(ts, '%m%d%H%M') AS BIGINT) AS show, dayofweek(ts) AS wd, month(ts) AS mo, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full FROM events""")
def h2_time_parts(spark, d):
    e, t = table(spark, d, "events"), "ts"
    n = lambda f: F.date_format(t, f).cast("long")
    return e.select("event_id", F.year(t).cast("long").alias("y"), n("yyyyMM").alias("ym"), n("yyyyMMdd").alias("ymd"), timeconv.hhmmss(F.col(t)).cast("long").alias("hms"), timeconv.hhmm(F.col(t)).cast("long").alias("hm"), F.second(t).cast("long").alias("s"), n("MMddHHmm").alias("show"), timeconv.weekday(F.col(t)).cast("long").alias("wd"), F.month(t).cast("long").alias("mo"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("full"))


@query("""WITH t AS (SELECT event_id, ts, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec, hour(ts) * 60 + minute(ts) AS mi FROM events)
          SELECT event_id, CAST(sec AS BIGINT) AS sec, CAST(mi AS BIGINT) AS mi, CAST((mi + 90) // 60 * 100 + (mi + 90) % 60 AS BIGINT) AS later, strftime(CAST(ts AS DATE) + 10, '%Y-%m-%d') AS ten, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS days,
          strftime(CAST(ts AS DATE) + CASE dayofweek(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END, '%Y-%m-%d') AS workday, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS made FROM t""")
def h2_time_arithmetic(spark, d):
    e, t = table(spark, d, "events"), F.col("ts")
    dt = t.cast("date")
    made = timeconv.make_time(timeconv.date_int(t), timeconv.hhmmss(t))
    return e.select("event_id", timeconv.clock_seconds(timeconv.hhmmss(t)).alias("sec"), timeconv.clock_minutes(timeconv.hhmm(t)).alias("mi"), timeconv.shift_hhmm(timeconv.hhmm(t), 90).cast("long").alias("later"), day(F.date_add(dt, 10)).alias("ten"), F.datediff(dt, F.lit("2024-01-01").cast("date")).cast("long").alias("days"), day(timeconv.next_workday(dt)).alias("workday"), F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("made"))


@query("""SELECT event_id, epoch_us(strptime(strftime(ts, '%Y%m%d-%H:%M:%S'), '%Y%m%d-%H:%M:%S')) AS a, epoch_us(strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')) AS b, epoch_us(strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d')) AS c,
          epoch_us(date_trunc('milliseconds', ts)) AS ms, epoch_us(date_trunc('minute', ts)) AS inside FROM events""")
def h2_time_parsers(spark, d):
    p = lambda f: F.unix_micros(F.to_timestamp(F.date_format("ts", f), f))
    return table(spark, d, "events").select("event_id", p("yyyyMMdd-HH:mm:ss").alias("a"), p("yyyyMMddHHmmss").alias("b"), p("yyyy-MM-dd").alias("c"), F.unix_micros(timeconv.parse_ms(F.date_format("ts", "yyyyMMddHHmmssSSS"))).alias("ms"), F.unix_micros(timeconv.embedded_time(F.concat(F.lit("log-7_"), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".txt")))).alias("inside"))


@query("""SELECT c_custkey, greatest(c_acctbal, 100) AS hi, CASE WHEN c_nationkey = 0 THEN 0 ELSE round(c_acctbal / c_nationkey, 6) END AS ratio, floor(c_acctbal * 10 + 0.5) / 10 AS rounded, CAST(floor(c_acctbal / 50) * 50 AS BIGINT) AS down, CAST(ceil(c_acctbal / 50) * 50 AS BIGINT) AS up,
          greatest(0, least(5000, c_acctbal)) AS clamped, CASE WHEN c_custkey < 1 THEN 0 ELSE len(CAST(c_custkey AS VARCHAR)) - 1 END AS digits FROM customer""")
def h3_math(spark, d):
    c, b = table(spark, d, "customer"), F.col("c_acctbal")
    return c.select("c_custkey", numeric.nonzero_max(b, F.lit(100.0)).alias("hi"), r(numeric.safe_divide(b, F.col("c_nationkey").cast("double"))).alias("ratio"), numeric.round_to(b, 10).alias("rounded"), numeric.zoom_down(b, 50).alias("down"), numeric.zoom_up(b, 50).alias("up"), numeric.clamp(b, 0.0, 5000.0).alias("clamped"), numeric.int_log10(F.col("c_custkey")).cast("long").alias("digits"))


@query("SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, CAST((o_orderkey >> 3) & 1 AS INTEGER) AS bit3, o_orderkey & 255 AS low, o_orderkey & ~CAST(4 AS BIGINT) AS cleared FROM orders")
def h3_bits(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.bit_count(k).alias("ones"), F.getbit(k, F.lit(3)).cast("int").alias("bit3"), k.bitwiseAND(F.lit(numeric.low_mask(8)).cast("long")).alias("low"), numeric.remove_bit(k, 2).alias("cleared"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def h4_flatten(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("SELECT event_id, CAST(json_array_length('[' || (props ->> '$.k') || ',2,3]') AS INTEGER) AS n, json_valid(props) AS ok FROM events")
def h5_json_access(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.json_array_length(F.concat(F.lit("["), k, F.lit(",2,3]"))).alias("n"), F.try_parse_json("props").isNotNull().alias("ok"))


@query("SELECT p_partkey, floor(p_retailprice * 100 + 0.5) / 100 AS price2, CASE WHEN p_retailprice * 300000 > 268435455 THEN NULL ELSE floor(p_retailprice * 300000 + 0.5) END AS big FROM part".replace("CASE WHEN p_retailprice * 300000 > 268435455", "CASE WHEN floor(p_retailprice * 300000 + 0.5) > 268435455"))
def h6_price(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", numeric.price(p, 2).alias("price2"), numeric.price(p * 300000, 0).alias("big"))


@query("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS whole, CAST(strftime(o_orderdate, '%Y') AS BIGINT) AS year FROM orders".replace("CAST(o_totalprice AS INTEGER)", "CAST(trunc(o_totalprice) AS INTEGER)"))
def h7_convert(spark, d):
    a = parse("a", {"fields": {"whole": ["F", 8], "date": ["D", 4]}})
    b = parse("b", {"fields": {"whole": ["I", 4], "date": ["D", 4]}})
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("whole"), timeconv.date_int(F.col("o_orderdate")).alias("date"))
    return convert(o, a, b).select("o_orderkey", "whole", timeconv.convert_unit(F.col("date"), "D", "Y").cast("long").alias("year"))


@query("""WITH t AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS m, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS d0, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day FROM events)
          SELECT event_id, s AS ms_s, m AS ms_m, day AS ms_d, s * 1000 + 999 AS s_ms, m * 60000 + 59999 AS m_ms, m * 60 AS m_s, d0 * 1000 + 86399999 AS d_ms, d0 + 86399 AS d_s, (d0 + 86399) // 60 AS d_m, day // 10000 AS d_y FROM t""")
def h8_time_units(spark, d):
    ms = F.floor(micros("ts") / 1000)
    e = table(spark, d, "events").select("event_id", ms.alias("ms"), F.floor(ms / 1000).alias("s"), F.floor(ms / 60000).alias("m"), timeconv.date_int(F.col("ts")).alias("d"))
    cols = [("T", "S", "ms_s"), ("T", "M", "ms_m"), ("T", "D", "ms_d"), ("S", "T", "s_ms"), ("M", "T", "m_ms"), ("M", "S", "m_s"), ("D", "T", "d_ms"), ("D", "S", "d_s"), ("D", "M", "d_m"), ("D", "Y", "d_y")]
    own = {"T": "ms", "S": "s", "M": "m", "D": "d"}
    return e.select("event_id", *[timeconv.convert_unit(F.col(own[a]), a, b).alias(n) for a, b, n in cols])


@query("""SELECT p_partkey, 'http' AS scheme, p_brand || '/x' AS rest, CASE WHEN instr(p_type, 'TIN') = 0 THEN -1 WHEN substr(p_type, instr(p_type, 'TIN') + 3, 1) IN ('', ' ') THEN 0 ELSE 1 END AS tin, p_brand || '-' || p_size AS joined, p_name || chr(10) || p_brand AS line FROM part""")
def h1_lines_and_signs(spark, d):
    p, c = table(spark, d, "part"), F.col
    url = strings.around(F.concat(F.lit("http://"), c("p_brand"), F.lit("/x")), "://")
    text_ = F.concat(F.lit("a\nb\n"), c("p_name"), F.lit("\n"), c("p_brand"), F.lit("\nlast"))
    line = strings.line_around(text_, F.length("p_name") + 6)
    return p.select("p_partkey", url["before"].alias("scheme"), url["after"].alias("rest"), strings.token_match(c("p_type"), "TIN", " ").alias("tin"), strings.merge(F.array("p_brand", c("p_size").cast("string")), "-").alias("joined"), F.substr(line, F.lit(2)).alias("line"))


@query("SELECT event_id, strftime(ts, '%y%m%d%H%M%S') AS stamp, true AS shaped, true AS bounded, event_id % 3 = 2 AS whole FROM events")
def h1_h2_h3_ids_and_draws(spark, d):
    """Identifiers and draws follow from a row's key and a seed; their shape and bounds are compared."""
    c = F.col("event_id")
    stamp, draw = strings.time_id(F.col("ts"), c, 16), numeric.random_int(5, -5, 1, c)
    shaped = stamp.rlike("^[0-9]{12}[A-Z0-9]{4}$") & strings.random_id(c, 8, 2).rlike("^[A-Za-z0-9]{8}$")
    bounded = draw.between(-5, 5) & numeric.random_double(0.5, 1.5, 3, c).between(0.5, 1.5) & numeric.random_score(9, 4, 5, c).between(0, 4)
    return table(spark, d, "events").select("event_id", F.left(stamp, F.lit(12)).alias("stamp"), shaped.alias("shaped"), bounded.alias("bounded"), timeconv.whole_range(c % 3, F.lit(1)).alias("whole"))


@query("SELECT p_partkey, base64(encode(p_name)) AS b64, sha1(p_name) AS digest FROM part")
def h11_h12_codecs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("b64"), F.sha1("p_name").alias("digest"))


# ---------------------------------------------------------------- I: streams, run to their end and compared with SQL


def _stream_root(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names; a local one only on local Spark without any."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-streams-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:10]}"


def _streamed(spark, d, transform, files: str = "events", mode: str = "append", arrivals: list[str] | None = None) -> DataFrame:
    """The result of a stream over a table, in micro-batches until all is read: over its files, or over one
    batch for each of the conditions ``arrivals``, in this order."""
    from tidemark.streaming import stream

    root, schema = _stream_root(spark), table(spark, d, files).schema
    if arrivals is None:
        path = f"{d}/{files}.parquet"
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
        raw = spark.readStream.schema(schema).parquet(path) if folder else spark.readStream.schema(schema).option("pathGlobFilter", f"{files}.parquet").parquet(d)
        return stream.drain(transform(raw), root, mode)
    out = None
    for condition in arrivals:
        table(spark, d, files).where(condition).write.mode("append").parquet(f"{root}/in")
        out = stream.drain(transform(stream.source(spark, f"{root}/in", schema)), root, mode)
    return out


_TWICE = ["event_id % 2 = 0", "event_id % 2 = 1"]  # all rows, in two batches


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (3, 11, 42)")
def i1_subscribe(spark, d):
    from tidemark.streaming import stream

    return _streamed(spark, d, lambda s: stream.subscribe(s, "user_id", "3,11,42").select("event_id", "user_id", "event_type"))


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'cl%' OR event_type LIKE 'pu%'")
def i2_head_subscribe(spark, d):
    from tidemark.streaming import stream

    return _streamed(spark, d, lambda s: stream.subscribe(s, "event_type", "CL,pu", head=True).select("event_id", "event_type"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def i6_publish_known_only(spark, d):
    from tidemark.streaming import stream

    known = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return _streamed(spark, d, lambda s: stream.known_only(s, known, "user_id").select("event_id", "user_id"))


@query("SELECT subscriber, event_id FROM events JOIN (VALUES (1, 'cl'), (2, '*'), (3, 'purchase')) s(subscriber, pattern) ON s.pattern = '*' OR starts_with(event_type, s.pattern)")
def i4_publish_fan_out(spark, d):
    """Rows of a stream, once for each subscriber."""
    told = spark.createDataFrame([(1, "CL"), (2, "*"), (3, "purchase")], "subscriber int, pattern string")
    return _streamed(spark, d, lambda s: match.fan_out(s, "event_type", told).select("subscriber", "event_id"), arrivals=_TWICE)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def i7_microbatch(spark, d):
    return _streamed(spark, d, lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")), mode="complete", arrivals=_TWICE)


@query("""WITH m AS (SELECT 'orders' AS tbl, 0 AS t, epoch_ms(o_orderdate) + 86399999 AS ms, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS seq FROM orders UNION ALL SELECT 'events', 1, CAST(floor(epoch_us(ts) / 1000) AS BIGINT), lpad(CAST(event_id AS VARCHAR), 20, '0') FROM events)
          SELECT tbl, CAST(ms AS BIGINT) AS time_ms, seq FROM m WHERE ms BETWEEN 883612800000 AND 1704931200000""")
def i12_replay(spark, d):
    m = _merged(spark, d).where(F.col("time").between(883612800000, 1704931200000))
    return asof.replay(m).select(F.col("table").alias("tbl"), F.col("time").alias("time_ms"), "seq")


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-08')
          SELECT strftime(day, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS nth, dense_rank() OVER (ORDER BY day) AS nth_day FROM e""")
def i14_multi_day_replay(spark, d):
    """Day after day, each in time order; days without rows are passed over."""
    from tidemark.streaming import stream

    return stream.replay_days(table(spark, d, "events"), "ts", ["event_id"], "2024-01-03", "2024-01-07").select("day", "event_id", "nth", "nth_day")


@query("""WITH late AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), kept AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'
          UNION ALL SELECT * FROM late WHERE ts > (SELECT max(ts) FROM events) - INTERVAL '20 days')
          SELECT event_id FROM kept""")
def i23_watermark_late(spark, d):
    """The second batch holds rows before those of the first: what is more than 20 days late is dropped."""
    from tidemark.streaming import stream

    keep = lambda s: stream.dedupe_late(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "20 days", ["event_id"]).select("event_id")
    return _streamed(spark, d, keep, arrivals=["ts >= timestamp_ntz'2024-01-15'", "ts < timestamp_ntz'2024-01-15'"])


@query("SELECT event_type, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i24_tumbling(spark, d):
    from tidemark.streaming import stream

    w = _streamed(spark, d, lambda s: stream.windowed(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "6 hours"), mode="complete", arrivals=_TWICE)
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n", r("total", 4).alias("total"))


@query("""WITH b AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s FROM events)
          SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY 1, 2""")
def i24_sliding(spark, d):
    from tidemark.streaming import stream

    w = _streamed(spark, d, lambda s: stream.windowed(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "12 hours", "6 hours"), mode="complete", arrivals=_TWICE)
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n", r("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
          SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def i24_session(spark, d):
    from tidemark.streaming import stream

    w = _streamed(spark, d, lambda s: stream.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["user_id"], "2 hours"), mode="complete", arrivals=_TWICE)
    return w.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", r("total", 4).alias("total"))


@query("""WITH w AS (SELECT *, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS b FROM events), p AS (SELECT event_type, b, count(*) AS n FROM w GROUP BY 1, 2)
          SELECT event_type, strftime(make_timestamp(b), '%Y-%m-%d') AS day, n FROM p WHERE b + 86400000000 <= (SELECT epoch_us(max(ts)) - 2 * 86400000000 FROM events)""")
def i24_closed_windows(spark, d):
    """Append mode: only windows that the watermark has passed are given, once each."""
    from tidemark.streaming import stream

    w = _streamed(spark, d, lambda s: stream.windowed(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "1 day", delay="2 days"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


@query(f"WITH l AS (SELECT user_id, list(value ORDER BY ts) FILTER (abs(value) >= 1e-7) AS l FROM events GROUP BY 1) SELECT user_id, CAST(len(l) AS BIGINT) AS n, round({_WARM.format(l='l')}, 6) AS warm_mean FROM l")
def i25_stateful_mean(spark, d):
    """The state of the warm-up mean after two batches: each key's last row."""
    from tidemark.streaming import stream

    halves = ["ts < timestamp_ntz'2024-01-15'", "ts >= timestamp_ntz'2024-01-15'"]
    out = _streamed(spark, d, lambda s: stream.running_mean(s, "user_id", "ts", "value"), mode="update", arrivals=halves)
    return out.groupBy("user_id").agg(F.max("n").alias("n"), r(F.max_by("mean", "n")).alias("warm_mean"))


@query(f"SELECT event_id, round(sum(value) OVER ({_E} ROWS 4 PRECEDING), 6) AS last5 FROM events")
def i25_stateful_rolling(spark, d):
    """Rolling sums over five rows of a key, carried from batch to batch as state."""
    from tidemark.streaming import stream

    halves = ["ts < timestamp_ntz'2024-01-15'", "ts >= timestamp_ntz'2024-01-15'"]
    return _streamed(spark, d, lambda s: stream.rolling_sum(s, "user_id", ["ts", "event_id"], "value", "event_id", 5), arrivals=halves).select("event_id", r("total").alias("last5"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (11, 42) AND event_id % 2 = 1 OR user_id IN (3, 11) AND event_id % 2 = 0")
def i3_resubscribe(spark, d):
    """A second subscription of the same reader replaces the first; ``unsubscribe`` would end it."""
    from tidemark.streaming import stream

    desk = stream.Subscriptions()
    root, schema = _stream_root(spark), table(spark, d, "events").schema
    out = None
    for condition, keys in zip(_TWICE, ("3,11", "11,42"), strict=True):
        desk.subscribe("reader", keys)
        table(spark, d, "events").where(condition).write.mode("append").parquet(f"{root}/in")
        out = stream.drain(desk.apply(stream.source(spark, f"{root}/in", schema), "reader", "user_id").select("event_id", "user_id"), root, "append")
    return out


@query("SELECT event_id, 'live' AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-10 06:00:00' UNION ALL SELECT event_id, 'history' FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-10 06:00:00'")
def i8_start_position(spark, d):
    """A reader that starts after a time: history up to the running day, then live rows."""
    from tidemark.streaming import stream

    return stream.from_position(table(spark, d, "events"), "ts", ntz("2024-01-10 06:00:00"), ntz("2024-01-20")).select("event_id", "kind")


@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS what, epoch_us(ts) AS us, 0 AS step FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20'),
          l AS (SELECT CAST(event_id AS VARCHAR) AS what, epoch_us(ts) AS us, 2 AS step FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'),
          u AS (SELECT * FROM e UNION ALL SELECT 'caught up', NULL, 1 UNION ALL SELECT * FROM l)
          SELECT what, row_number() OVER (ORDER BY step, us, what) AS nth FROM u""")
def i10_catch_up(spark, d):
    """History, a marker that it is complete, then the running day."""
    from tidemark.streaming import stream

    e = table(spark, d, "events")
    return stream.caught_up(e.where("ts >= timestamp_ntz'2024-01-19' AND ts < timestamp_ntz'2024-01-21'"), "ts", "event_id", ntz("2024-01-20")).select("what", "nth")


# ---------------------------------------------------------------- J: user functions


def _vectorised(f, kind: str, gives: type):
    """A pandas function of one column; ``gives`` tells a value per row from one per group."""
    f.__annotations__ = {"v": pd.Series, "return": gives}
    return F.pandas_udf(f, kind)


@query("SELECT event_id, round(value * 1.1 + 1, 6) AS scored FROM events")
def j1_scalar_udf(spark, d):
    scored = _vectorised(lambda v: v * 1.1 + 1, "double", pd.Series)
    spark.udf.register("scored", scored)
    return table(spark, d, "events").select("event_id", r(F.call_function("scored", F.col("value"))).alias("scored"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def j7_udaf(spark, d):
    spread = _vectorised(lambda v: float(v.max() - v.min()), "double", float)
    return table(spark, d, "events").groupBy("event_type").agg(r(spread("value")).alias("spread"))


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS i, substr(n_name, CAST(i + 1 AS INTEGER), 1) AS letter FROM (SELECT *, unnest(range(0, length(n_name))) AS i FROM nation)")
def j7_udtf(spark, d):
    @F.udtf(returnType="i int, letter string")
    class Letters:
        def eval(self, name: str):
            yield from enumerate(name)

    spark.udtf.register("letters", Letters)
    table(spark, d, "nation").createOrReplaceTempView("tidemark_nation")
    return spark.sql("SELECT n_nationkey, i, letter FROM tidemark_nation, LATERAL letters(n_name)")


# ---------------------------------------------------------------- X: Spark's own, absent in the surveyed engine


def _join(how: str, sql_how: str, cols: str):
    sql = f"SELECT {cols} FROM customer c {sql_how} orders o ON c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'BUILDING' AND o.o_totalprice > 150000"

    def f(spark, d):
        c, o = table(spark, d, "customer"), table(spark, d, "orders")
        on = (c.c_custkey == o.o_custkey) & (c.c_mktsegment != "BUILDING") & (o.o_totalprice > 150000)  # both sides have rows without a partner
        return c.join(o, on, how).select(*[x.strip() for x in cols.split(",")])

    f.__name__ = f"x_join_{how}"
    query(sql)(f)


for _how, _sql, _cols in (("inner", "JOIN", "c_custkey, o_orderkey"), ("left", "LEFT JOIN", "c_custkey, o_orderkey"), ("right", "RIGHT JOIN", "c_custkey, o_orderkey"), ("full", "FULL JOIN", "c_custkey, o_orderkey"), ("left_semi", "SEMI JOIN", "c_custkey"), ("left_anti", "ANTI JOIN", "c_custkey")):
    _join(_how, _sql, _cols)


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
def x_join_theta(spark, d):
    """A nation's pairs are dealt over many tasks."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return theta.grid_join(c, s, "c_nationkey", "s_nationkey", F.col("c_acctbal") > F.col("s_acctbal")).select("c_custkey", "s_suppkey")


def _grouped(kind: str, sql_kind: str):
    sql = f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY {sql_kind}"

    def f(spark, d):
        li = table(spark, d, "lineitem")
        aggs = (F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))
        if kind == "grouping_sets":
            flag, status = F.col("l_returnflag"), F.col("l_linestatus")
            return li.groupingSets([[flag], [status], []], flag, status).agg(*aggs).select("l_returnflag", "l_linestatus", "n", "quantity")
        return getattr(li, kind)("l_returnflag", "l_linestatus").agg(*aggs)

    f.__name__ = f"x_{kind}"
    query(sql)(f)


for _kind, _sql in (("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    _grouped(_kind, _sql)


@query("SELECT o_custkey FROM orders WHERE o_totalprice > 1000 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def x_except_all(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_totalprice > 1000").select("o_custkey").exceptAll(o.where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def x_intersect_all(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def x_union_all(spark, d):
    return table(spark, d, "customer").select("c_nationkey").unionAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def x_approx_distinct(spark, d):
    """The estimate lies within three times its error of the exact count.

    Repeats change neither, so both are taken of the distinct pairs: beside a distinct count of the rows, Spark
    would keep a sketch for each pair of type and user."""
    g = table(spark, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.count("user_id").alias("exact"))
    return g.select("event_type", (F.abs(F.col("about") - F.col("exact")) <= 0.06 * F.col("exact") + 1).alias("near"))


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def x_intersect(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS t, arg_max(value, struct_pack(a := ts, b := event_id)) AS close, sum(value) AS total FROM events GROUP BY 1, 2),
          e AS (SELECT event_type, min(close) AS lo, max(close) AS hi FROM d GROUP BY 1)
          SELECT event_type, strftime(t, '%Y-%m-%d') AS day, close, round(total, 4) AS total, round(avg(close) OVER (PARTITION BY event_type ORDER BY t ROWS 4 PRECEDING), 6) AS mean5, round(0.001 + (close - lo) / (hi - lo) * 0.998, 6) AS norm FROM d JOIN e USING (event_type)""")
def flagship_daily_bars(spark, d):
    """Daily bars of each event type, the mean of the last five closes and the normalised close."""
    b = rolling.bars(table(spark, d, "events"), ["event_type"], "ts", "value", "day", ["event_id"])
    b = rolling.last_avg(rolling.minmax_normalise(b, ["event_type"], "close"), ["event_type"], ["bucket"], "close", 5, "mean5")
    return b.select("event_type", day("bucket").alias("day"), "close", r("total", 4).alias("total"), r("mean5").alias("mean5"), r("norm").alias("norm"))
