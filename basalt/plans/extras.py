"""Catalog rows, sinks, event time and grouping sets."""

from pyspark.sql import functions as F

from basalt.functions import datetimes as D
from basalt.operators import joins
from basalt.registry import query, shared
from basalt.sources import catalog
from basalt.sources.tables import read
from basalt.streaming import windows


@query("s15_table_info", """SELECT * FROM (VALUES (0, 'n_nationkey', 'int', 0), (1, 'n_name', 'string', 0), (2, 'n_regionkey', 'int', 0)) t(cid, name, type, "notnull")""")
def table_info(spark, sf_dir):
    return catalog.table_info(spark, sf_dir, "nation")


@query("s16_schema_rows", "SELECT 'table' AS type, unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS name")
def schema_rows(spark, sf_dir):
    return catalog.schema_rows(spark, sf_dir).select("type", "name")


@query("dt_timediff", "SELECT o_orderkey, '+0000-00-' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 2, '0') || ' 01:02:03.000' AS d FROM orders")
def timediff(spark, sf_dir):
    day = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    later = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (F.col("o_orderkey") % 20 * 86400 + 3723) * 1_000_000).cast("timestamp_ntz")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.timediff(later, day).alias("d"))


@query("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    out = windows.windowed(read(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("events_sliding", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INT)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def sliding(spark, sf_dir):
    out = windows.windowed(read(spark, sf_dir, "events"), "ts", "2 hours", [], [F.count(F.lit(1)).alias("n")], slide="1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("events_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    out = windows.sessions(read(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("events_as_of_join", "SELECT a.event_id, b.value AS price FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'view'")
def as_of(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    prices = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("price"))
    return joins.as_of_join(views, prices, "user_id", "ts", "at", "price").select("event_id", "price")


shared("x_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
       "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS TINYINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
shared("x_rollup", "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS s FROM {customer} GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
shared("x_cube", "SELECT p_brand, p_size > 25 AS big, count(*) AS n FROM {part} GROUP BY CUBE (p_brand, p_size > 25)", "SELECT p_brand, big, count(*) AS n FROM (SELECT p_brand, p_size > 25 AS big FROM part) GROUP BY CUBE (p_brand, big)")
shared("x_median", "SELECT p_brand, median(p_retailprice) AS m FROM {part} GROUP BY p_brand")
shared("x_lateral_top", "SELECT n_nationkey, c_custkey FROM {nation}, LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t",
       "SELECT c_nationkey AS n_nationkey, arg_max(c_custkey, struct_pack(a := c_acctbal, k := -c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
