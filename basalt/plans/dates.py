"""Dates and times."""

from pyspark.sql import functions as F

from basalt.functions import datetimes as D
from basalt.registry import query, shared
from basalt.sources.tables import read


@query("dt_formats", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, CAST(floor(epoch(ts)) AS BIGINT) AS u, floor(epoch_us(ts) / 1000000) + 210866760000 AS j FROM events")
def formats(spark, sf_dir):
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select("event_id", D.date(ts).alias("d"), D.time(ts).alias("t"), D.datetime(ts).alias("dt"), D.unixepoch(ts).alias("u"), F.floor(F.round(D.julianday(ts) * 86400, 3)).cast("double").alias("j"))


@query("dt_modifiers", """SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(date_trunc('year', ts) + INTERVAL 9 MONTH, '%Y-%m-%d') AS october,
strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later, strftime(ts - INTERVAL 40 DAY, '%Y-%m-%d') AS earlier,
strftime(CAST(ts AS DATE) + CAST((7 + 1 - dayofweek(ts)) % 7 AS INT), '%Y-%m-%d') AS monday, strftime(date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS last_second FROM events""")
def modifiers(spark, sf_dir):
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select(
        "event_id", D.date(ts, "start of month").alias("month"), D.date(ts, "start of year", "+9 months").alias("october"), D.datetime(ts, "+90 minutes").alias("later"),
        D.date(ts, "-40 days").alias("earlier"), D.date(ts, "weekday 1").alias("monday"), D.datetime(ts, "start of day", "+1 day", "-1 second").alias("last_second"),
    )


@query("dt_month_overflow", """SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INT), '%Y-%m-%d') AS rolled,
strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS floored FROM orders""")
def overflow(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.date(d, "+1 month").alias("rolled"), D.date(d, "+1 month", "floor").alias("floored"))


@query("dt_strftime_letters", "SELECT o_orderkey, strftime(o_orderdate, '%j %m %d %u %w %U %W %V %G') AS s, strftime(o_orderdate, '%I:%M %p') AS h FROM orders")
def letters(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.strftime("%j %m %d %u %w %U %W %V %G", d).alias("s"), D.strftime("%I:%M %p", d).alias("h"))


@query("dt_values", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_text, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS from_unix, strftime(ts, '2000-01-01 %H:%M:00') AS time_only FROM events""")
def values(spark, sf_dir):
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select(
        "event_id", D.datetime(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), kind="text").alias("from_text"),
        D.datetime(D.unixepoch(ts), "unixepoch", kind="number").alias("from_unix"), D.datetime(F.date_format(ts, "HH:mm"), kind="text").alias("time_only"),
    )


shared("dt_group_by_month", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY date_trunc('month', o_orderdate)")
shared("dt_extract", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM {orders}")
