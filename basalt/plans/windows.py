"""Window functions and frames."""

from pyspark.sql import functions as F

from basalt.operators import frames
from basalt.operators.frames import UNBOUNDED, Over
from basalt.registry import query, shared
from basalt.sources.tables import read

BASE = "(SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_totalprice / 40000 AS INT) AS band FROM {orders})"

shared("w1_ranking", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr,
round(percent_rank() OVER v, 8) AS pr, round(cume_dist() OVER v, 8) AS cd, ntile(4) OVER w AS nt
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
shared("w2_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lag(o_totalprice, 2, 0.0E0) OVER w AS b, lead(o_orderkey, 1) OVER w AS c FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
shared("w3_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 3) OVER w AS t FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
shared("w4_aggregates_over", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS a FROM {orders}")
shared("w5_order_nulls", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey) AS rn FROM {orders}")
shared("w6_rows_frames", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {orders}")
shared("w7_range_frames", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC RANGE BETWEEN 10.5D PRECEDING AND 0.5D FOLLOWING) AS m FROM {part}", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC RANGE BETWEEN 10.5 PRECEDING AND 0.5 FOLLOWING) AS m FROM {part}")
shared("w10_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM {orders}")
shared("w12_named_windows", "SELECT c_custkey, rank() OVER w AS r, count(*) OVER p AS n FROM {customer} WINDOW p AS (PARTITION BY c_nationkey), w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
shared("w13_over_group", "SELECT o_custkey, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_custkey) AS BIGINT) AS all_n, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS r FROM {orders} GROUP BY o_custkey, o_orderstatus")
shared("w14_distinct_limit_after", "SELECT DISTINCT n FROM (SELECT count(*) OVER (PARTITION BY c_nationkey) AS n FROM {customer}) q ORDER BY n LIMIT 5")
shared("w16_moving_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 2) AS s FROM {events}")


def base(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice", "cast(round(o_totalprice / 40000) as int) AS band")


OVER = Over(("o_custkey",)).refine(("band",))


def frame_query(name, function, unit, start, end, exclude, text):
    duck = f"SELECT o_orderkey, CAST({function}(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY band {text}) AS BIGINT) AS v FROM " + BASE.replace("{orders}", "orders").replace("CAST(o_totalprice / 40000 AS INT)", "CAST(round(o_totalprice / 40000) AS INT)")

    @query(name, duck)
    def run(spark, sf_dir):
        out = frames.with_frame(base(spark, sf_dir), "v", function, F.col("o_orderkey"), OVER, unit, start, end, exclude)
        return out.select("o_orderkey", "v")


frame_query("w8_groups_sum", "sum", "groups", -1, 1, "no others", "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING")
frame_query("w8_groups_following", "count", "groups", 1, 2, "no others", "GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING")
frame_query("w9_exclude_group", "sum", "groups", -UNBOUNDED, 0, "group", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP")
frame_query("w9_exclude_ties", "sum", "groups", -1, UNBOUNDED, "ties", "GROUPS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES")
frame_query("w9_exclude_ties_max", "max", "groups", -2, 2, "ties", "GROUPS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE TIES")
frame_query("w9_exclude_current_row", "sum", "groups", -UNBOUNDED, UNBOUNDED, "current row", "GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW")


def rows_query(name, function, start, end, exclude, text):
    """EXCLUDE GROUP and TIES in ROWS frames; peers have equal values, so their order doesn't show."""
    duck = f"SELECT o_custkey, CAST({function}(band) OVER (PARTITION BY o_custkey ORDER BY band {text}) AS BIGINT) AS v FROM " + BASE.replace("{orders}", "orders").replace("CAST(o_totalprice / 40000 AS INT)", "CAST(round(o_totalprice / 40000) AS INT)")

    @query(name, duck)
    def run(spark, sf_dir):
        out = frames.with_frame(base(spark, sf_dir), "v", function, F.col("band").cast("bigint"), OVER, "rows", start, end, exclude)
        return out.select("o_custkey", "v")


rows_query("w9_rows_exclude_group", "sum", -3, 2, "group", "ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP")
rows_query("w9_rows_exclude_ties", "count", -UNBOUNDED, 1, "ties", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING EXCLUDE TIES")
rows_query("w9_rows_exclude_ties_max", "max", -2, UNBOUNDED, "ties", "ROWS BETWEEN 2 PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES")
rows_query("w9_rows_exclude_group_before", "min", -UNBOUNDED, -2, "group", "ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING EXCLUDE GROUP")
frame_query("w9_exclude_group_count", "count", "groups", -1, 1, "group", "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP")


@query("w9_rows_exclude_current", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS v FROM orders")
def rows_exclude(spark, sf_dir):
    over = Over(("o_custkey",), ("o_orderkey",))
    return frames.with_frame(read(spark, sf_dir, "orders"), "v", "sum", F.col("o_orderkey"), over, "rows", -2, 2, "current row").select("o_orderkey", "v")


@query("w11_window_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER w AS n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_filter(spark, sf_dir):
    w = Over(("o_custkey",), ("o_orderdate", "o_orderkey")).spec()
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.count(frames.filtered(F.lit(1), F.col("o_orderstatus") == "F")).over(w).alias("n"),
        F.max(frames.filtered(F.col("o_totalprice"), F.col("o_orderstatus") == "O")).over(w).alias("m"),
    )


@query("w12_refined_window", "SELECT c_custkey, count(*) OVER p AS n, row_number() OVER (p ORDER BY c_acctbal, c_custkey) AS r FROM customer WINDOW p AS (PARTITION BY c_nationkey)")
def refined(spark, sf_dir):
    p = Over(("c_nationkey",))
    return read(spark, sf_dir, "customer").select("c_custkey", F.count(F.lit(1)).over(p.spec()).alias("n"), F.row_number().over(p.refine(("c_acctbal", "c_custkey")).spec()).alias("r"))


@query("w2_dynamic_offset", "SELECT o_orderkey, lag(o_totalprice, CAST(o_orderkey % 4 AS INT), -1.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders")
def dynamic_offset(spark, sf_dir):
    over = Over(("o_custkey",), ("o_orderkey",))
    return frames.lag_by(read(spark, sf_dir, "orders"), "v", "o_totalprice", F.col("o_orderkey") % 4, over, F.lit(-1.0)).select("o_orderkey", "v")


@query("w3_dynamic_nth", "SELECT o_orderkey, list(o_totalprice ORDER BY o_orderkey) OVER (PARTITION BY o_custkey)[1 + o_orderkey % 3] AS v FROM orders")
def dynamic_nth(spark, sf_dir):
    over = Over(("o_custkey",), ("o_orderkey",))
    return frames.nth_value_by(read(spark, sf_dir, "orders"), "v", "o_totalprice", 1 + F.col("o_orderkey") % 3, over).select("o_orderkey", "v")
