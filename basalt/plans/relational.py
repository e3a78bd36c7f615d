"""Scans, projection, predicates, joins, sorting and set operations."""

from pyspark.sql import functions as F

from basalt.operators import joins
from basalt.registry import query, shared
from basalt.sources.series import series
from basalt.sources.tables import read

# --- workloads over the star schema

shared(
    "tpch_q3_top_revenue",
    """SELECT o.o_orderkey AS l_orderkey, o.o_orderdate, o.o_orderpriority,
       round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate > TIMESTAMP '1998-03-15 00:00:00' AND o.o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND c.c_mktsegment = 'BUILDING'
GROUP BY o.o_orderkey, o.o_orderdate, o.o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
shared(
    "tpch_q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
shared(
    "tpch_q5_local_revenue",
    """SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey
JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
shared(
    "tpch_q10_returned",
    """SELECT c.c_custkey, c.c_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM {lineitem} l JOIN {orders} o USING_KEY JOIN {customer} c ON c.c_custkey = o.o_custkey
WHERE l.l_returnflag = 'R' GROUP BY c.c_custkey, c.c_name ORDER BY revenue DESC, c_custkey LIMIT 20""".replace("USING_KEY", "ON o.o_orderkey = l.l_orderkey"),
)
shared(
    "tpch_q11_important_suppliers",
    """WITH v AS (SELECT l_suppkey AS k, sum(l_extendedprice * l_discount) AS value FROM {lineitem} GROUP BY l_suppkey)
SELECT k, round(value, 2) AS value FROM v WHERE value > (SELECT sum(value) * 0.0105 FROM v)""",
)
shared(
    "tpch_q4_priority_check",
    """SELECT o.o_orderpriority, count(*) AS n FROM {orders} o WHERE o.o_orderdate >= TIMESTAMP '1997-07-01 00:00:00'
AND o.o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate) GROUP BY o.o_orderpriority""",
)
shared(
    "tpch_q21_waiting_suppliers",
    """SELECT s.s_suppkey, count(*) AS numwait FROM {supplier} s JOIN {lineitem} a ON a.l_suppkey = s.s_suppkey
WHERE a.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM {lineitem} d WHERE d.l_orderkey = a.l_orderkey AND d.l_suppkey <> a.l_suppkey AND d.l_returnflag = 'R')
GROUP BY s.s_suppkey ORDER BY numwait DESC, s_suppkey LIMIT 10""",
)
shared("order_totals_by_alias", "SELECT o_orderkey AS k, round(sum(l_extendedprice), 2) AS total FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey ORDER BY total, k LIMIT 15")

# --- scans

shared("s1_full_scan", "SELECT * FROM {nation}")
shared("s3_column_pruning", "SELECT c_custkey, c_mktsegment FROM {customer}")
shared("s4_point_and_set_seek", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 42 OR o_orderkey IN (7, 99, 1000, 123456)")
shared("s5_equality_filter", "SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
shared("s6_range_filter", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-01-31 00:00:00' AND l_quantity < 5")
shared("s8_ordered_scan", "SELECT p_partkey, p_name FROM {part} ORDER BY p_partkey DESC LIMIT 25")
shared("s9_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
shared("s10_no_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, CAST(NULL AS INT) AS nothing")
shared("s11_derived_view_cte", "WITH rich AS (SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 5000) SELECT n_name, count(*) AS n FROM (SELECT * FROM rich) r JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name")


@query("s13_generate_series", "SELECT CAST(value AS BIGINT) AS value FROM (SELECT unnest(range(1, 51, 7)) AS value UNION ALL SELECT unnest(range(20, -1, -5)))")
def generate_series(spark, sf_dir):
    return series(spark, 1, 50, 7).unionAll(series(spark, 20, 0, -5))


@query("s7_repeated_probe", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey")
def repeated_probe(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(big, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"))


# --- projection and predicates

shared("p1_projection_star", "SELECT n.*, n_nationkey * 2 AS twice, upper(n_name) AS loud FROM {nation} n")
shared("p2_three_valued_filter", "SELECT o_orderkey FROM {orders} WHERE NOT (nullif(o_orderstatus, 'P') = 'F') AND o_totalprice > 300000")
shared("p2_truthiness", "SELECT p_partkey FROM {part} WHERE p_size - 10 <> 0 AND p_size < 12")
shared("p10_is_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F' AS d, nullif(o_orderstatus, 'P') IS NULL AS nul, (nullif(o_orderstatus, 'P') = 'O') IS TRUE AS t FROM {orders}")
shared("p11_between", "SELECT count(*) AS n FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity NOT BETWEEN 10 AND 40")
shared("p12_in_list", "SELECT p_brand, count(*) AS n FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#17', 'Brand#25') AND p_size NOT IN (1, 2, 3) GROUP BY p_brand")
shared("p13_in_subquery", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 450000)")
shared("p13_not_in_with_nulls", "SELECT count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey > 10 THEN o_custkey END FROM {orders})")
shared("p13_row_value_in", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_suppkey) IN (SELECT o_orderkey, o_custkey % 10 FROM {orders})")
shared("p18_case_iif", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS s, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS c FROM {orders}")
shared("p21_row_value_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey > 7000 OR (l_orderkey = 7000 AND l_linenumber >= 2)")
shared("p24_literals", "SELECT 31 AS hexed, 1000000 AS grouped, 1.5e3 AS realed, 'it''s' AS quoted")


@query("p24_parameters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000.0")
def parameters(spark, sf_dir):
    return spark.sql("SELECT c_custkey FROM {t} WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "MACHINERY", "least": 9000.0}, t=read(spark, sf_dir, "customer"))


# --- joins

shared("j1_inner_comma_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a, {nation} b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
shared("j2_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
shared("j3_left_on_vs_where", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE c_nationkey = 5")
shared("j4_right", "SELECT s_suppkey, n_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey")
shared("j5_full", "SELECT a.c_custkey AS a, b.o_custkey AS b, b.n FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS k FROM {customer}) a FULL JOIN (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) b ON a.k = b.k")
shared("j6_using_coalesced", "SELECT k, x, y FROM (SELECT c_custkey AS k, c_nationkey AS x FROM {customer}) a FULL JOIN (SELECT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS k, max(o_orderkey) AS y FROM {orders} GROUP BY o_custkey) b USING (k)")
shared("j6_natural", "SELECT n_nationkey, n_name, s FROM {nation} NATURAL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM {supplier} GROUP BY s_nationkey) q")
shared("j8_nested_group", "SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN ({nation} JOIN {region} ON n_regionkey = r_regionkey AND r_regionkey < 3) ON c_nationkey = n_nationkey")
shared("j9_self_n_way", "SELECT a.l_orderkey, count(*) AS n FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber JOIN {orders} ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' GROUP BY a.l_orderkey")
shared("j10_aggregate_over_join", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY p_brand")
shared("j13_semi_exists", "SELECT count(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o.o_orderkey AND l_quantity > 48)")
shared("j14_anti_not_exists", "SELECT count(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c.c_custkey AND o_totalprice > 100000)")
shared("j18_row_value_keys", "SELECT count(*) AS n FROM {lineitem} a JOIN {lineitem} b ON (a.l_orderkey, a.l_linenumber) = (b.l_orderkey, b.l_linenumber)", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
shared("j16_lateral_function", "SELECT n_nationkey, v FROM {nation} LEFT JOIN LATERAL (SELECT explode(sequence(1, n_nationkey)) AS v) t ON v > 22 WHERE n_nationkey > 20", "SELECT n_nationkey, CAST(v AS INT) AS v FROM nation LEFT JOIN LATERAL (SELECT unnest(range(1, n_nationkey + 1)) AS v) t ON v > 22 WHERE n_nationkey > 20")


@query("j15_or_join", "SELECT count(*) AS n, sum(c_custkey) AS s FROM customer JOIN supplier ON c_custkey = s_suppkey * 11 OR c_acctbal = s_acctbal OR c_custkey = s_suppkey + 7")
def or_join(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    arms = [(F.col("c_custkey"), F.col("s_suppkey") * 11), (F.col("c_acctbal"), F.col("s_acctbal")), (F.col("c_custkey"), F.col("s_suppkey") + 7)]
    return joins.or_join(c, s, arms).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))


@query("j17_range_join", """SELECT r.lo, count(*) AS n FROM (SELECT c_custkey, c_acctbal AS lo, c_acctbal + 20 AS hi FROM customer) r
JOIN orders ON o_totalprice / 50 BETWEEN r.lo AND r.hi GROUP BY r.lo""")
def range_join(spark, sf_dir):
    spans = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS lo", "c_acctbal + 20 AS hi")
    points = read(spark, sf_dir, "orders").selectExpr("o_totalprice / 50 AS x")
    return joins.range_counts(points, spans, "x", "lo", "hi", width=100.0).groupBy("lo").agg(F.sum("n").alias("n"))


@query("j19_cross_database", "SELECT a.n_name, count(*) AS n FROM nation a JOIN customer ON c_nationkey = a.n_nationkey GROUP BY a.n_name")
def cross_database(spark, sf_dir):
    """Two folders are two databases; here both are the same one."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer").select("c_nationkey")
    return n.join(c, n.n_nationkey == c.c_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


# --- sorting and limits

shared("o1_order_nulls", "SELECT k, v FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS v FROM {orders}) q ORDER BY v DESC NULLS FIRST, k LIMIT 40")
shared("o3_top_k_offset", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5")


@query("o4_limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT count(*) FROM nation)")
def limit_subquery(spark, sf_dir):
    n = read(spark, sf_dir, "nation").count()  # the limit is one number, known before the plan
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n).select("o_orderkey")


# --- set operations

shared("u1_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
shared("u2_union", "SELECT nullif(c_nationkey, 3) AS k FROM {customer} UNION SELECT nullif(s_nationkey, 3) FROM {supplier}")
shared("u3_intersect", "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer} WHERE c_acctbal > 8000")
shared("u4_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
shared("u5_left_associative", "(SELECT 1 AS k UNION SELECT 2) INTERSECT SELECT 2")
shared("u6_compound_order_limit", "SELECT k FROM (SELECT o_orderkey AS k FROM {orders} UNION SELECT l_partkey FROM {lineitem}) q ORDER BY k DESC LIMIT 12")


@query("u5_chained_compound", "SELECT k FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT 99) EXCEPT SELECT CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END FROM supplier) INTERSECT (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def chained(spark, sf_dir):
    from basalt.operators.sets import compound

    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = read(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END")
    n = read(spark, sf_dir, "nation").where("n_regionkey <> 1").select("n_nationkey")
    return compound(c, ("union", spark.sql("SELECT 99")), ("except", s), ("intersect", n))


# --- kernel shapes

shared("k_filtered_count_sum", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM {lineitem} WHERE l_quantity > 30 AND l_discount < 0.05")
shared("k_like_count", "SELECT count(*) AS n FROM {part} WHERE p_name LIKE '%widget%'")
shared("k_distinct_column", "SELECT DISTINCT l_suppkey FROM {lineitem}")
shared("k_count_union_all", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM {orders} UNION ALL SELECT l_orderkey FROM {lineitem}) q")
shared("k_series_pair", "SELECT count(*) AS n, sum(a.id * b.id) AS s FROM range(200) a JOIN range(100) b ON a.id > b.id", "SELECT count(*) AS n, CAST(sum(a.range * b.range) AS BIGINT) AS s FROM range(200) a JOIN range(100) b ON a.range > b.range")
