"""Subqueries and recursive queries."""

from pyspark.sql import functions as F

from basalt.operators.recursive import fixpoint
from basalt.registry import query, shared
from basalt.sources.tables import read

shared("p22_scalar_subquery", "SELECT c_custkey, c_acctbal - (SELECT min(c_acctbal) FROM {customer}) AS above FROM {customer}")
shared("p22_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM {orders} WHERE o_custkey = o.o_custkey)")
shared("p22_correlated_top", "SELECT c_custkey, (SELECT max(o_orderkey) FROM {orders} WHERE o_custkey = c_custkey) AS last_order FROM {customer}")
shared("p23_exists_in_expression", "SELECT n_name, EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey) AS has, n_regionkey = 1 OR EXISTS (SELECT 1 FROM {customer} WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS either FROM {nation}")
shared("s12_recursive_union_all", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 50) SELECT n, a FROM f")
shared("s12_recursive_deep", "WITH RECURSIVE c(n) MAX RECURSION LEVEL 400 AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 300) SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS s FROM c", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 300) SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS s FROM c")


@query("s12_recursive_union", """WITH RECURSIVE edge AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 100 AS b FROM lineitem WHERE l_linenumber < 3),
reach(k) AS (SELECT CAST(3 AS BIGINT) UNION SELECT b FROM reach JOIN edge ON a = k) SELECT CAST(k AS BIGINT) AS k FROM reach""")
def reachable(spark, sf_dir):
    edges = read(spark, sf_dir, "lineitem").where("l_linenumber < 3").selectExpr("l_suppkey AS a", "(l_suppkey * 7 + l_linenumber) % 100 AS b").distinct()
    return fixpoint(spark.range(3, 4).select(F.col("id").alias("k")), lambda r: r.join(edges, F.col("a") == F.col("k")).select("b"))


@query("s17_correlated_table_function", "SELECT p_partkey, CAST(v AS BIGINT) AS v FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1, 5)) AS v FROM part)")
def correlated_series(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    series = F.when(size >= 1, F.sequence(F.lit(1).cast("bigint"), size, F.lit(5).cast("bigint")))  # no rows below 1
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(series).alias("v"))
