"""Changes of tables, and what was changed."""

from pyspark.sql import functions as F

from basalt.operators import changes as C
from basalt.registry import query
from basalt.sources.tables import read

COLUMNS = "c_custkey, c_nationkey, c_acctbal"
#: every customer comes in again, those of odd keys under a new one
CHANGED = "CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS c_custkey, c_nationkey, c_acctbal + 1 AS c_acctbal"


def old(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


def new(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(*CHANGED.split(", "))


OLD = f"o AS (SELECT {COLUMNS} FROM customer), n AS (SELECT {CHANGED} FROM customer)"


@query("d1_insert_or_ignore", f"WITH {OLD} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_or_ignore(spark, sf_dir):
    return C.insert_or_ignore(old(spark, sf_dir), new(spark, sf_dir), ["c_custkey"])


@query("d1_replace", f"WITH {OLD} SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def replace(spark, sf_dir):
    return C.replace(old(spark, sf_dir), new(spark, sf_dir), ["c_custkey"])


@query("d1_insert_select", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, NULL FROM region")
def insert(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as name")
    return C.insert(nation, read(spark, sf_dir, "region").selectExpr("r_regionkey + 100 as k"))


@query("d2_update", f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal < 0 THEN c_nationkey + 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return C.update(table, F.col("c_acctbal") < 0, {"c_nationkey": F.lit(0), "c_acctbal": F.col("c_nationkey").cast("double")})


@query("d2_update_from", "SELECT c_custkey, coalesce(p, 0.0) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_from(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    source = read(spark, sf_dir, "orders").selectExpr("o_custkey as c_custkey", "o_orderkey", "o_totalprice")
    return C.update_from(table, source, ["c_custkey"], {"c_acctbal": F.col("from_o_totalprice")}, ["o_orderkey"])


@query("d3_delete", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def delete(spark, sf_dir):
    left = C.delete(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0)
    big = read(spark, sf_dir, "orders").where("o_totalprice > 300000").selectExpr("o_custkey as c_custkey")
    return C.delete_in(left, big, ["c_custkey"]).select("c_custkey")


@query("d4_upsert", f"""WITH {OLD} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_nationkey, n.c_nationkey) AS c_nationkey,
CASE WHEN o.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NOT NULL AND n.c_acctbal > 3000 THEN o.c_acctbal + n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert(spark, sf_dir):
    values = {"c_acctbal": F.col("c_acctbal") + F.col("excluded_c_acctbal")}
    return C.upsert(old(spark, sf_dir), new(spark, sf_dir), ["c_custkey"], values, F.col("excluded_c_acctbal") > 3000)


@query("d5_returning", f"""WITH {OLD}, v AS (SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)
SELECT coalesce(o.c_custkey, v.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN v.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS change
FROM o FULL JOIN v ON o.c_custkey = v.c_custkey WHERE o.c_custkey IS NULL OR v.c_custkey IS NULL OR o.c_acctbal <> v.c_acctbal""")
def returning(spark, sf_dir):
    """Also the change feed between two versions of a table."""
    a = old(spark, sf_dir)
    b = C.replace(a, new(spark, sf_dir), ["c_custkey"])
    return C.returning(a, b, ["c_custkey"]).select("c_custkey", "change")


@query("d7_constraints", """SELECT 'unique' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'foreign', count(*) FROM orders WHERE o_custkey % 50 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'check', count(*) FROM lineitem WHERE NOT (l_quantity >= 2)""")
def constraints(spark, sf_dir):
    orders, n = read(spark, sf_dir, "orders"), F.count(F.lit(1)).alias("n")
    child = orders.select("o_orderkey", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("o_custkey"))
    parts = {
        "unique": C.violations_unique(orders, ["o_custkey"]),
        "foreign": C.violations_foreign(child, ["o_custkey"], read(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"]),
        "check": C.violations_check(read(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 2),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.agg(n).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out
