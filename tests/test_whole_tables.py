"""Queries read the whole of their tables: none drops most of its input by a filter on ids."""

import pytest

import basalt.registry as registry
from basalt.sources.tables import read

QUERIES = registry.queries()
#: large enough that the filters on ids of earlier versions drop rows
FOLDER = "/root/testdata/sf0.01"


def keys(spark, table, key):
    return sorted(r[0] for r in read(spark, FOLDER, table).select(key).collect())


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize(
    "name",
    "w1_ranking w8_groups_sum w8_groups_following w9_exclude_group w9_exclude_ties w9_exclude_ties_max w9_exclude_current_row w9_exclude_group_count".split(),
)
def test_windows_cover_all_orders(spark, name):
    assert sorted(r.o_orderkey for r in run(spark, name)) == keys(spark, "orders", "o_orderkey")


@pytest.mark.parametrize("name", "json_extract json_type_length_valid json_edits json_build s14_json_each s14_json_tree".split())
def test_json_covers_all_events(spark, name):
    got = sorted(r.event_id for r in run(spark, name))
    each = 3 if name == "s14_json_each" else 1
    assert got == sorted(keys(spark, "events", "event_id") * each)


@pytest.mark.parametrize("name", ["p10_is_distinct_from", "p18_case_iif"])
def test_predicates_cover_all_orders(spark, name):
    assert sorted(r.o_orderkey for r in run(spark, name)) == keys(spark, "orders", "o_orderkey")


def test_full_joins_keep_all_rows_of_both_sides(spark):
    customers, theirs = set(keys(spark, "customer", "c_custkey")), keys(spark, "orders", "o_custkey")
    rows = run(spark, "j5_full")
    assert sorted(r.a for r in rows if r.a is not None) == sorted(customers)
    assert {r.b for r in rows} - {None} == set(theirs) and sum(r.n or 0 for r in rows) == len(theirs)
    both = {r.a for r in rows if r.a is not None and r.b is not None}
    assert both == {k for k in customers & set(theirs) if k % 3 and k % 2 == 0}
    rows = {r.k: r for r in run(spark, "j6_using_coalesced")}
    moved = {-k if k % 7 == 0 else k for k in theirs}
    assert set(rows) == customers | moved
    assert all((r.x is not None) == (k in customers) and (r.y is not None) == (k in moved) for k, r in rows.items())


def test_range_join_takes_all_ranges(spark):
    lows = keys(spark, "customer", "c_acctbal")
    points = [x / 50 for x in keys(spark, "orders", "o_totalprice")]
    want = {}
    for lo in lows:
        n = sum(lo <= x <= lo + 20 for x in points)
        if n:
            want[lo] = want.get(lo, 0) + n
    assert {r.lo: r.n for r in run(spark, "j17_range_join")} == want


def test_chained_compound_takes_all_suppliers(spark):
    suppliers = {k for k in keys(spark, "supplier", "s_nationkey") if k % 3}
    nations = {r.n_nationkey for r in read(spark, FOLDER, "nation").where("n_regionkey <> 1").collect()}
    assert {r.k for r in run(spark, "u5_chained_compound")} == (set(keys(spark, "customer", "c_nationkey")) - suppliers) & nations


@pytest.mark.parametrize(
    ("name", "table", "key"),
    [("f_control", "orders", "o_orderkey"), ("p8_concat_null", "orders", "o_orderkey"), ("p22_scalar_subquery", "customer", "c_custkey")],
)
def test_expressions_cover_whole_tables(spark, name, table, key):
    assert sorted(r[key] for r in run(spark, name)) == keys(spark, table, key)


def test_correlated_series_covers_all_parts(spark, tmp_path):
    want = sorted((r.p_partkey, v) for r in read(spark, FOLDER, "part").collect() for v in range(1, (r.p_size or 0) + 1, 5))
    assert sorted(map(tuple, run(spark, "s17_correlated_table_function"))) == want
    rows = [(1, 0), (2, None), (3, -4), (4, 6)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["s17_correlated_table_function"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(4, 1), (4, 6)]


def test_changes_apply_to_all_customers(spark):
    old = set(keys(spark, "customer", "c_custkey"))
    added = {-k for k in old if k % 2}
    for name in ("d1_insert_or_ignore", "d1_replace", "d4_upsert"):
        assert sorted(r.c_custkey for r in run(spark, name)) == sorted(old | added)
    want = [*((k, "insert") for k in added), *((k, "update") for k in old if k % 2 == 0)]
    assert sorted(map(tuple, run(spark, "d5_returning"))) == sorted(want)
