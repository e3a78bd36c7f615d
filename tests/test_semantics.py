"""Rules that the tables don't exercise: nulls, ties, empty inputs, dialect rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from basalt import registry
from basalt.functions import datetimes as D
from basalt.functions import numeric as N
from basalt.functions import text as T
from basalt.operators import changes, joins, textsearch, vectors
from basalt.operators.recursive import fixpoint
from basalt.operators.sets import compound
from basalt.sources.catalog import create_as
from basalt.sources.series import series
from basalt.streaming import windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("build", "want"),
    [
        (lambda: N.int_div(F.lit(-7), F.lit(2)), -3),
        (lambda: N.int_div(F.lit(7), F.lit(0)), None),
        (lambda: N.mod(F.lit(-7), F.lit(3)), -1),
        (lambda: N.add(F.lit(2**63 - 1), F.lit(1)), float(2**63)),
        (lambda: N.text_to_integer(F.lit("123abc")), 123),
        (lambda: N.text_to_integer(F.lit("abc")), 0),
        (lambda: N.text_to_real(F.lit(" 1.5e2x")), 150.0),
        (lambda: N.scalar_min(F.lit(1), F.lit(None).cast("int")), None),
        (lambda: N.log(F.lit(1000)), 3.0),
        (lambda: N.domain("acos", F.lit(2)), None),
        (lambda: N.shift_left(F.lit(1), F.lit(64)), 0),
        (lambda: N.shift_right(F.lit(-8), F.lit(1)), -4),
        (lambda: T.substr(F.lit("hello"), F.lit(0), F.lit(3)), "he"),
        (lambda: T.substr(F.lit("hello"), F.lit(-3), F.lit(2)), "ll"),
        (lambda: T.like(F.lit("ABC"), "a_c"), True),
        (lambda: T.glob(F.lit("abc"), "a[^x]c"), True),
        (lambda: T.trim(F.lit("xxhixx"), "x"), "hi"),
        (lambda: T.upper(F.lit("aé")), "Aé"),
        (lambda: T.quote(F.lit("it's"), "string"), "'it''s'"),
        (lambda: D.date(F.lit("2024-01-31"), "+1 month", kind="text"), "2024-03-02"),
        (lambda: D.date(F.lit("2024-01-31"), "+1 month", "floor", kind="text"), "2024-02-29"),
        (lambda: D.date(F.lit("2024-01-31"), "no such", kind="text"), None),
        (lambda: D.julianday(F.lit("2000-01-01 12:00"), kind="text"), 2451545.0),
    ],
)
def test_scalar_rules(spark, build, want):
    got = value(spark, build())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_printf():
    assert T.format_text("%5.1f|%-4d|%+d|%Q|%%", [2.25, 7, 3, "a'b"]) == "  2.2|7   |+3|'a''b'|%"


def test_series_limits(spark):
    assert [r.value for r in series(spark, 5, 1, -2).collect()] == [5, 3, 1]
    assert series(spark, None, 3).count() == 0
    assert series(spark, 1, 3, 0).count() == 3


def test_fixpoint_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9)], "a long, b long")
    got = fixpoint(spark.createDataFrame([(1,)], "k long"), lambda r: r.join(edges, F.col("a") == F.col("k")).select("b"))
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]


def test_compound_is_left_associative(spark):
    one = lambda x: spark.createDataFrame([(x,)], "k int")
    assert [r.k for r in compound(one(1), ("union", one(2)), ("intersect", one(2))).collect()] == [2]
    nulls = spark.createDataFrame([(None,), (None,)], "k int")
    assert compound(nulls, ("union", nulls)).count() == 1


def test_upsert_with_nulls_and_empty_tables(spark):
    schema = "k int, v int"
    old, new = spark.createDataFrame([(1, 1), (2, None)], schema), spark.createDataFrame([(2, 5), (3, 6)], schema)
    got = changes.upsert(old, new, ["k"], {"v": F.col("excluded_v")})
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 5), (3, 6)]
    empty = spark.createDataFrame([], schema)
    assert sorted(map(tuple, changes.upsert(empty, new, ["k"], {}).collect())) == [(2, 5), (3, 6)]
    assert changes.upsert(empty, empty, ["k"], {}).count() == 0
    log = changes.returning(old, got, ["k"])
    assert {(r.k, r.change) for r in log.collect()} == {(2, "update"), (3, "insert")}


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "One two, two three"), (2, ""), (3, None), (4, "two one")], "d long, t string")
    p = textsearch.index(docs, "d", "t")
    hits = lambda q: sorted(r.doc for r in textsearch.match(p, q).collect())
    assert hits('"two three"') == [1]
    assert hits("one NOT three") == [4]
    assert hits("NEAR(one three, 1)") == []
    assert hits("NEAR(one three, 2)") == [1]
    assert hits("thr* OR four") == [1]
    with pytest.raises(ValueError):
        textsearch.match(p, "(one")
    assert textsearch.vocabulary(p).where("term = 'two'").first()[1:] == (2, 3)


def test_nearest_join_matches_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8)).astype("float32")
    x[7] = x[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i long, v array<float>").repartition(3)
    got = vectors.nearest_join(rows, rows.where("i < 10"), "i", "v", 3).collect()
    for q in range(10):
        d = [(float(np.sqrt(((x[q].astype(float) - x[j]) ** 2).sum())), j) for j in range(60) if j != q]
        assert [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.query == q] == [j for _, j in sorted(d)[:3]]


def test_recall_of_cells(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = (r.normal(size=(8, 16))[r.integers(0, 8, 400)] * 3 + r.normal(size=(400, 16))).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<float>")
    centres = vectors.cells(rows, "v", "i", 8)
    indexed = vectors.with_cell(rows, "v", centres).cache()
    assert indexed.where("cell is null").isEmpty()
    hits = 0
    for q in range(0, 50, 10):
        near = {t.i for t in vectors.nearest_in_cells(indexed, "v", x[q].tolist(), 10, centres, 4, "i").collect()}
        want = np.argsort(((x - x[q]) ** 2).sum(1))[:10]
        hits += len(near & set(want.tolist()))
    assert hits >= 45


def test_recall_of_cells_on_embeddings(spark):
    """The registered query's cells and probes, for every id divisible by 100."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    table = rows.where("embedding is not null").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    centres = vectors.cells(rows, "embedding", "vec_id", 16)
    indexed = vectors.with_cell(rows, "embedding", centres).cache()
    hits, queries = 0, [i for i in range(len(ids)) if ids[i] % 100 == 0]
    for i in queries:
        near = [t.vec_id for t in vectors.nearest_in_cells(indexed, "embedding", x[i].tolist(), 10, centres, 8, "vec_id").collect()]
        assert len(near) == len(set(near)) == 10
        hits += len(set(near) & set(ids[np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10]].tolist()))
    indexed.unpersist()
    assert hits >= 0.9 * 10 * len(queries)


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, at + datetime.timedelta(minutes=7 * i), float(i)) for i in range(40)]
    table = create_as(spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double"), str(tmp_path / "t"))
    totals = [F.sum("v").alias("s")]
    want = {tuple(r) for r in windows.windowed(table, "ts", "1 hour", ["k"], totals).collect()}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "t"))
    out = windows.windowed(stream, "ts", "1 hour", ["k"], totals, watermark="1 hour")
    run = out.writeStream.format("memory").queryName("windows_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("windows_out").collect()} == want


def test_search_over_rows_agrees_with_postings(spark):
    docs = spark.createDataFrame(
        [(1, "one two three", "alpha"), (2, "two one", None), (3, "", "one"), (4, None, "two two"), (5, "three one two one", "beta two"), (6, "two x x two", "")], "d long, t string, u string"
    )
    p, r = textsearch.index(docs, "d", "t"), textsearch.rows(docs, "d", "t")
    for q in ['one', '"one two"', 'NEAR(one two, 1)', 'NEAR(two two, 2)', 'NEAR(two two, 1)', 't*', '"three o*"', '^two', 'one NOT three', '(x OR three) two', '^t* NOT x']:
        assert sorted(x.doc for x in textsearch.match(p, q).collect()) == sorted(x.doc for x in textsearch.match(r, q).collect()), q
    both = textsearch.rows(docs, "d", "t", "u")
    hits = lambda q: sorted(x.doc for x in textsearch.match(both, q).collect())
    assert hits("u : two") == [4, 5]
    assert hits("- u : two") == [1, 2, 5, 6]
    assert hits('{t u} : "two two"') == [4]
    assert hits("u : (one OR alpha) NOT t : three") == [3]
    with pytest.raises(ValueError):
        textsearch.match(both, "none : two")


def test_bare_columns_of_ties_come_from_the_first_order(spark, tmp_path):
    """Equal prices: the least key; nulls are passed over, a customer without prices has none."""
    rows = [(3, 1, 9.5, "c"), (1, 1, 9.5, "a"), (2, 1, 9.5, "b"), (4, 1, 1.0, "d"), (5, 2, None, "e"), (6, 3, 2.0, None), (7, 3, 1.0, "g"), (9, 4, 0.0, "i"), (8, 4, -0.0, "h")]
    for n in (1, 3):
        folder = str(tmp_path / str(n))
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").repartition(n).write.parquet(folder + "/orders.parquet")
        got = registry.queries()["a13_bare_columns"](spark, folder).collect()
        assert sorted(map(tuple, got)) == [(1, 9.5, 1, "a"), (2, None, None, None), (3, 2.0, 6, "g"), (4, 0.0, 8, "h")]


def test_printf_keeps_the_sign_of_zero_and_takes_nulls_as_its_sql_does(spark, tmp_path):
    import duckdb

    rows = [(1, "a", -0.0), (2, "b", 0.0), (3, "c", -0.001), (4, None, 1.0), (5, "d", None), (None, "e", 2.0), (6, "", float("nan")), (-7, "f", float("-inf")), (2**40, "%s", 0.125)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got = registry.queries()["f_printf"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(registry.oracle_sql()["f_printf"]).fetchall(), key=repr)
    assert T.format_text("%.1f|%+.0f|%d|%x", [-0.0, -0.0, float("nan"), 2.7]) == "-0.0|-0|0|2"


def test_range_counts_make_no_pairs_and_match_sql(spark, tmp_path):
    """Ends that meet points, repeated rows, nulls, NaN, infinite and signed zero bounds; 4 million pairs of one span are a number."""
    import duckdb

    nan, inf = float("nan"), float("inf")
    lows = [0.0, -0.0, 0.0, 100.0, 99.99, 80.0, -20.0, -20.5, 1e17, -1e17, None, nan, inf, -inf, 555.0]
    prices = [0.0, -0.0, 5000.0, 5000.0, 1000.0, 4999.5, 5e18, -1000.0, -5e18, None, nan, inf, -inf, 6000.0]
    spark.createDataFrame([(i, x) for i, x in enumerate(lows)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(x,) for x in prices], "o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.queries()["j17_range_join"](spark, str(tmp_path))
    plain = lambda rows: sorted((repr(lo + 0.0), n) for lo, n in rows)
    assert plain(got.select("lo", "n").collect()) == plain(con.execute(registry.oracle_sql()["j17_range_join"]).fetchall())
    spans = spark.range(2000).selectExpr("id", "7.0D AS lo", "8.0D AS hi")
    many = joins.range_counts(spark.range(2000).selectExpr("7.5D AS x"), spans, "x", "lo", "hi", 1.0)
    assert [tuple(r) for r in many.collect()] == [(7.0, 8.0, 4_000_000)]


@pytest.mark.parametrize("distance", ["l2", "cosine"])
def test_nearest_join_keeps_its_matrices_small_and_exact(spark, distance):
    """Many equal vectors and rows of no or of other numbers; 4,096 queries take a task no more memory than a piece."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(500, 8)).astype("float32") + 100
    x[100:300] = x[100]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [1.0, 2.0]), (903, [None, *[1.0] * 7])]
    rows = spark.createDataFrame(table, "i long, v array<float>").repartition(3)
    got = {}
    for row in vectors.nearest_join(rows, rows.where("i % 10 = 0 AND i < 500"), "i", "v", 4, distance).collect():
        got.setdefault(row.query, {})[row["rank"]] = row.neighbour
    y = x.astype(float)
    for q in range(0, 500, 10):
        d = np.sqrt(((y - y[q]) ** 2).sum(1)) if distance == "l2" else 1 - (y * y[q]).sum(1) / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[q : q + 1], axis=1))
        assert [got[q][i] for i in (1, 2, 3, 4)] == [j for _, j in sorted(zip(d, range(500), strict=True)) if j != q][:4]
    queries, v = r.normal(size=(4096, 16)), r.normal(size=(10_000, 16))
    best = np.full((4096, 5), np.inf), np.full((4096, 5), 2**63 - 1)
    tracemalloc.start()
    vectors._meet(best, np.arange(4096), queries, np.arange(10_000) + 5000, v, distance)
    assert tracemalloc.get_traced_memory()[1] < 10 * 8 * vectors.PIECE
    tracemalloc.stop()
    assert np.isfinite(best[0]).all()


def test_search_over_texts_splits_no_text_and_agrees_with_words(spark):
    """Conditions on the text find what conditions on its words find; either names the words once."""
    texts = [
        "Of the", "of\tthe.", "of--THE end", "soft of theory", "of, of the", "of therefore the", "xof the", "of the1", "of_the", "ofthe", "of a the",
        "\U0001d4b3of the", "\U0001f600of\U0001f600the\U0001d4b3", "\U0001f600of\U0001f600the\U0001f600", "éof the", "of thé", "OF \n\n THE", "", None, "the of of of the", "of ofx the", "the",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    spelled = textsearch.rows(docs, "d", "t")
    words, postings = spelled.drop("s_t"), textsearch.index(docs, "d", "t")
    queries = ['"of the"', '"of th*"', '"o* the"', '"of of the"', '"of"', "of", "o*", "^of", "^o*", "the NOT of", "of-the", "of_the", "*", "NEAR(of the, 0)", "NEAR(the of, 1)", "NEAR(of of, 1)", "NEAR(o* th*, 0)"]
    for q in queries:
        found = [sorted(r.doc for r in textsearch.match(x, q).collect()) for x in (spelled, words, postings)]
        assert found[0] == found[1] == found[2], q
        assert found[0] or q in ("of-the", "of_the")
    plan = lambda name: registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name, splits in {"fts_phrase": 0, "fts_phrase_prefix": 0, "fts_term": 0, "fts_and_or_not": 0, "fts_near": 1}.items():
        assert plan(name).count("regexp_extract_all") == splits
    assert textsearch.match(words, '"of the"')._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_json_functions_share_a_parse_and_change_no_value(spark):
    """Edits of one text side by side, repeated and malformed texts, and batches too large to keep."""
    import json

    import pyarrow as pa

    from basalt.functions import json_text as J

    text = '{"a":[1,{"b":2}],"c":{"d":[]},"e":"é\\""}'
    value = json.loads(text)
    edits = {
        ("$.a[1].b", "set"): '{"a":[1,{"b":9}],"c":{"d":[]},"e":"é\\""}', ("$.a[#]", "set"): '{"a":[1,{"b":2},9],"c":{"d":[]},"e":"é\\""}',
        ("$.a[0]", "array_insert"): '{"a":[9,1,{"b":2}],"c":{"d":[]},"e":"é\\""}', ("$.c.x", "insert"): '{"a":[1,{"b":2}],"c":{"d":[],"x":9},"e":"é\\""}',
        ("$.c", "replace"): '{"a":[1,{"b":2}],"c":9,"e":"é\\""}', ("$.a[#-1].b", "insert"): text, ("$.x.y", "set"): text, ("$.a.b", "set"): text, ("$.c.d[#-1]", "replace"): text, ("$.e[0]", "set"): text,
    }
    for (path, mode), want in edits.items():
        assert J.dumps(J.change(value, J.parse_path(path), 9, mode)) == want, path
    assert J.dumps(J.remove(value, J.parse_path("$.a[1].b"))) == '{"a":[1,{}],"c":{"d":[]},"e":"é\\""}'
    assert J.remove(value, J.parse_path("$.a.b")) is value and J.dumps(value) == text
    batch = pa.table({"x": [text, "{", text, None]}).to_batches()[0]
    values, at = J.parsed(batch.column(0))
    assert (values, at) == ([value, J.NOT_JSON, J.NOT_JSON], [0, 1, 0, 2]) and J.parsed(batch.column(0))[0] is values
    assert J.parsed(pa.array(["1"]))[0] == [1]
    big = json.dumps({"a": "x" * 3_000_000})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([text, "{", text, None, "[1]", big, big, big])], "i int, t string").coalesce(1)
    x = F.col("t")
    got = rows.select("i", J.edit(x, "set", ("$.a", 1)).alias("s"), J.json_remove(x, "$.c", "$.e").alias("r"), J.json_minify(x).alias("m"), J.valid(x).alias("v")).orderBy("i").collect()
    one = ('{"a":1,"c":{"d":[]},"e":"é\\""}', '{"a":[1,{"b":2}]}', text, True)
    large = ('{"a":1}', J.dumps(json.loads(big)), J.dumps(json.loads(big)), True)
    assert [tuple(r)[1:] for r in got] == [one, (None, None, None, False), one, (None, None, None, None), ("[1]",) * 3 + (True,), large, large, large]
