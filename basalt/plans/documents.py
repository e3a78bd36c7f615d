"""JSON functions and JSON tables."""

from pyspark.sql import functions as F

from basalt.functions import aggregates as A
from basalt.functions import json_text as J
from basalt.registry import query
from basalt.sources.tables import read

NESTED = """'{"u":' || user_id || ',"tags":["' || event_type || '",' || (event_id % 3) || ',null],"in":{"k":' || event_id || ',"ok":true}}'"""


def docs(spark, sf_dir):
    text = F.concat(
        F.lit('{"u":'), F.col("user_id"), F.lit(',"tags":["'), F.col("event_type"), F.lit('",'), F.col("event_id") % 3, F.lit(',null],"in":{"k":'), F.col("event_id"), F.lit(',"ok":true}}')
    )
    return read(spark, sf_dir, "events").select("event_id", "props", text.alias("j"))


def over(select: str) -> str:
    return f"SELECT event_id, {select} FROM (SELECT event_id, props, {NESTED} AS j FROM events)"


@query("json_extract", over("json_extract_string(props, '$.k') AS k, json_extract_string(j, '$.tags[0]') AS t, CAST(json_extract(j, '$.in') AS VARCHAR) AS i, CAST(json_extract(j, '$.tags') AS VARCHAR) AS a, CAST(json_extract(j, '$.tags[1]') AS VARCHAR) AS n"))
def extract(spark, sf_dir):
    j = F.col("j")
    return docs(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"), J.arrow_text(j, "$.tags[0]").alias("t"), J.arrow(j, "in").alias("i"), J.extract(j, "$.tags").alias("a"), J.extract(j, "$.tags[#-2]").alias("n"))


@query("json_type_length_valid", over("CASE json_type(j, '$.tags') WHEN 'ARRAY' THEN 'array' END AS t, CASE WHEN json_type(j, '$.in.ok') = 'BOOLEAN' THEN 'true' END AS b, CASE WHEN json_type(j, '$.tags[2]') = 'NULL' THEN 'null' END AS n, CAST(json_array_length(j, '$.tags') AS BIGINT) AS l, json_valid(j) AS v, json_valid(j || '}') AS w"))
def types(spark, sf_dir):
    j = F.col("j")
    return docs(spark, sf_dir).select(
        "event_id", J.json_type(j, "$.tags").alias("t"), J.json_type(j, "$.in.ok").alias("b"), J.json_type(j, "$.tags[2]").alias("n"), J.array_length(j, "$.tags").alias("l"),
        J.valid(j).alias("v"), J.valid(F.concat(j, F.lit("}"))).alias("w"),
    )


@query("json_edits", over("""replace(j, '"ok":true', '"ok":true,"new":1') AS i, replace(j, '"in":{"k":' || event_id || ',"ok":true}', '"in":9') AS r, replace(j, ',"in":{"k":' || event_id || ',"ok":true}', '') AS d, replace(j, ',null]', ',null,7]') AS a, replace(j, ',"ok":true}', '}') || '' AS p"""))
def edits(spark, sf_dir):
    j = F.col("j")
    return docs(spark, sf_dir).select(
        "event_id", J.edit(j, "insert", ("$.in.new", 1), ("$.u", 0)).alias("i"), J.edit(j, "replace", ("$.in", 9), ("$.none", 1)).alias("r"), J.json_remove(j, "$.in").alias("d"),
        J.edit(j, "set", ("$.tags[#]", 7)).alias("a"), J.json_patch(j, '{"in":{"ok":null}}').alias("p"),
    )


@query("json_build", over("'[' || event_id || ',\"x\",null]' AS a, '{\"id\":' || event_id || ',\"t\":\"y\"}' AS o, json_valid(j) AS m"))
def build(spark, sf_dir):
    e = F.col("event_id")
    return docs(spark, sf_dir).select("event_id", J.json_array(e, F.lit("x"), F.lit(None).cast("string")).alias("a"), J.json_object(("id", e), ("t", F.lit("y"))).alias("o"), (J.json_minify(F.col("j")) == F.col("j")).alias("m"))


@query("s14_json_each", f"SELECT event_id, e.key AS key, e.value AS v FROM (SELECT event_id, {NESTED} AS j FROM events) d, LATERAL (SELECT CAST(i - 1 AS VARCHAR) AS key, json_extract_string(j, '$.tags[' || (i - 1) || ']') AS value FROM (SELECT unnest(range(1, 4)) AS i)) e")
def each(spark, sf_dir):
    rows = docs(spark, sf_dir).select("event_id", F.explode(J.each(F.col("j"), "$.tags")).alias("e"))
    return rows.select("event_id", "e.key", F.col("e.value").alias("v"))


@query("s14_json_tree", f"SELECT event_id, CAST(count(*) AS BIGINT) AS n, CAST(max(depth) AS BIGINT) AS deep FROM (SELECT event_id, unnest([0, 1, 1, 2, 2, 2, 1, 2, 2]) AS depth FROM events) GROUP BY event_id")
def tree(spark, sf_dir):
    rows = docs(spark, sf_dir).select("event_id", F.explode(J.tree(F.col("j"))).alias("e"))
    depth = F.size(F.regexp_extract_all("e.fullkey", F.lit(r"(\.|\[)"), F.lit(1)))
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max(depth).cast("bigint").alias("deep"))


@query("json_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant(spark, sf_dir):
    """Binary JSON: a variant, read by path without parsing again."""
    return read(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("jsonb_build", "SELECT event_id, '[' || event_id || ',\"x\",null]' AS a, '{\"id\":' || event_id || ',\"t\":\"y\"}' AS o, CAST(event_id AS BIGINT) AS k FROM events")
def jsonb_build(spark, sf_dir):
    e = F.col("event_id")
    array, made = J.jsonb_array(e, F.lit("x"), F.lit(None).cast("string")), J.jsonb_object(("id", e), ("t", F.lit("y")))
    return read(spark, sf_dir, "events").select("event_id", F.to_json(array).alias("a"), F.to_json(made).alias("o"), F.variant_get(made, "$.id", "bigint").alias("k"))


@query("jsonb_edits", over("CAST(1 AS BIGINT) AS i, CAST(9 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS d, CAST(event_id % 3 AS BIGINT) AS a, CAST(json_extract(j, '$.u') AS BIGINT) AS p, CAST(7 AS BIGINT) AS x"))
def jsonb_edits(spark, sf_dir):
    j = F.col("j")
    at = lambda v, path: F.variant_get(v, path, "bigint")
    return docs(spark, sf_dir).select(
        "event_id", at(J.jsonb_edit(j, "insert", ("$.in.new", 1)), "$.in.new").alias("i"), at(J.jsonb_edit(j, "replace", ("$.in.k", 9)), "$.in.k").alias("r"),
        at(J.jsonb_remove(j, "$.in"), "$.in.k").alias("d"), at(J.jsonb_edit(j, "set", ("$.tags[0]", 7)), "$.tags[1]").alias("a"),
        at(J.jsonb_patch(j, '{"in":null}'), "$.u").alias("p"), at(J.jsonb_edit(j, "array_insert", ("$.tags[1]", 7)), "$.tags[1]").alias("x"),
    )


@query("jsonb_groups", "SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def jsonb_groups(spark, sf_dir):
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(A.jsonb_group_array(k, k)).alias("a"), F.to_json(A.jsonb_group_object(F.col("n_name"), k)).alias("o"))


@query("json_text_forms", over("'[1,' || event_id || ']' AS q, 0 AS good, length(j) + 1 AS bad, '\"' || props[1:1] || '\"' AS s"))
def text_forms(spark, sf_dir):
    j = F.col("j")
    flat = F.regexp_replace(J.pretty(J.json_array(F.lit(1), F.col("event_id"))), r"\s", "")
    return docs(spark, sf_dir).select(
        "event_id", flat.alias("q"), J.error_position(j).cast("int").alias("good"), J.error_position(F.concat(j, F.lit("}"))).alias("bad"), J.json_quote(F.substring("props", 1, 1), "string").alias("s")
    )
