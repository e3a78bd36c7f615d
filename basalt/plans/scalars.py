"""Scalar functions."""

from pyspark.sql import functions as F

from basalt.functions import numeric as N
from basalt.functions import text as T
from basalt.registry import query, shared
from basalt.sources.tables import read

shared("f_string_basics", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, replace(p_name, ' ', '_') AS r, trim(p_name) AS t, instr(p_name, 'i') AS i, octet_length(encode(p_name, 'UTF-8')) AS o, substring(p_name, 2, 4) AS s, p_name || '/' || p_type AS c FROM {part}",
       "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INT) AS n, replace(p_name, ' ', '_') AS r, trim(p_name) AS t, CAST(instr(p_name, 'i') AS INT) AS i, CAST(strlen(p_name) AS INT) AS o, substring(p_name, 2, 4) AS s, p_name || '/' || p_type AS c FROM part")
shared("f_control", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'x') AS a, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS b, nullif(o_custkey, 5) AS c FROM {orders}")
shared("f_math_basics", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 9) AS q, round(power(p_size, 2), 4) AS p, round(exp(p_size / 50.0E0), 9) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 7) AS t, round(atan2(p_size, 3), 9) AS at, round(degrees(p_size), 7) AS d, round(radians(p_size), 9) AS r, round(pi(), 9) AS pi FROM {part} WHERE p_size > 0")
shared("f_hyperbolic", "SELECT p_partkey, round(sinh(p_size / 50.0E0), 8) AS a, round(cosh(p_size / 50.0E0), 8) AS b, round(tanh(p_size / 50.0E0), 8) AS c, round(asinh(p_size), 8) AS d, round(acosh(p_size), 8) AS e, round(atanh(p_size / 51.0E0), 8) AS f, round(asin(p_size / 51.0E0), 8) AS g, round(acos(p_size / 51.0E0), 8) AS h, round(atan(p_size), 8) AS i FROM {part} WHERE p_size BETWEEN 1 AND 50")
shared("p8_concat_null", "SELECT o_orderkey, nullif(o_orderstatus, 'P') || '-' || o_orderpriority AS c FROM {orders}")
shared("p6_unary", "SELECT p_partkey, -p_size AS m, ~p_size AS b, NOT (p_size > 10) AS n FROM {part}")


@query("p3_p5_arithmetic", """SELECT p_partkey, p_size // nullif(p_size % 4, 0) AS d, CAST(p_retailprice AS BIGINT) % nullif(p_size % 4, 0) AS m,
CAST(9223372036854775807 AS DOUBLE) + p_size AS o, p_size / CAST(nullif(p_size % 3, 0) AS DOUBLE) AS r FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, trunc(p_retailprice) AS p_retailprice FROM part WHERE p_size > 0)""")
def arithmetic(spark, sf_dir):
    size = F.col("p_size").cast("bigint")
    return read(spark, sf_dir, "part").where("p_size > 0").select(
        "p_partkey",
        N.int_div(size, size % 4).alias("d"),
        N.mod(F.floor("p_retailprice"), size % 4).alias("m"),
        N.add(F.lit(2**63 - 1), size).alias("o"),
        N.real_div(size, size % 3).alias("r"),
    )


@query("p7_bits", "SELECT p_partkey, CAST(p_size & 12 AS INT) AS a, CAST(p_size | 3 AS INT) AS o, CAST(p_size AS BIGINT) << (p_partkey % 5) AS l, CAST(p_size AS BIGINT) >> (p_partkey % 5) AS r, CAST(p_size AS BIGINT) >> 1 AS n FROM part")
def bits(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey") % 5
    return read(spark, sf_dir, "part").select("p_partkey", size.bitwiseAND(12).alias("a"), size.bitwiseOR(3).alias("o"), N.shift_left(size, k).alias("l"), N.shift_right(size, k).alias("r"), N.shift_left(size, F.lit(-1)).alias("n"))


@query("p9_p20_collations", "SELECT a.p_partkey FROM part a WHERE lower(a.p_name) = lower('RED Widget') OR rtrim(a.p_brand || '  ') = 'Brand#7'")
def collations(spark, sf_dir):
    brand = T.rtrim_key(F.concat("p_brand", F.lit("  ")))
    return read(spark, sf_dir, "part").where((T.nocase(F.col("p_name")) == T.nocase(F.lit("RED Widget"))) | (brand == "Brand#7")).select("p_partkey")


@query("p14_like", "SELECT p_partkey, p_name ILIKE '%RING' AS a, p_name LIKE '_e% w%' AS b, (p_name || '%') LIKE '%\\%' ESCAPE '\\' AS c FROM part")
def like(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", T.like(name, "%RING").alias("a"), T.like(name, "_e% w%").alias("b"), T.like(F.concat(name, F.lit("%")), "%\\%", "\\").alias("c"))


@query("p15_glob", "SELECT p_partkey, p_name GLOB '*[rw]i[a-n]*' AS a, p_brand GLOB 'Brand#1?' AS b, p_name GLOB '[!rs]*' AS c FROM part")
def glob(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.glob(F.col("p_name"), "*[rw]i[a-n]*").alias("a"), T.glob(F.col("p_brand"), "Brand#1?").alias("b"), T.glob(F.col("p_name"), "[^rs]*").alias("c"))


@query("p15_glob_column", "SELECT p_partkey FROM part WHERE p_name GLOB (left(p_name, 1) || '*t')")
def glob_column(spark, sf_dir):
    return read(spark, sf_dir, "part").where(T.glob_column(F.col("p_name"), F.concat(F.substring("p_name", 1, 1), F.lit("*t")))).select("p_partkey")


@query("p16_regexp", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
def regexp(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_name").rlike("^(red|blue) .*t$")).select("p_partkey")


@query("p19_cast_prefix", "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS i, CAST(left(o_orderpriority, 1) AS DOUBLE) AS r, CAST(0 AS BIGINT) AS z, CAST(trunc(o_totalprice) AS BIGINT) AS t FROM orders")
def cast_prefix(spark, sf_dir):
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.text_to_integer(p).alias("i"), N.text_to_real(p).alias("r"), N.text_to_integer(F.col("o_orderstatus")).alias("z"), N.to_integer(F.col("o_totalprice")).alias("t"))


@query("p26_hints", "SELECT count(*) AS n FROM part WHERE p_size > 40")
def hints(spark, sf_dir):
    """likely(), unlikely() and likelihood() are their argument."""
    return read(spark, sf_dir, "part").where(N.truth((F.col("p_size") > 40).cast("int"))).agg(F.count(F.lit(1)).alias("n"))


@query("f_substr_rules", """SELECT n_nationkey, substr(n_name, 3) AS a, substr(n_name, -4) AS b, left(n_name, 2) AS c, substr(n_name, 2, 3) AS d, left(n_name, 3) AS e FROM nation""")
def substr_rules(spark, sf_dir):
    x = F.col("n_name")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", T.substr(x, F.lit(3)).alias("a"), T.substr(x, F.lit(-4)).alias("b"), T.substr(x, F.lit(0), F.lit(3)).alias("c"),
        T.substr(x, F.lit(2), F.lit(3)).alias("d"), T.substr(x, F.lit(4), F.lit(-3)).alias("e"),
    )


@query("f_hex_unicode_quote", "SELECT n_nationkey, hex(n_name) AS h, CAST(unicode(n_name) AS INT) AS u, '''' || replace(n_name, '''', '''''') || '''' AS q, 'text' AS ty, trim(n_name, 'AEIOU') AS t, concat('<', n_name, NULL, '>') AS c FROM nation")
def hex_unicode(spark, sf_dir):
    x = F.col("n_name")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", T.hex_text(x).alias("h"), T.unicode(x).alias("u"), T.quote(x, "string").alias("q"), T.typeof(x, "string").alias("ty"),
        T.trim(x, "AEIOU").alias("t"), T.concat(F.lit("<"), x, F.lit(None), F.lit(">")).alias("c"),
    )


@query("f_char_unhex", "SELECT n_nationkey, chr(65 + n_nationkey) || chr(233) AS c, CAST(length(n_name) AS INT) AS n FROM nation")
def char_unhex(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", T.char(F.array(F.lit(65) + F.col("n_nationkey"), F.lit(233))).alias("c"), F.length(T.unhex_text(T.hex_text(F.col("n_name")))).alias("n"))


@query("f_printf", "SELECT c_custkey, printf('%05d|%s|%.2f|%x', c_custkey, c_mktsegment, c_acctbal, c_custkey) AS p FROM customer")
def printf(spark, sf_dir):
    """As in its SQL, a null among the values makes the text null."""
    k, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    text = T.printf("%05d|%s|%.2f|%x", k, segment, balance, k)
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(k.isNotNull() & segment.isNotNull() & balance.isNotNull(), text).alias("p"))


@query("f_scalar_min_max", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN least(o_custkey, o_orderkey, 500) END AS lo, CASE WHEN o_orderstatus <> 'P' THEN greatest(o_custkey, o_orderkey) END AS hi FROM orders")
def scalar_min_max(spark, sf_dir):
    c = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", N.scalar_min(c, F.col("o_orderkey"), F.lit(500).cast("bigint")).alias("lo"), N.scalar_max(c, F.col("o_orderkey")).alias("hi"))


@query("f_math_domain", "SELECT p_partkey, CASE WHEN p_size > 25 THEN round(sqrt(p_size - 25), 9) WHEN p_size = 25 THEN 0.0 END AS s, CASE WHEN p_size > 25 THEN round(log10(p_size - 25), 9) END AS l, round(log2(p_size + 1), 9) AS b, trunc(p_retailprice - 1000) + 0.0 AS t, CAST(sign(p_size - 25) AS INT) AS g, ceil(p_retailprice / 7) AS c, floor(p_retailprice / 7) AS f FROM part")
def math_domain(spark, sf_dir):
    d = F.col("p_size") - 25
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.round(N.domain("sqrt", d), 9).alias("s"), F.round(N.log(d), 9).alias("l"), F.round(N.log(F.col("p_size") + 1, base=F.lit(2)), 9).alias("b"),
        N.trunc(F.col("p_retailprice") - 1000).alias("t"), N.sign(d).alias("g"), N.ceil(F.col("p_retailprice") / 7).alias("c"), N.floor(F.col("p_retailprice") / 7).alias("f"),
    )


@query("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def udf_scalar(spark, sf_dir):
    """A registered scalar function: vectorised, called from SQL."""
    import pandas as pd

    @F.pandas_udf("int")
    def twice_and_one(x: pd.Series) -> pd.Series:
        return (x * 2 + 1).astype("int32")

    spark.udf.register("twice_and_one", twice_and_one)
    return spark.sql("SELECT p_partkey, twice_and_one(p_size) AS v FROM {t}", t=read(spark, sf_dir, "part"))


@query("f_concat_trim", "SELECT c_custkey, concat_ws('-', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'x') AS c, ltrim(c_name, 'Cus') AS l, rtrim(c_name, '0123') AS r FROM customer")
def concat_trim(spark, sf_dir):
    even = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    name = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", T.concat_ws("-", name, even, F.lit("x")).alias("c"), T.trim(name, "Cus", "left").alias("l"), T.trim(name, "0123", "right").alias("r"))


@query("f_blobs", "SELECT n_nationkey, CAST(n_nationkey % 5 AS INT) AS z, CAST(n_nationkey % 7 + 1 AS INT) AS r, 'a' || chr(233) || chr(66) AS u FROM nation")
def blobs(spark, sf_dir):
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", F.octet_length(T.zeroblob(k % 5)).alias("z"), F.octet_length(T.randomblob(k % 7 + 1)).alias("r"), T.unistr(F.concat(F.lit("a\\u00e9\\0042"), F.substring("n_name", 1, 0))).alias("u")
    )


@query("f_soundex", "SELECT v.w, v.s FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Tymczak', 'T522'), ('Pfister', 'P236'), ('Honeyman', 'H555')) v(w, s)")
def soundex(spark, sf_dir):
    return spark.createDataFrame([("Robert",), ("Rupert",), ("Tymczak",), ("Pfister",), ("Honeyman",)], "w string").select("w", F.soundex("w").alias("s"))
