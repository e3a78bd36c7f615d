"""Full-text search over ``documents``."""

from pyspark.sql import functions as F

from basalt.operators import textsearch as X
from basalt.registry import query
from basalt.sources.tables import read

POSTINGS = r"""p AS (SELECT doc_id AS doc, CAST(i - 1 AS INT) AS pos, terms[i] AS term FROM
(SELECT doc_id, terms, unnest(range(1, len(terms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS terms FROM documents)))"""


def postings(spark, sf_dir):
    return X.index(read(spark, sf_dir, "documents"), "doc_id", "text")


def words(spark, sf_dir):
    return X.rows(read(spark, sf_dir, "documents"), "doc_id", "text")


def found(name, text, oracle):
    @query(name, f"WITH {POSTINGS}, d AS (SELECT DISTINCT doc, term FROM p) {oracle}")
    def run(spark, sf_dir):
        return X.match(words(spark, sf_dir), text)


HAS = "SELECT doc FROM d WHERE term = "
PHRASE = "SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"
found("fts_term", "that", HAS + "'that'")
found("fts_and_or_not", "(with AND this) OR was NOT that", f"({HAS} 'with' INTERSECT {HAS} 'this') UNION ({HAS} 'was' EXCEPT {HAS} 'that')")
found("fts_implicit_and", "with this was", f"{HAS} 'with' INTERSECT {HAS} 'this' INTERSECT {HAS} 'was'")
found("fts_prefix", "wit*", "SELECT DISTINCT doc FROM d WHERE starts_with(term, 'wit')")
found("fts_phrase", '"of the"', PHRASE)
found("fts_initial", "^the OR ^le", "SELECT doc FROM p WHERE pos = 0 AND term IN ('the', 'le')")
found("fts_phrase_prefix", '"of th*"', PHRASE.replace("b.term = 'the'", "starts_with(b.term, 'th')"))
found("fts_near", "NEAR(with was, 5)", "SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc WHERE a.term = 'with' AND b.term = 'was' AND abs(a.pos - b.pos) - 1 <= 5")


@query("fts_bm25", f"""WITH {POSTINGS}, l AS (SELECT doc, count(*) AS len, count(*) FILTER (term = 'with') AS f0, count(*) FILTER (term = 'this') AS f1 FROM p GROUP BY doc),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM l)
SELECT doc, round(-(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM l, s WHERE f0 > 0 OR f1 > 0""")
def bm25(spark, sf_dir):
    return X.bm25(words(spark, sf_dir), "with", "this").select("doc", F.round("score", 6).alias("score"))


@query("fts_vocabulary", f"WITH {POSTINGS} SELECT term, count(DISTINCT doc) AS docs, count(*) AS occurrences FROM p GROUP BY term")
def vocabulary(spark, sf_dir):
    return X.vocabulary(postings(spark, sf_dir))


@query("fts_offsets", f"WITH {POSTINGS} SELECT doc, CASE term WHEN 'with' THEN 0 ELSE 1 END AS word, pos FROM p WHERE term IN ('with', 'this')")
def offsets(spark, sf_dir):
    return X.offsets(postings(spark, sf_dir), "with", "this")


@query("fts_highlight", r"SELECT item_id, regexp_replace(' ' || replace(text, ' ', '  ') || ' ', '(?i)([^\p{L}\p{N}])(the|of)([^\p{L}\p{N}])', '\1<b>\2</b>\3', 'g') AS h FROM benchmark")
def highlight(spark, sf_dir):
    text = F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" "))
    return read(spark, sf_dir, "benchmark").select("item_id", X.highlight(text, ["the", "of"], "<b>", "</b>").alias("h"))


@query("fts_trigrams", "SELECT p_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT p_name, substring(lower(p_name), i, 3) AS g FROM (SELECT DISTINCT p_name, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY p_name")
def trigrams(spark, sf_dir):
    names = read(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.size(F.array_distinct(X.trigrams(F.col("p_name")))).cast("bigint").alias("n"))


@query("fts_snippet")
def snippet(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "with").alias("s"))


def part_words(spark, sf_dir):
    return X.rows(read(spark, sf_dir, "part"), "p_partkey", "p_name", "p_type")


PARTS = r"""t AS (SELECT p_partkey AS doc, regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(p_type), '[\p{L}\p{N}]+') AS b FROM part)"""


@query("fts_postings", f"WITH {POSTINGS} SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' EXCEPT SELECT doc FROM p WHERE term = 'was'")
def by_postings(spark, sf_dir):
    """The same query language over an inverted index."""
    return X.match(postings(spark, sf_dir), '"of the" NOT was')


@query("fts_columns", f"WITH {PARTS} SELECT doc FROM t WHERE (len(list_filter(a, lambda w: starts_with(w, 'r'))) > 0 AND len(list_filter(b, lambda w: starts_with(w, 's'))) > 0) OR len(list_filter(b, lambda w: starts_with(w, 'e'))) > 0")
def by_columns(spark, sf_dir):
    return X.match(part_words(spark, sf_dir), "(p_name : r* AND {p_type} : s*) OR - p_name : e*")


@query("fts_bm25_weights", f"""WITH {PARTS}, l AS (SELECT doc, len(a) + len(b) AS len, 10.0 * len(list_filter(a, lambda w: w = 'small')) + len(list_filter(b, lambda w: w = 'small')) AS f FROM t),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f > 0) AS d FROM l)
SELECT doc, round(-(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM l, s WHERE f > 0""")
def weighted(spark, sf_dir):
    return X.bm25(part_words(spark, sf_dir), "small", weights={"p_name": 10.0}).select("doc", F.round("score", 6).alias("score"))
