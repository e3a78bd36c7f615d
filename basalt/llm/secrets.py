"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is a distinct text, addressed by its SHA-256; a path is a row.  The
ledger holds every (blob, rule version) pair that has been scanned, as lists of
rule versions by blob, and what was found in it.  A run hashes all rows, takes the
blobs that the ledger lacks for some rule version, scans one row of each by those
rules alone, appends to the ledger and joins the
findings back to all rows.  Only the chosen rows' texts are shuffled, by blob
and row id, so copies of one text cost their hashes alone.

Rules are Java expressions.  Positions come from the texts between the matches:
``split`` gives the gaps and ``regexp_extract_all`` the matches, in order, so
that a match starts after the gaps and matches before it, whose lengths a window
over the blob's matches sums up.

Edge cases: null texts are empty blobs; null ids and repeated rows are paths
like others; tables without rows give no rows; extra columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import cut, table, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  #: what is matched, leftmost and non-overlapping
    valid: str  #: matches that count
    base: bool = False


_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
)
RULES = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]+", "^" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}$", base=True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", "", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", "", base=True),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ""),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ""),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ""),
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def pair(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def matches_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text, in order, with the length of the gap before each."""
    gaps = F.transform(F.split(text, rule.pattern), F.length)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        found,
        lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("length"), (m.rlike(rule.valid) if rule.valid else F.lit(True)).alias("valid")),
    )
    return F.when(text.rlike(rule.pattern), pairs).otherwise(F.array().cast("array<struct<gap:int,length:int,valid:boolean>>"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A ledger row for each blob and rule that found something; of a blob with a list ``missing``, only its rules run.

    Places are running sums of lengths over a blob's matches, so many matches in one text take time in proportion.
    """

    def matches(rule: Rule) -> Column:
        out = matches_of(F.col("text"), rule)
        return F.when(F.array_contains("missing", pair(rule)), out) if "missing" in blobs.columns else out

    def ranked(rule: Rule) -> Column:
        rank = RULES.index(rule) if rule in RULES else 100
        return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rank).alias("rank"), matches(rule).alias("m"))

    # no filter on the text: it would move below the join that picks the unseen blobs
    found = blobs.select("blob", F.explode(F.array(*[ranked(r) for r in rules])).alias("x")).select("blob", "x.*")
    # equal rows give equal findings, of which one stays
    found = found.where(F.size("m") > 0).dropDuplicates(["blob", "kind"])
    each = found.select("blob", "kind", "version", "rank", F.posexplode("m").alias("at", "m"))
    to_here = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(to_here).cast("int")).where("m.valid")
    span = F.struct((F.col("end") - F.col("m.length")).alias("start"), "rank", "kind", "end")
    return each.groupBy("blob", "kind").agg(F.first("version").alias("version"), F.sort_array(F.collect_list(span)).alias("spans")).select(
        "blob", "kind", "version", F.col("spans").cast(SPAN).alias("spans")
    )


def read_ledger(spark: SparkSession, folder: str | None, what: str, schema: str) -> DataFrame:
    if folder is None:
        return spark.createDataFrame([], schema)
    path = f"{folder.rstrip('/')}/{what}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``blob`` and ``spans`` (by start, then rule) to the ``keys`` of each row.

    Where ``docs`` holds every historical version of its paths, ``keys`` are the columns
    of path and version; a text that several of them share is scanned once.

    ``ledger`` is a shared folder.  Rules of which a blob has no record at their
    present version are run on it, and only those; the records are appended.
    Without a folder every blob is new.
    """
    spark = docs.sparkSession
    paths = docs.select(*keys, F.struct(*keys).alias("__path"), whole_text().alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    seen = read_ledger(spark, ledger, "scanned", "blob string, rules string")
    # the smallest path stands for a blob; map-side aggregation leaves one row per task and blob
    fresh = paths.groupBy("blob").agg(F.min("__path").alias("first_path"))
    if ledger is not None:
        known = seen.groupBy("blob").agg(F.flatten(F.collect_set(F.split("rules", r"\|"))).alias("known"))
        present = F.array(*[F.lit(pair(r)) for r in rules])
        missing = F.when(F.col("known").isNull(), present).otherwise(F.array_except(present, F.col("known")))
        fresh = fresh.join(known, "blob", "left").withColumn("missing", missing).drop("known").where(F.size("missing") > 0)
    chosen = paths.join(
        fresh.withColumnRenamed("blob", "fresh_blob"),
        (F.col("blob") == F.col("fresh_blob")) & F.col("__path").eqNullSafe(F.col("first_path")),
        "left_semi" if ledger is None else "inner",
    )
    found = cut(scan(chosen, rules))
    if ledger is not None:
        old = read_ledger(spark, ledger, "found", LEDGER)
        current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
        fresh = cut(fresh)
        found.write.mode("append").parquet(f"{ledger.rstrip('/')}/found")
        fresh.select("blob", F.array_join("missing", "|").alias("rules")).write.mode("append").parquet(f"{ledger.rstrip('/')}/scanned")
        found = old.where(current).unionByName(found).dropDuplicates(["blob", "kind"])
    per_blob = found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.select(*keys, "blob").join(per_blob, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(SPAN))
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        valid = f"regexp_matches(m, {quote(r.valid)})" if r.valid else "true"
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, s AS start_at, s + length(m) AS end_at, m FROM (
  SELECT doc_id, ms[i] AS m,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {quote(r.pattern)}) AS ms, string_split_regex(text, {quote(r.pattern)}) AS gaps FROM d)))
WHERE {valid}""")
    kinds = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id,
  {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)},
  coalesce(string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank) FILTER (kind IN ({kinds})), '') AS base,
  string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, rank) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE = _oracle()
