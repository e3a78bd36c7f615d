"""Quality rules with adaptive cutoffs.

Each rule compares a text's metric with an upper fence of the metric's own
distribution in the text's language and source: its ``high`` quantile and
``spread`` times the way there from the first quartile.  Most texts have no
symbols or repeats at all, so that way is often nothing; a least way for each
metric then leaves room above the quantile, and alone sets the fence where the
quantile is 0.
A group may hold nearly ``1 - high`` of junk before its fence moves into the
junk.  The distributions are KLL
sketches: one per language and source, merged upwards for languages and for
the whole corpus, so no group's rows ever meet in one task and a group of any
size costs one sketch per task.

Edge cases: null and empty texts have no words and fail the base rule; null
languages and sources are groups like others; a group with fewer than
``min_group`` scored texts uses its language's fences, and a small language
the corpus's, however small; without any scored text nothing passes the base
rule, and there are no fences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import BROADCAST_ROWS, SPACE, cut, null_safe, table, whole_text

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: metric: (numerator, denominator, least way from the first quartile to the high quantile)
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 0.01),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.06),
    "repeat_share": ("n_repeat_words", "n_words", 0.06),
    "word_length": ("word_chars", "n_words", 0.1),
}


@dataclass(frozen=True)
class Rules:
    high: float = 0.8  #: the quantile that fences start from
    spread: float = 6.0  #: fences lie this many ways from the first quartile to the high quantile above it
    min_group: int = 200  #: scored texts that a group needs for fences of its own
    sketch_k: int = 2048  #: KLL size; rank error about 0.1 %
    min_words: int = 50
    max_repeat_share: float = 0.5


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base features and ``n_lines``, by expressions over the row's own arrays."""
    spaces = f"{SPACE}+"
    whole = whole_text(text)
    df = df.withColumn("__words", F.array_remove(F.split(whole, spaces), ""))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn(
        "__windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.slice("__words", F.lit(1), (F.col("n_words") - 2).cast("int")),
                lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    rest = F.greatest(F.size("__sorted") - 1, F.lit(0))
    twice = F.zip_with(
        F.slice("__sorted", F.lit(1), rest),
        F.slice("__sorted", F.lit(2), rest),
        lambda a, b: F.when(a.h == b.h, F.array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2)).otherwise(
            F.array().cast("array<int>")
        ),
    )
    df = df.withColumn("__lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (
        df.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(twice))).cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("word_chars", F.length(F.translate(whole, " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"))
        .drop("__words", "__windows", "__sorted", "__lines")
    )


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > int(100 * rules.max_repeat_share) * F.col("n_words")
    )


def _metric(name: str) -> Column:
    top, bottom, _ = METRICS[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def sketches(scored: DataFrame, rules: Rules) -> DataFrame:
    """One row per language and source: a KLL sketch of each metric and the number of texts."""
    return scored.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(_metric(m), F.lit(rules.sketch_k)).alias(m) for m in METRICS],
    )


def fences(groups: DataFrame, rules: Rules) -> DataFrame:
    """An upper fence per metric for every language and source, from merged sketches."""

    def merged(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(rules.sketch_k)).alias(m) for m in METRICS]
        )

    def fence(metric: str) -> Column:
        q = F.kll_sketch_get_quantile_double(metric, F.array(F.lit(0.25), F.lit(rules.high)))
        return q[1] + F.lit(rules.spread) * F.greatest(q[1] - q[0], F.lit(METRICS[metric][2]))

    def cutoffs(df: DataFrame, keys: list[str], tag: str, least: int = rules.min_group) -> DataFrame:
        enough = F.col("n") >= least
        return df.select(*keys, *[F.when(enough, fence(m)).alias(f"{tag}_{m}") for m in METRICS])

    by_lang = merged(groups, ["lang"])
    overall = cutoffs(merged(by_lang, []), [], "all", 1).withColumn("one", F.lit(1))
    out = null_safe(cutoffs(groups, ["lang", "source"], "own"), cutoffs(by_lang, ["lang"], "lang"), ["lang"])
    out = out.withColumn("one", F.lit(1)).join(overall, "one", "left")
    return out.select(
        "lang",
        "source",
        *[F.coalesce(f"own_{m}", f"lang_{m}", f"all_{m}").alias(f"max_{m}") for m in METRICS],
    )


def judge(scored: DataFrame, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Joins rows with features to the fences and adds ``base_failed`` and ``kept``."""
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = null_safe(scored, limits, ["lang", "source"])
    within = F.lit(True)
    for m in METRICS:
        within = within & F.coalesce(_metric(m) <= F.col(f"max_{m}"), F.lit(True))
    return joined.withColumn("base_failed", base_failed(rules)).withColumn("kept", ~F.col("base_failed") & within)


def learn(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The fences that all rows with features imply; texts that fail the base rule are not counted.

    ``scored`` must be checkpointed: a filter on features that moves below them would copy their expressions.
    """
    return cut(fences(cut(sketches(scored.where(~base_failed(rules)), rules)), rules))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, language, source, features and the verdict of every row of ``docs``."""
    scored = cut(features(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judge(scored, learn(scored, rules), rules)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    plain = docs.select(F.struct(*docs.columns).alias("__row"), "text", "lang", "source")
    scored = cut(features(plain).drop("text"))
    return judge(scored, learn(scored, rules), rules).where("kept").select("__row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *FEATURES, "base_failed", "kept")
