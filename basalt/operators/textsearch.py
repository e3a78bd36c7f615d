"""Full-text search over words in rows, or over an inverted index that is a DataFrame.

rows() keeps each document's words in its own row, and its text in lower case where
an expression on the text finds the same words; a query is then one condition and
BM25 an expression, in one scan.  No part of a query names the array of words twice:
a filter is moved below the column that splits the text, and the text would be split
again for each name, under a lambda for each word that matches.  index() has a row per token, (doc, pos,
term), for an index that is written once (partitioned by term, so that a word's
postings are all that is read): queries are semi-joins and set operations on
document ids, phrases and NEAR joins on positions of the few terms asked for.
"""

from __future__ import annotations

import re
from unicodedata import category

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: fixed values of the ranking function
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    """Words in lower case, as the unicode tokenizer splits them (diacritics stay)."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    """The simple tokenizer: runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9\u0080-\x{10ffff}]+)"), F.lit(1))


def trigrams(text: Column) -> Column:
    """The trigram tokenizer: every three neighbouring characters."""
    low = F.lower(text)
    n = F.length(low)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def index(docs: DataFrame, key: str, text: str, tokenizer=tokens) -> DataFrame:
    """(doc, pos, term), positions from 0."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(tokenizer(F.col(text))).alias("pos", "term"))


def _with(postings: DataFrame, term: str) -> DataFrame:
    """Positions of a term or, with a final *, of all terms that begin so."""
    return postings.where(F.col("term").startswith(term[:-1]) if term.endswith("*") else F.col("term") == term)


def term(postings: DataFrame, word: str) -> DataFrame:
    return _with(postings, word).select("doc").distinct()


def phrase(postings: DataFrame, *words: str) -> DataFrame:
    """Documents with the words one after the other: all positions, shifted to the phrase's start, meet in one group."""
    wanted = [_with(postings, w).select("doc", (F.col("pos") - i).alias("start"), F.lit(i).alias("i")) for i, w in enumerate(words)]
    rows = wanted[0]
    for other in wanted[1:]:
        rows = rows.unionAll(other)
    return rows.groupBy("doc", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(words)).select("doc").distinct()


def near(postings: DataFrame, first: str, second: str, distance: int = 10) -> DataFrame:
    """Documents with both words and at most ``distance`` words between them."""
    a = _with(postings, first).select("doc", F.col("pos").alias("p"))
    b = _with(postings, second).select("doc", F.col("pos").alias("q"))
    return a.join(b, "doc").where((F.col("p") != F.col("q")) & (F.abs(F.col("p") - F.col("q")) - 1 <= distance)).select("doc").distinct()


def both(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "doc", "left_semi")
    return out


def either(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def without(part: DataFrame, other: DataFrame) -> DataFrame:
    return part.join(other, "doc", "left_anti")


def rows(docs: DataFrame, key: str, *texts: str, tokenizer=tokens) -> DataFrame:
    """(doc, t_<column>, ..., s_<column>, ...): the words of each text column in its own row; with tokens() its text in lower case too.

    Queries and ranks over this form are expressions on the row: one scan, no shuffle, all words of a query at once.
    """
    words = [F.coalesce(tokenizer(F.col(t)), F.array().cast("array<string>")).alias(f"t_{t}") for t in texts]
    spelled = [F.coalesce(F.lower(F.col(t)), F.lit("")).alias(f"s_{t}") for t in texts if tokenizer is tokens]
    return docs.select(F.col(key).alias("doc"), *words, *spelled)


class OnPostings:
    """What a query's parts are as sets of documents, by joins on postings."""

    def __init__(self, postings: DataFrame) -> None:
        self.postings = postings

    def restricted(self, names: list[str]) -> OnPostings:
        raise ValueError("postings have no columns: use rows()")

    def initial(self, word: str) -> DataFrame:
        return _with(self.postings, word).where("pos = 0").select("doc").distinct()

    def term(self, word: str) -> DataFrame:
        return term(self.postings, word)

    def phrase(self, *words: str) -> DataFrame:
        return phrase(self.postings, *words)

    def near(self, first: str, second: str, distance: int) -> DataFrame:
        return near(self.postings, first, second, distance)

    both, either, without = staticmethod(both), staticmethod(either), staticmethod(without)


#: Expressions for a letter or digit, anything else, and the place before a word.  A pattern may be tried
#: in the middle of a surrogate pair, whose second half is no start of a word.
LETTER, OTHER, START = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]", r"(?:^|[^\p{L}\p{N}\p{Cs}])"


class OnRows:
    """What a query's parts are as conditions on a row: on the text if rows have it, else on arrays of words."""

    def __init__(self, columns: list[str], spelled: bool) -> None:
        self.columns, self.spelled = columns, spelled

    def restricted(self, names: list[str]) -> OnRows:
        """Only these columns, or with a leading minus all but them."""
        if names[0] == "-":
            return OnRows([c for c in self.columns if c not in names], self.spelled)
        missing = [c for c in names if c not in self.columns]
        if missing:
            raise ValueError(f"no such column: {missing[0]}")
        return OnRows(names, self.spelled)

    def _any(self, condition) -> Column:
        """Whether the condition, which names its argument once, holds for the words of some column."""
        out = F.lit(False)
        for c in self.columns:
            out = out | condition(F.col(f"t_{c}"))
        return out

    def _plain(self, *words: str) -> bool:
        """Whether the text has these words where an expression finds them."""
        return self.spelled and all(w and all(category(c)[0] in "LN" for c in w) for w in (w.removesuffix("*") for w in words))

    def _written(self, before: str, *words: str) -> Column:
        """Whether the text of some column has the words one after the other at such a place."""
        spell = lambda w: rf"\Q{w[:-1]}\E{LETTER}*+" if w.endswith("*") else rf"\Q{w}\E(?!{LETTER})"
        pattern = before + f"{OTHER}++".join(map(spell, words))
        out = F.lit(False)
        for c in self.columns:
            text = F.col(f"s_{c}")
            here = text.rlike(pattern)
            for w in reversed(words):  # most texts without the words need no expression
                here = text.contains(w.removesuffix("*")) & here
            out = out | here
        return out

    @staticmethod
    def _is(w: Column, word: str) -> Column:
        return w.startswith(word[:-1]) if word.endswith("*") else w == word

    def term(self, word: str) -> Column:
        if self._plain(word):
            return self._written(START, word)
        if word.endswith("*"):
            return self._any(lambda ws: F.exists(ws, lambda w: self._is(w, word)))
        return self._any(lambda ws: F.array_contains(ws, word))

    def initial(self, word: str) -> Column:
        if self._plain(word):
            return self._written(f"^{OTHER}*+", word)
        return self._any(lambda ws: F.coalesce(self._is(F.get(ws, F.lit(0)), word), F.lit(False)))

    def phrase(self, *words: str) -> Column:
        if self._plain(*words):
            return self._written(START, *words)
        n = len(words)

        def next_word(state: Column, w: Column) -> Column:
            """Whether the phrase's first 1, 2, ... words end here, and whether all of them have ended here or before."""
            ends = [self._is(w, words[0]), *[F.get(state, F.lit(k - 1)) & self._is(w, words[k]) for k in range(1, n)]]
            return F.array(*ends, F.get(state, F.lit(n)) | ends[-1])

        none = F.array(*[F.lit(False)] * (n + 1))
        return self._any(lambda ws: F.aggregate(ws, none, next_word, lambda state: F.get(state, F.lit(n))))

    def near(self, first: str, second: str, distance: int) -> Column:
        far = -distance - 2

        def next_word(state: Column, w: Column) -> Column:
            """Its place, the last places of either word, and whether both have been near."""
            at, a, b = state["at"], self._is(w, first), self._is(w, second)
            met = (b & (at - state["a"] <= distance + 1)) | (a & (at - state["b"] <= distance + 1))
            return F.struct((at + 1).alias("at"), F.when(a, at).otherwise(state["a"]).alias("a"), F.when(b, at).otherwise(state["b"]).alias("b"), (state["met"] | met).alias("met"))

        none = F.struct(F.lit(0).alias("at"), F.lit(far).alias("a"), F.lit(far).alias("b"), F.lit(False).alias("met"))
        return self._any(lambda ws: F.aggregate(ws, none, next_word, lambda state: state["met"]))

    @staticmethod
    def both(*parts: Column) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    @staticmethod
    def either(*parts: Column) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out

    @staticmethod
    def without(part: Column, other: Column) -> Column:
        return part & ~other


_QUERY = re.compile(
    r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|NEAR\(\s*([^\s,]+)\s+([^\s,]+)\s*(?:,\s*(\d+)\s*)?\)'
    r'|(-?\s*(?:\{[^{}]*\}|[\w]+))\s*:|(\^)?(?:"([^"]*)"|([^\s()":{}]+)))'
)


def match(index: DataFrame, query: str) -> DataFrame:
    """Documents that a query matches: words, prefix*, ^initial words, "phrases", NEAR(a b, n), AND, OR, NOT, parentheses.

    ``index`` has postings or rows; over rows, ``column : ...``, ``{a b} : ...`` and ``- column : ...`` choose columns.
    NOT binds closest, then AND (also implied between neighbours), then OR.
    """
    on_rows = "term" not in index.columns
    items, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _QUERY.match(query, at)
        if not m:
            raise ValueError(f"malformed query at {at}: {query}")
        items.append(m)
        at = m.end()

    def peek():
        return items[0] if items else None

    def primary(ops):
        m = items.pop(0) if items else None
        if m is None or m[2] or m[3]:
            raise ValueError(f"malformed query: {query}")
        if m[1]:
            out = any_of(ops)
            if not items or not items.pop(0)[2]:
                raise ValueError(f"unbalanced query: {query}")
            return out
        if m[4]:
            return ops.near(m[4].lower(), m[5].lower(), int(m[6] or 10))
        if m[7]:
            return primary(ops.restricted([*["-"] * m[7].startswith("-"), *re.findall(r"\w+", m[7])]))
        if m[9] is not None:
            return ops.phrase(*re.findall(r"[^\W_]+\*?", m[9].lower()))
        return (ops.initial if m[8] else ops.term)(m[10].lower())

    def excluding(ops):
        out = primary(ops)
        while peek() and peek()[3] == "NOT":
            items.pop(0)
            out = ops.without(out, primary(ops))
        return out

    def all_of(ops):
        parts = [excluding(ops)]
        while peek() and not peek()[2] and peek()[3] != "OR":
            if peek()[3] == "AND":
                items.pop(0)
            parts.append(excluding(ops))
        return ops.both(*parts)

    def any_of(ops):
        parts = [all_of(ops)]
        while peek() and peek()[3] == "OR":
            items.pop(0)
            parts.append(all_of(ops))
        return ops.either(*parts) if len(parts) > 1 else parts[0]

    names = [c[2:] for c in index.columns if c.startswith("t_")]
    out = any_of(OnRows(names, all(f"s_{c}" in index.columns for c in names)) if on_rows else OnPostings(index))
    if items:
        raise ValueError(f"unbalanced query: {query}")
    return index.where(out).select("doc") if on_rows else out


def bm25(rows: DataFrame, *words: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc, score) of documents with any of the words; the better, the more negative.

    ``rows`` as rows() gives them; a hit counts by its column's weight (1 if none is given).  Lengths and
    frequencies are expressions on the row; a few numbers a document are shuffled, no words.
    """
    columns = [c for c in rows.columns if c.startswith("t_")]
    weight = {c: float((weights or {}).get(c[2:], 1.0)) for c in columns}

    def total(value) -> Column:
        return sum((value(c) for c in columns[1:]), value(columns[0]))

    def frequency(word: str, weighted: bool) -> Column:
        hits = lambda c: F.size(F.filter(F.col(c), lambda w: w == word))
        return total(lambda c: F.lit(weight[c]) * hits(c)) if weighted else total(hits)

    counts = [frequency(w, False).alias(f"c{i}") for i, w in enumerate(words)]
    if weights:
        counts += [frequency(w, True).alias(f"f{i}") for i, w in enumerate(words)]
    # both uses read the same shuffled rows of a few numbers, so that texts are split once
    per_doc = rows.select("doc", total(lambda c: F.size(c)).alias("len"), *counts).repartition("doc")
    stats = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"c{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(words))])
    score, hit = F.lit(0.0), F.lit(False)
    for i in range(len(words)):
        f, d = F.col(f"f{i}" if weights else f"c{i}").cast("double"), F.col(f"d{i}")
        idf = F.greatest(F.ln((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        hit = hit | (F.col(f"c{i}") > 0)
    # a condition on both sides stays above the join, where it leaves the shared rows as they are
    return per_doc.join(F.broadcast(stats)).where(F.when(F.col("n") > 0, hit)).select("doc", (-score).alias("score"))  # stats: one row


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, docs, occurrences)."""
    per_doc = postings.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("c").alias("occurrences"))


def highlight(text: Column, words: list[str], before: str, after: str) -> Column:
    """The text with the words marked, case kept."""
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def snippet(text: Column, word: str, size: int = 8, dots: str = "...") -> Column:
    """``size`` words around the first occurrence of a word (or from the start), with dots where text is left out."""
    words = F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))
    place = F.array_position(F.transform(words, lambda w: F.regexp_extract(F.lower(w), f"({WORD})", 1)), F.lit(word))
    n = F.size(words)
    start = F.greatest(F.least(place - size // 2, n - size + 1), F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, start, F.lit(size)), " ")
    return F.concat(F.when(start > 1, F.lit(dots)).otherwise(F.lit("")), body, F.when(start + size - 1 < n, F.lit(dots)).otherwise(F.lit("")))


def offsets(postings: DataFrame, *words: str) -> DataFrame:
    """(doc, word, pos) of every hit."""
    numbers = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    return postings.where(F.col("term").isin(*words)).select("doc", numbers[F.col("term")].alias("word"), "pos")
