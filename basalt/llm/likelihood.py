"""Language-model scores: marginal likelihood over all subword segmentations.

A text's probability under a unigram model of pieces is the sum over all ways
to cut its words into pieces.  Pieces don't cross words, so it is the product of
the words' marginals, each a forward recursion in log space over the word's
lattice.  The vocabulary's own scores give the prior weights (a Zipf law of
their rank); one expectation-maximisation step over the training texts' word
counts re-weights the pieces, smoothed by that prior.

Plan: one pass counts words per task; the counts are summed by word; each
distinct word's marginal is computed once.  Words above a count threshold, at
most ``FREQUENT`` of them, are broadcast, and a second pass over the texts sums
what they contribute; all other words, whatever their number, are joined to the
table by shuffle and summed per text.

Edge cases: null texts are empty and have only the end token; characters
outside the vocabulary are spelled in byte pieces; words of any length are
scored whole; repeated rows and ids are scored one by one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Shared, crc_mod, cut, in_batches, table

FREQUENT = 200_000  #: words that are broadcast at most
PRIOR_MASS = 1e5  #: pieces that the prior counts for
SPACE_SYMBOL = "▁"
GROUP = 4096


class Lattice:
    """Forward (and expected-count) recursions over words, many words at a time."""

    def __init__(self, pieces: list[str], byte_pieces: dict[int, int], log_p: np.ndarray) -> None:
        self.pieces = {p: i for i, p in enumerate(pieces) if p and i not in set(byte_pieces.values())}
        self.bytes = np.array([byte_pieces[b] for b in range(256)])
        self.log_p = log_p
        self.longest = max(map(len, self.pieces))
        chars = sorted({c for p in self.pieces for c in p})
        self.classes = len(chars) + 1
        self.char_class = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(chars, 1):
            self.char_class[ord(c)] = k
        nodes: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for p, i in self.pieces.items():
            at = 0
            for c in p:
                key = (at, int(self.char_class[ord(c)]))
                if key not in nodes:
                    nodes[key] = len(piece_of)
                    piece_of.append(-1)
                at = nodes[key]
            piece_of[at] = i
        keys = np.array([a * self.classes + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int32)[order]
        self.piece_of = np.array(piece_of, np.int32)
        self.root = np.full(self.classes, -1, np.int32)
        for (a, c), n in nodes.items():
            if a == 0:
                self.root[c] = n

    def _edges(self, points: np.ndarray, lengths: np.ndarray):
        """For each start: end, rows, pieces, extra log weight of byte spellings."""
        classes = self.char_class[points]
        for i in range(points.shape[1]):
            rows = np.flatnonzero(lengths > i)
            if not len(rows):
                return
            # every row has an edge for one character: a piece, or its bytes
            node = self.root[classes[rows, i]]
            single = node >= 0
            single[single] = self.piece_of[node[single]] >= 0
            spelled = rows[~single]
            if len(spelled):
                extra = np.array([self.log_p[self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in points[spelled, i]])
                yield i, i + 1, spelled, None, extra
            rows, node = rows[node >= 0], node[node >= 0]
            for end in range(i + 1, min(i + self.longest, points.shape[1]) + 1):
                if end > i + 1:
                    inside = lengths[rows] >= end
                    rows, node = rows[inside], node[inside]
                    key = node * np.int64(self.classes) + classes[rows, end - 1]
                    at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[at] == key
                    rows, node = rows[hit], self.child[at[hit]]
                if not len(rows):
                    break
                piece = self.piece_of[node]
                ends = piece >= 0
                if ends.any():
                    yield i, end, rows[ends], piece[ends], self.log_p[piece[ends]]

    def run(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each word's marginal and, with weights, the pieces' expected counts."""
        z, expected = np.zeros(len(words)), np.zeros(len(self.log_p))
        order = np.argsort([len(w) for w in words], kind="stable")
        at = 0
        while at < len(order):
            some = order[at : at + GROUP]
            # long words in smaller groups, so that a group's matrices stay small
            longest = len(words[some[-1]])
            if longest * len(some) > 400_000:
                size = max(1, int(np.searchsorted(np.cumsum([len(words[k]) for k in some]), 200_000)))
                some = some[:size]
            at += len(some)
            texts = [SPACE_SYMBOL + words[k] for k in some]
            lengths = np.array([len(t) for t in texts])
            points = np.zeros((len(some), lengths.max()), np.int64)
            flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            points[np.arange(points.shape[1]) < lengths[:, None]] = flat
            alpha = np.full((len(some), points.shape[1] + 1), -np.inf)
            alpha[:, 0] = 0
            edges = []
            for i, end, rows, piece, w in self._edges(points, lengths):
                alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, i] + w)
                if weights is not None:
                    edges.append((i, end, rows, piece, w))
            z[some] = own = alpha[np.arange(len(some)), lengths]
            if weights is None:
                continue
            beta = np.full_like(alpha, -np.inf)
            beta[np.arange(len(some)), lengths] = 0
            for i, end, rows, piece, w in reversed(edges):
                beta[rows, i] = np.logaddexp(beta[rows, i], beta[rows, end] + w)
            for i, end, rows, piece, w in edges:
                share = np.exp(alpha[rows, i] + w + beta[rows, end] - own[rows]) * weights[some[rows]]
                if piece is not None:
                    expected += np.bincount(piece, share, len(expected))
                else:
                    for c, s in zip(points[rows, i], share, strict=True):
                        np.add.at(expected, self.bytes[list(chr(c).encode("utf-8", "surrogatepass"))], s)
        return z, expected


def vocabulary(model_file: str) -> tuple[list[str], dict[int, int], np.ndarray]:
    """Pieces ('' where none may be used), byte pieces and the prior of the vocabulary's scores; the end is the last."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    pieces = ["" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(n)]
    byte_pieces = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    scores = np.array([sp.get_score(i) for i in range(n)])
    scores[list(byte_pieces.values())] = scores.min() - 1
    rank = np.unique(-scores, return_inverse=True)[1]
    prior = np.where([bool(p) for p in pieces], 1 / (rank + 10.0), 0)
    return pieces, byte_pieces, np.append(prior / prior.sum(), 0.0)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word, its count in training texts and in all."""

    def run(batches):
        counts = (Counter(), Counter())

        def out():
            words = list({*counts[0], *counts[1]})
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode() for w in some], pa.string()), pa.array([counts[1][w] for w in some], pa.int64()), pa.array([counts[0][w] + counts[1][w] for w in some], pa.int64())],
                    names=["word", "c", "c_all"],
                )
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, held_out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                counts[not held_out].update(tokens(text))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from out()
        yield from out()

    return in_batches(docs, run, "word string, c long, c_all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def _per_word(words: DataFrame, lattice) -> DataFrame:
    def run(batches):
        for batch in batches:
            z, _ = lattice.value.run(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=[*batch.schema.names, "z"])

    return in_batches(words, run, "word string, c long, c_all long, z double", rows=20_000)


def reweigh(words: DataFrame, lattice, prior: np.ndarray, n_docs: int) -> np.ndarray:
    """Log weights of pieces and end after one expectation step over training counts."""

    def run(batches):
        total = None
        for batch in batches:
            _, got = lattice.value.run(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float))
            total = got if total is None else total + got
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

    sums = in_batches(words.where("c > 0").select("word", "c"), run, "piece long, n double", rows=20_000).groupBy("piece").agg(F.sum("n").alias("n"))
    expected = np.zeros(len(prior))
    for r in sums.collect():  # a row per piece of the vocabulary at most
        expected[r.piece] = r.n
    expected[-1] = n_docs
    smooth = prior * PRIOR_MASS
    smooth[-1] = 1
    p = (expected + smooth) / (expected + smooth).sum()
    with np.errstate(divide="ignore"):
        return np.log(p)


def score(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").withColumn("held_out", crc_mod("doc_id", 7) == 2)
    n_docs = docs.where(~F.col("held_out")).count()
    pieces, byte_pieces, prior = vocabulary(model_file)
    with np.errstate(divide="ignore"):
        first = Lattice([*pieces, ""], byte_pieces, np.log(prior))
    counts = cut(count_words(docs))
    log_p = reweigh(counts, Shared(spark, first), prior, n_docs)
    first.log_p = log_p
    words = cut(_per_word(counts, Shared(spark, first)))
    totals = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (totals.n or 0) + n_docs, totals.v + (n_docs > 0)
    denominator, end_z = math.log10(n + v + 1), float(log_p[-1])

    # levels of counts, some 16 per power of two: as few at any size of corpus
    words = words.withColumn("level", F.floor(16 * F.log2("c_all")))
    lowest, reached = None, 0
    for r in words.groupBy("level").count().orderBy(F.desc("level")).collect():
        if reached + r["count"] > FREQUENT:
            break
        lowest, reached = r.level, reached + r["count"]
    frequent = F.lit(False) if lowest is None else F.col("level") >= lowest
    top = words.where(frequent).toArrow() if reached else None  # FREQUENT rows at most
    known = {} if top is None else {w.encode(): i for i, w in enumerate(top["word"].to_pylist())}
    c = np.append(top["c"].to_numpy() if top is not None else np.zeros(0), 0).astype(float)
    z = np.append(top["z"].to_numpy() if top is not None else np.zeros(0), 0.0)
    common = Shared(spark, (known, np.log10(c + 1), z, c > 0))

    def run(batches):
        index, base, z, seen = common.value
        at, part = 0, TaskContext.get().partitionId()
        missing = len(base) - 1
        for batch in batches:
            rows, n_tokens, n_known, bases, zs, rare = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                k = np.fromiter((index.get(w, missing) for w in words), np.int64, len(words))
                rows.append((part << 40) + at)
                at += 1
                n_tokens.append(len(words) + 1)
                n_known.append(int(seen[k].sum()))
                bases.append(float(base[k].sum()))
                zs.append(float(z[k].sum()))
                rare.append([words[j].decode() for j in np.flatnonzero(k == missing)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(zs, pa.float64()), pa.array(rare, pa.list_(pa.string()))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "z", "rare"],
            )

    texts = cut(in_batches(docs, run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, z double, rare array<string>"))
    others = words.where(~frequent).select("word", "c", "z")
    rest = (
        texts.select("row", F.explode("rare").alias("word"))
        .join(others, "word")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("c") + 1)).alias("r_base"), F.sum("z").alias("r_z"), F.count(F.when(F.col("c") > 0, 1)).alias("r_known"))
    )
    sums = texts.drop("rare").join(rest, "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("r_known") + F.lit(1 if n_docs else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("r_base") + F.lit(math.log10(n_docs + 1)) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        ((F.col("z") + zero("r_z") + F.lit(end_z)) / F.lit(math.log(10))).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
