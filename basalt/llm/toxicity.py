"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

Features of a text are densities: words of a seed lexicon, of lexica learned
from the labels in two strengths, such words near a second-person pronoun,
capitals, punctuation and obfuscated spellings.  The lexica are learned from two
folds of a bounded sample of labelled rows (``Fit.max_rows``) and the trees from
the other four.  The calibration is cross-fitted: each of those four folds is
scored by trees of the other three, so that no row judges what it has itself
taught.  Small samples are treated alike; with few toxic rows the lexica stay
short and the calibration coarse.  Scoring is one pass over all documents with
the model, a few kB, as a broadcast; it takes time in proportion to a text's
length.

Edge cases: null and empty texts have all densities at zero and get the score
that these imply; labels with a null value are not used, of repeated labels the
highest counts; without labels of both kinds every score is the seed lexicon's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Shared, crc_mod, in_batches, table

SEED = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers pathetic worthless scum trash garbage "
    "disgusting clown clowns vermin filth filthy hate ugly creep jerk imbecile cretin dimwit halfwit freak "
    "crétin imbécile débile ordure pourriture connard dégoûtant minable dummkopf trottel abschaum widerlich wertlos "
    "blödmann arschloch estúpido imbécil basura asqueroso inútil escoria patético".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself you're u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tú ti tus vosotros".split()
)
NEAR = 4
LEET = str.maketrans("0134578@$!*", "oieastbasi ")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
# a match can only begin where a run of letters does, which keeps the search linear
OBFUSCATED = re.compile(r"(?<![A-Za-z])[A-Za-z]++[0-9@$!*]++[A-Za-z]++")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
SPACED = re.compile(r"\b(?:[A-Za-z][ .\-_*]){3,}[A-Za-z]\b")
FEATURES = (
    "seed_density seed_any seed_kinds strong_density strong_any strong_kinds weak_density weak_kinds near_you top_weight "
    "weight_sum capitals capital_words exclaims questions punctuation symbols digits obfuscated leet_hits log_words"
).split()


@dataclass(frozen=True)
class Fit:
    max_rows: int = 20_000  #: labelled rows used at most, those with the smallest hash of their id
    lexicon: int = 256  #: learned words at most
    min_texts: int = 3  #: toxic texts that a learned word must be in
    trees: int = 120
    depth: int = 3
    rate: float = 0.1
    bins: int = 48


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    rate: float = 0.1
    iso_x: np.ndarray | None = None
    iso_y: np.ndarray | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(value)))):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += self.rate * value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return 1 / (1 + np.exp(-(400 * x[:, 0] - 4)))
        raw = 1 / (1 + np.exp(-self.margin(x)))
        if self.iso_x is None:
            return raw
        # a grain of the raw score keeps the order within a step of the calibration
        return 0.999 * np.interp(raw, self.iso_x, self.iso_y) + 0.001 * raw


def dense(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of a text."""
    words = WORD.findall(text.lower())
    n = max(len(words), 1)
    hits = [(i, w) for i, w in enumerate(words) if w in lexicon or w in SEED]
    seed = [w for _, w in hits if w in SEED]
    weights = [lexicon.get(w, 0.0) for _, w in hits]
    strong = [w for (_, w), z in zip(hits, weights, strict=True) if z >= 2]
    weak = [w for (_, w), z in zip(hits, weights, strict=True) if 0 < z < 2]
    near = sum(1 for i, _ in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(int(data.sum()), 1)
    odd = OBFUSCATED.findall(text)
    plain = [w.lower().translate(LEET).replace(" ", "") for w in odd] + [
        re.sub(r"[^A-Za-z]", "", w).lower() for w in SPACED.findall(text)
    ]
    leet = sum(1 for w in plain if w in SEED or lexicon.get(w, 0) >= 2)
    return [
        len(seed) / n,
        float(bool(seed)),
        len(set(seed)),
        len(strong) / n,
        float(bool(strong)),
        len(set(strong)),
        len(weak) / n,
        len(set(weak)),
        near / n,
        max(weights, default=0.0),
        sum(weights) / math.sqrt(n),
        float(data[65:91].sum()) / chars,
        len(CAPITALS.findall(text)) / n,
        float(data[33]) / chars,
        float(data[63]) / chars,
        float(data[[34, 39, 44, 46, 58, 59]].sum()) / chars,
        float(data[[35, 36, 37, 38, 42, 60, 62, 64, 94, 124, 126]].sum()) / chars,
        float(data[48:58].sum()) / chars,
        len(odd) / n,
        leet / n,
        math.log1p(len(words)),
    ]


def fold_of(doc_id) -> int:
    """0 or 1: lexica; 2, 3, 4 or 5: trees and, by the trees of the other three, calibration."""
    z = (int(doc_id or 0) * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)
    return (z >> 40) % 6


def boost(x: np.ndarray, y: np.ndarray, fit: Fit) -> Model:
    """Gradient-boosted trees of fixed depth by histograms, logistic loss."""
    model = Model(rate=fit.rate)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > fit.bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, fit.bins + 1)[1:-1]))
        model.edges.append(values)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)], axis=1)
    width = max(len(e) for e in model.edges) + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(len(y), model.bias), 2**fit.depth - 1
    for _ in range(fit.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, width, np.int64), np.zeros(len(y), np.int64)
        for level in range(fit.depth):
            first, k = 2**level - 1, 2**level
            at = node - first
            best, where = np.full(k, 1e-6), [(0, width)] * k
            for j in range(x.shape[1]):
                cell = at * width + binned[:, j]
                gs = np.bincount(cell, g, k * width).reshape(k, width).cumsum(1)
                hs = np.bincount(cell, h, k * width).reshape(k, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                top = gain.argmax(1)
                for i in range(k):
                    if gain[i, top[i]] > best[i]:
                        best[i], where[i] = gain[i, top[i]], (j, int(top[i]))
            for i in range(k):
                feature[first + i], cut[first + i] = where[i]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        model.trees.append((feature, cut, value))
        margin += fit.rate * value[leaf]
    return model


def calibrate(model: Model, raw: np.ndarray, y: np.ndarray) -> None:
    """Isotonic regression of labels on raw scores, by pooling adjacent violators."""
    if not len(y) or y.min() == y.max():
        return
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(raw[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    model.iso_x = np.array([0.0, *[b[2] / b[1] for b in blocks], 1.0])
    middle = [(b[0] + 0.5 * mean) / (b[1] + 0.5) for b in blocks for mean in [float(y.mean())]]
    middle = np.maximum.accumulate(middle)
    model.iso_y = np.array([middle[0], *middle, middle[-1]])


def cross_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and labels of the rows of each fold, by trees of the other folds."""
    raw, own = [], []
    for k in np.unique(fold):
        rest = fold != k
        if rest.any() and y[rest].min() < y[rest].max():
            raw.append(1 / (1 + np.exp(-boost(x[rest], y[rest], fit).margin(x[~rest]))))
            own.append(y[~rest])
    return np.concatenate([*raw, np.zeros(0)]), np.concatenate([*own, np.zeros(0)])


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fits lexica, trees and calibration on the bounded sample of labelled rows."""
    spark = docs.sparkSession
    chosen = (
        labels.where("toxic is not null and doc_id is not null")
        .where(crc_mod("doc_id", 5) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit.max_rows)
    )
    sample = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches):
        df: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            ids, texts, toxic = (batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
            for i, t, y in zip(ids, texts, toxic, strict=True):
                if fold_of(i) < 2:
                    df[int(y > 0)].update({*WORD.findall((t or "").lower()), ""})
        words = list({*df[0], *df[1]})
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array([df[k][w] for w in some], pa.int64()) for k in (1, 0))], names=["word", "bad", "good"]
            )

    words = in_batches(sample, count, "word string, bad long, good long").groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    totals = words.where("word = ''").first()
    bad, good = (totals.bad, totals.good) if totals else (0, 0)
    lexicon: dict[str, float] = {}
    if bad and good:
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
        # texts beyond those that the word's share among clean texts would give
        excess = F.col("bad") - bad * (F.col("good") + 1.0) / good
        top = (
            words.where(F.col("word") != "")
            .where((F.col("bad") >= fit.min_texts) & (odds > 0.7) & (excess > 3 * F.sqrt(F.col("bad"))* 0.5))
            .select("word", odds.alias("odds"), excess.alias("excess"))
            .orderBy(F.desc("excess"), "word")
            .limit(fit.lexicon)
        )
        lexicon = {r.word: float(r.odds) for r in top.collect()}  # at most fit.lexicon rows
    held = Shared(spark, lexicon)

    def measure(batches):
        for batch in batches:
            x = [dense(t or "", held.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"]
            )

    rows = in_batches(sample, measure, "doc_id long, toxic int, x array<double>").toArrow()  # at most fit.max_rows rows
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    if not len(order):
        return Model(lexicon)
    x = np.array(rows["x"].to_pylist())[order]
    y = (rows["toxic"].to_numpy()[order] > 0).astype(float)
    fold = np.array([fold_of(i) for i in rows["doc_id"].to_numpy()[order]])
    x, y, fold = x[fold >= 2], y[fold >= 2], fold[fold >= 2]
    if not len(y) or y.min() == y.max():
        return Model(lexicon)
    model = boost(x, y, fit)
    model.lexicon = lexicon
    calibrate(model, *cross_scores(x, y, fold, fit))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the score of every row of ``docs``."""
    held = Shared(docs.sparkSession, model)

    def run(batches):
        own = held.value
        for batch in batches:
            x = np.array([dense(t or "", own.lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(own.score(x), 0, 1))], names=["doc_id", "score"])

    return in_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
