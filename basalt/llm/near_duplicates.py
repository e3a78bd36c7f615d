"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts are sets of five-word shingles weighted by frequency in the text and a
smooth, normalised IDF between 1 and 2.  Document frequencies are counted over
all documents in a table of fixed size, by hash of the shingle.  A sample is the
shingle (and quantised weight) that wins the text's weighted draw; two texts
agree in a sample with a probability of their weighted Jaccard similarity.
Samples are banded; texts that share a band are candidates.

No task ever sees a whole bucket and no bucket is expanded into its pairs:

Candidate groups (texts linked by buckets) of at most ``SMALL`` texts and
``SMALL_CHARS`` characters are compared in one task each.  In larger ones

1. every member is compared with its bucket's first text, then those not yet in
   one class with it are compared with a few more, which settles dense groups;
2. buckets in which several classes are left over are finished exactly: their
   texts' rarest shingles, by exact frequencies among these texts, are joined,
   which finds every pair of similarity 0.8.  Passages and lines that many texts
   share are among the commonest shingles and join nothing, and a pair goes where
   the weight after its first shared shingle is too little.  Before that, each
   text is compared with one text of each shingle, so that few classes are left.

Exact copies are one node (the text's digest) throughout.  All links found are
verified by the weighted Jaccard similarity of whole texts.

Edge cases: null texts are empty and copies of each other; a text of fewer than
five words is one shingle; null ids and repeated rows are members like others; a
class's id is its least doc_id (null if it has none).
"""

from __future__ import annotations

from dataclasses import dataclass
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import BROADCAST_ROWS, Shared, cut, in_batches, table, whole_text
from basalt.llm.components import components

DRAWS = 1 << 16
ID_ROWS = BROADCAST_ROWS // 2
LEVELS = 16  #: of the IDF between 1 and 2
SMALL = 100  #: candidate groups of up to so many texts, and
SMALL_CHARS = 2 << 20  #: so many characters, are compared in one task


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 14
    rows: int = 4
    df_buckets: int = 1 << 20
    more_leaders: int = 4


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingle hashes (ascending) of texts and how often each occurs, for many texts at once."""

    def __init__(self, words: int) -> None:
        self.k = words
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.power) < n:
            base, size = 0xD6E8FEB86659FD93, max(n, 1 << 16)
            for name, b in (("power", base), ("inverse", pow(base, -1, 2**64))):
                out = np.ones(size, np.uint64)
                done = 1
                while done < size:
                    step = min(done, size - done)
                    out[done : done + step] = out[:step] * np.uint64(pow(b, done, 2**64))
                    done += step
                setattr(self, name, out)

    def hashes(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hash of each shingle, in order of place."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for t in texts:
            data = (t or "").lower().encode("utf-8", "surrogatepass")
            if group and size + len(data) > 1 << 20:
                out += self._group(group)
                group, size = [], 0
            group.append(data)
            size += len(data) + 1
        return out + self._group(group) if group else out

    def _group(self, group: list[bytes]) -> list[np.ndarray]:
        x = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        self._tables(len(x))
        inside = np.concatenate([[False], ~SPACES[x], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.power[: len(x)])])
        w = (sums[end] - sums[start]) * self.inverse[start]
        w = (w ^ (w >> np.uint64(32))) * FACTOR
        begin = np.cumsum([0, *[len(g) + 1 for g in group]])
        bounds = np.searchsorted(start, begin)
        n = max(len(w) - self.k + 1, 0)
        h = np.full(n, np.uint64(0x243F6A8885A308D3))
        for j in range(self.k):
            h = (h ^ w[j : j + n]) * FACTOR
            h ^= h >> np.uint64(31)
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= self.k:
                out.append(h[lo : hi - self.k + 1])
            else:
                one = np.full(min(hi - lo, 1), np.uint64(0x13198A2E03707344))
                for j in range(lo, hi):
                    one = (one ^ w[j]) * FACTOR
                    one ^= one >> np.uint64(31)
                out.append(one)
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for h in self.hashes(texts):
            h = np.sort(h)
            at = np.flatnonzero(np.concatenate([[True] * min(len(h), 1), h[1:] != h[:-1]]))
            out.append((h[at], np.diff(np.append(at, len(h)))))
        return out


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if it is small: rows of ids, so that texts stay where they are."""
    return F.broadcast(df) if df.count() <= ID_ROWS else df


class Weights:
    """IDF of shingles from the table of document frequencies."""

    def __init__(self, df: np.ndarray, n_docs: int) -> None:
        self.df = df.astype(np.int64)
        top = np.log(1.0 + max(n_docs, 1))
        idf = np.maximum(0, top - np.log(1.0 + np.minimum(df, n_docs))) / top
        self.level = np.rint(LEVELS * idf).astype(np.int32)  # in sixteenths, so that draws can be tabulated
        self.shift = np.uint64(64 - int(np.log2(len(df))))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift).astype(np.int64)

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1 + self.level[self.bucket(h)] / np.float32(LEVELS)).astype(np.float32) * tf.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling, with draws from a table by hash."""

    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(20)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.beta = rng.random(DRAWS).astype(np.float32)
        levels = np.log(1 + np.arange(LEVELS + 1, dtype=np.float32) / np.float32(LEVELS)).astype(np.float32)
        self.table = np.concatenate([self._draw(np.arange(DRAWS), w)[0] for w in levels])
        self.factor = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _draw(self, draw: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, beta = self.r[draw], self.beta[draw]
        t = np.floor(log_w / r + beta)
        return self.log_c[draw] - r * (t - beta + 1), t

    def __call__(self, h: np.ndarray, tf: np.ndarray, level: np.ndarray) -> np.ndarray:
        """A key per band."""
        k = len(self.factor)
        best, who, log_w = np.full(k, np.inf, np.float32), np.zeros(k, np.int64), np.zeros(k, np.float32)
        every = np.arange(k)
        once = tf == 1
        for part, tabulated in ((once, True), (~once, False)):
            own, lv, times = h[part], level[part], tf[part]
            own_log_w = np.log((1 + lv / np.float32(LEVELS)) * times.astype(np.float32)).astype(np.float32)
            for at in range(0, len(own), 1024):
                draw = ((own[at : at + 1024, None] * self.factor) >> np.uint64(48)).astype(np.int32)
                if tabulated:
                    log_a = self.table[draw + (lv[at : at + 1024, None] << 16)]
                else:
                    log_a, _ = self._draw(draw, own_log_w[at : at + 1024, None])
                i = log_a.argmin(0)
                a = log_a[i, every]
                less = a < best
                best[less], who[less], log_w[less] = a[less], draw[i, every][less], own_log_w[at + i][less]
        _, ts = self._draw(who, log_w)
        x = (who.astype(np.uint64) << np.uint64(20)) ^ ts.astype(np.int64).view(np.uint64)
        x = (x + np.uint64(1)) * self.mix
        x ^= x >> np.uint64(32)
        x = (x * self.mix).reshape(self.bands, self.rows)
        key = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            key = (key ^ x[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - common
    return common / total if total else 1.0


def document_frequencies(docs: DataFrame, near: Near) -> tuple[np.ndarray, int]:
    """The table of shingles' document frequencies over all rows (fixed size), and the number of rows."""
    chunk = 4096

    def run(batches):
        shingler, df, n = Shingler(near.words), np.zeros(near.df_buckets, np.int64), 0
        shift = np.uint64(64 - int(np.log2(near.df_buckets)))
        for batch in batches:
            sets = shingler(batch.column("text").to_pylist())
            n += len(sets)
            np.add.at(df, (np.concatenate([h for h, _ in sets]) >> shift).astype(np.int64), 1)
        if n:
            used = [c for c in range(0, near.df_buckets, chunk) if df[c : c + chunk].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *used], pa.int32()), pa.array([n % 64] * (len(used) + 1), pa.int32()), pa.array([np.array([n], np.int64).tobytes(), *[df[c : c + chunk].tobytes() for c in used]])],
                names=["chunk", "salt", "counts"],
            )

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in t["counts"].to_pylist())
        return pa.table({"chunk": t["chunk"][:1], "salt": t["salt"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, salt int, counts binary"
    parts = in_batches(docs.select(whole_text().alias("text")), run, schema)
    sums = parts.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    df, n = np.zeros(near.df_buckets, np.int64), 0
    for r in sums.collect():  # df_buckets / 4096 rows
        counts = np.frombuffer(r.counts, np.int64)
        if r.chunk < 0:
            n = int(counts[0])
        else:
            df[r.chunk : r.chunk + chunk] = counts
    return df, n


def _sample(texts: DataFrame, weights, near: Near) -> DataFrame:
    """A row per distinct text with shingles: its keys and total weight."""

    def run(batches):
        shingler, sampler, seen = Shingler(near.words), Sampler(near.bands, near.rows), set()
        for batch in batches:
            nodes, keys, totals, new = [], [], [], {}
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node not in seen:
                    new[node] = text
            if len(seen) < 1_000_000:
                seen.update(new)
            for node, (h, tf) in zip(new, shingler(list(new.values())), strict=True):
                if len(h):
                    nodes.append(node)
                    keys.append(sampler(h, tf, weights.value.level[weights.value.bucket(h)]))
                    totals.append(float(weights.value(h, tf).sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(totals, pa.float64())], names=["node", "keys", "weight"]
            )

    one = in_batches(texts, run, "node string, keys array<bigint>, weight double")
    return one.groupBy("node").agg(F.first("keys").alias("keys"), F.first("weight").alias("weight"))


def _verify(pairs: DataFrame, texts: DataFrame, weights, near: Near) -> DataFrame:
    """Those of ``pairs`` (a, b) whose similarity is high enough.

    The text of ``a`` comes once, before those of its partners.  ``a`` may be in very
    many pairs: it is dealt out in as many copies as it has thousands of them, so no
    task gets them all.
    """

    def run(batches):
        shingler, own, current = Shingler(near.words), None, None
        for batch in batches:
            a, b, s = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b")), shingler(batch.column("text").to_pylist()), strict=True)
            for x, y, (h, tf) in rows:
                if y is None:  # the row that brings a's text
                    own, current = x, (h, weights.value(h, tf))
                    continue
                assert own == x
                sim = similarity(current, (h, weights.value(h, tf)))
                if sim >= near.similarity:
                    a.append(x)
                    b.append(y)
                    s.append(sim)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    per_a = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("copies")))
    left = texts.select(F.col("node").alias("a"), "text").join(_bounded(per_a), "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(None).cast("string").alias("b"), "text")
    salted = cut(pairs.join(per_a, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), "b"))
    right = texts.select(F.col("node").alias("b"), "text").join(_bounded(salted), "b").select("a", "salt", "b", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionAll(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return in_batches(dealt.select("a", "b", "text"), run, "a string, b string, similarity double")


def _compare_small(texts: DataFrame, weights, near: Near) -> DataFrame:
    """Links within groups (label) of at most SMALL texts, as many as connect each class."""

    def links(rows, shingler):
        sets = [(h, weights.value(h, tf)) for h, tf in shingler([t for _, t in rows])]
        totals = [float(w.sum(dtype=np.float64)) for _, w in sets]
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                low, high = sorted((totals[i], totals[j]))
                if root[i] != root[j] and low >= near.similarity * high * (1 - 1e-6):
                    sim = similarity(sets[i], sets[j])
                    if sim >= near.similarity:
                        gone = root[i]
                        root = [root[j] if x == gone else x for x in root]
                        yield rows[j][0], rows[i][0], sim

    def run(batches):
        shingler, rows, label, out = Shingler(near.words), [], None, []

        def send():
            a, b, s = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

        for batch in batches:
            for own, node, text in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "text")), strict=True):
                if own != label:
                    out += links(rows, shingler)
                    rows, label = [], own
                rows.append((node, text))
            yield send()
            out = []
        out += links(rows, shingler)
        yield send()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("label", "node", "text").repartition(parts, "label").sortWithinPartitions("label")
    return in_batches(dealt, run, "a string, b string, similarity double")


def _postings(texts: DataFrame, weights, near: Near) -> DataFrame:
    """node, weight, shingle, rest: the prefix of each text by the shingles' exact frequencies among ``texts``.

    Shingles of one text alone go.  Of the others, rarest first, those stay from which on
    (``rest``: their weight and that of all later ones) enough weight for the similarity is left.
    """

    def run(batches):
        shingler = Shingler(near.words)
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            sets = shingler(batch.column("text").to_pylist())
            parts = [weights.value(h, tf).astype(np.float64) for h, tf in sets]
            n = [len(h) for h, _ in sets]
            totals = np.repeat([float(w.sum()) for w in parts], n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(nodes, object), n), pa.string()),
                    pa.array(totals, pa.float64()),
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in sets]]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(0), *parts])),
                ],
                names=["node", "weight", "shingle", "part"],
            )

    every = in_batches(texts.select("node", "text"), run, "node string, weight double, shingle long, part double")
    counts = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    from_here = Window.partitionBy("node").orderBy(F.desc("k"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    shared = every.join(counts, "shingle").withColumn("rest", F.sum("part").over(from_here))
    return cut(shared.where(F.col("rest") >= near.similarity * F.col("weight") * (1 - 1e-6)).select("node", "weight", "shingle", "rest"))


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    labels = components(links)
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), labels


def classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Adds ``node`` (digest of the text) and ``label`` (its class) to doc_id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("node", F.md5(F.col("text").cast("binary")))
    df, n = document_frequencies(docs, near)
    weights = Shared(spark, Weights(df, n))  # a table of fixed size
    sampled = cut(_sample(rows.select("node", "text"), weights, near))
    keyed = sampled.select("node", "weight", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = cut(keyed.join(crowded, "key"))

    # one row of each candidate text: the least doc_id's; only those are shuffled, if anything is
    candidates = members.select(F.col("node").alias("candidate")).distinct()
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    some = rows.join(candidates, F.col("node") == F.col("candidate"), "left_semi")
    ids = cut(some.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("times")))
    first = ids.groupBy(F.col("node").alias("first_node")).agg(F.min("doc_id").alias("first_id"))
    texts = some.join(_bounded(first), (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    texts = texts.select("node", "text")
    if not ids.where("times > 1").isEmpty():  # rows that agree in id and text
        texts = texts.dropDuplicates(["node"])
    texts = cut(texts)

    close = F.least("weight", "weight_a") >= near.similarity * F.greatest("weight", "weight_a") * (1 - 1e-6)
    heavy = sampled.select(F.col("node").alias("a"), F.col("weight").alias("weight_a"))

    def candidates_of(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose weights allow the similarity."""
        return pairs.distinct().join(heavy, "a").where(close).select("a", F.col("node").alias("b"))

    # texts linked by buckets, before any comparison; nearly all such groups are small
    grouped = components(members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    sizes = grouped.join(texts.select("node", F.length("text").alias("chars")), "node").groupBy("label")
    sizes = sizes.agg(((F.count(F.lit(1)) <= SMALL) & (F.sum("chars") <= SMALL_CHARS)).alias("small"))
    grouped = cut(grouped.join(sizes, "label"))
    links = cut(_compare_small(texts.join(_bounded(grouped.where("small").select("node", "label")), "node"), weights, near))
    large = _bounded(grouped.where("not small").select("node"))
    if large.isEmpty():
        labels = components(links)
    else:
        members = cut(members.join(large, "node", "left_semi"))
        texts = cut(texts.join(large, "node", "left_semi"))
        tried = cut(candidates_of(members.where("node <> leader").select(F.col("leader").alias("a"), "node", "weight")))
        links = cut(links.unionByName(_verify(tried, texts, weights, near)))

        labelled, _ = _labelled(members, links)
        labelled = cut(labelled)
        open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        left = labelled.join(open_keys, "key", "left_semi")
        leaders = _some(left, near.more_leaders)
        pairs = left.join(leaders, "key").where("label <> label_a").select("a", "node", "weight")
        again = candidates_of(pairs).join(tried, ["a", "b"], "left_anti")
        again = cut(again)
        links = cut(links.unionByName(_verify(again, texts, weights, near)))

        labelled, labels = _labelled(members, links)
        labelled = cut(labelled)
        open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        rest = labelled.join(open_keys, "key", "left_semi").select("node").distinct()
        postings = _postings(texts.join(_bounded(cut(rest)), "node", "left_semi"), weights, near)
        done = cut(tried.unionByName(again))
        needed = near.similarity / (1 + near.similarity) * (F.col("weight") + F.col("weight_a")) * (1 - 1e-6)
        # what two texts share begins with a first shingle, whose rest bounds it
        possible = (F.col("label") != F.col("label_a")) & close & (F.least("rest", "rest_a") >= needed)

        def one_more(pairs: DataFrame) -> DataFrame:
            """Those of the distinct pairs, in order, that have not been compared."""
            ordered = pairs.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()
            return cut(ordered.join(done, ["a", "b"], "left_anti").join(done.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))

        def tagged() -> tuple[DataFrame, DataFrame]:
            own = postings.join(_bounded(cut(labelled.select("node", "label").distinct())), "node")
            return own, own.select("shingle", *[F.col(c).alias(c + "_a") for c in ("node", "label", "weight", "rest")])

        # each text with the most central one of each of its rare shingles: most of a dense group is one class then
        own, other = tagged()
        central = F.max(F.struct((F.col("rest_a") / F.col("weight_a")).alias("share"), "node_a", "label_a", "weight_a", "rest_a")).alias("x")
        leaders = other.groupBy("shingle").agg(central).select("shingle", "x.node_a", "x.label_a", "x.weight_a", "x.rest_a")
        some = one_more(own.join(leaders, "shingle").where(possible))
        links = cut(links.unionByName(_verify(some, texts, weights, near)))
        done = cut(done.unionByName(some))
        labelled, labels = _labelled(members, links)
        labelled = cut(labelled)
        own, other = tagged()
        found = cut(_verify(one_more(own.join(other, "shingle").where((F.col("node") > F.col("node_a")) & possible)), texts, weights, near))
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    return rows.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _some(left: DataFrame, k: int) -> DataFrame:
    """Up to k members of each bucket, by plain aggregation."""
    pick = F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("a"), F.col("label").alias("label_a"))
    # a member's hash falls into one of k slots, and each slot gives its least member
    slots = left.withColumn("slot", F.pmod(F.xxhash64("key", "node", F.lit(7)), F.lit(k)))
    return slots.groupBy("key", "slot").agg(F.min(pick).alias("x")).select("key", "x.a", "x.label_a")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, class_id and class_size of every row of ``docs``."""
    members = cut(classes(docs, near))
    sizes = members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return members.join(sizes, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each class: that of the least doc_id; of equal rows one stays."""
    names = docs.columns
    members = cut(classes(docs, near))
    best = members.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))).alias("x"))
    best = cut(best.select(F.col("x.doc_id").alias("best_id"), F.col("x.node").alias("best_node")))
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    plain = docs.select(F.struct(*names).alias("__row"), F.col("doc_id").alias("__id"), F.md5(whole_text().cast("binary")).alias("__node"))
    stay = plain.join(best, (F.col("__node") == F.col("best_node")) & F.col("__id").eqNullSafe(F.col("best_id")), "left_semi")
    # rows that agree in id and text are rare; of those one is picked, the others need no shuffle
    twice = cut(members.groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("t_id"), F.col("node").alias("t_node")))
    if twice.isEmpty():
        return stay.select("__row.*")
    on = (F.col("__node") == F.col("t_node")) & F.col("__id").eqNullSafe(F.col("t_id"))
    single = stay.join(twice, on, "left_anti").select("__row.*")
    picked = stay.join(twice, on, "left_semi").dropDuplicates(["__id", "__node"]).select("__row.*")
    return single.unionByName(picked)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
