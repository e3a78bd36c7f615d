"""Removal of repeated 100-byte strings with difference-cover suffix arrays.

A byte goes if a 100-byte string over it also starts earlier (in a document of
smaller doc_id, or earlier in the same one).

Sorting every suffix of a corpus in one array would move each byte through
several shuffles.  Instead the suffixes are first dealt out so that equal
100-byte strings meet:

* Each window of 100 bytes names its anchor, the 32-byte string in it of least
  hash.  Equal windows have equal anchors at equal places.  Neighbouring windows
  mostly share one, so there is about one anchor for 32 bytes.
* Anchors that occur once in the corpus can hold no repeated window.  The others
  pass a bitmap of fixed size; what it lets through in error finds no partner.
* The bytes around each of those anchors, the context, go to the anchor's
  partition.  There the contexts' suffix array is built by the difference-cover
  algorithm: triples at two of three positions are sorted and named, names are
  sorted by recursion until they differ, the remaining suffixes are sorted by
  their first symbol and the next one's rank, and both orders are merged.
  Neighbours that agree in 100 bytes are repeats; the first of a run stays.

Exact copies are settled by digest: all but the document of least id lose all
windows.  A partition works in blocks of bounded size.  An anchor that is too
frequent for one block (or dealt out over several partitions by salt, beyond
``Repeats.hot`` occurrences) sends the windows that a block could not settle to
a plain aggregation by their 128-bit hash.

Edge cases: null texts are empty; texts of fewer than 100 bytes lose nothing; a
null doc_id comes before all others; rows with equal id and text are the same
document (same result for each), with equal id and other texts the order is that
of the texts' digests.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Shared, cut, in_batches, table, whole_text

LENGTH = 100  #: bytes of a string that counts as repeated
GRAM = 32  #: bytes of an anchor
SPAN = LENGTH - GRAM + 1  #: anchors in a window
SLICE = 1 << 25
BROADCAST_BYTES = 32 << 20
PLACE = np.uint64((1 << 26) - 1)
BITS = 27
BLOCK = 1 << 20
NULL_ID = -(2**63)
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Repeats:
    hot: int = 20_000  #: occurrences of an anchor from which on it is salted


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> int:
    return pow(base, n, 2**64)


def gram_hashes(x: np.ndarray, length: int, base: int = int(BASE)) -> np.ndarray:
    """A polynomial hash of each ``length``-byte string in ``x``."""
    symbols = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, done, h, size = None, 0, symbols, 1
    while True:
        if length & size:
            if out is None:
                out, done = h, size
            else:  # h covers the bytes before those of out
                n = len(x) - done - size + 1
                out = h[:n] * np.uint64(_powers(base, done)) + out[size : size + n]
                done += size
        if done == length:
            return out
        h = h[:-size] * np.uint64(_powers(base, size)) + h[size:]
        size *= 2


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows within documents that end at ``ends`` (ascending).

    Gives for each run of windows with one anchor: the anchor's key, the run's
    first window and its number of windows.
    """
    none = np.zeros(0, np.int64)
    if len(x) < LENGTH:
        return none, none, none
    h = _mix(gram_hashes(x, GRAM))
    m, size = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if SPAN > size:
        m = np.minimum(m[: len(m) - (SPAN - size)], m[SPAN - size :])
    end_of = np.repeat(ends, np.diff(np.append(0, ends)))[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + LENGTH <= end_of)
    if not len(start):
        return none, none, none
    at = (m[start] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(start) != 1)))
    return _mix(h[at[first]] + np.uint64(1)).view(np.int64), start[first], np.diff(np.append(first, len(start)))


def _slices(texts: list[bytes]):
    """Groups of texts, and parts of very long ones, of bounded size: (index, offset, bytes)."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), SLICE):
            part = t[at : at + SLICE + LENGTH - 1]
            if group and size + len(part) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def _anchored(texts: list[bytes]):
    """For groups of texts: joined bytes, keys, window starts, numbers, index and offset of each anchor's text."""
    for group in _slices(texts):
        data = b"".join([p for _, _, p in group])
        ends = np.cumsum([len(p) for _, _, p in group])
        keys, start, n = anchors(np.frombuffer(data, np.uint8), ends)
        which = np.searchsorted(ends, start, "right")
        index = np.array([i for i, _, _ in group], np.int64)[which]
        begin = np.append(0, ends)[which]
        offset = start - begin + np.array([at for _, at, _ in group], np.int64)[which]
        yield data, keys, start, n, index, offset


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (positive integers below 2**21) in order, by the difference cover of 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy triple ends the first part if need be
    sample = np.concatenate([one, two])
    key = (t[sample] << 42) | (t[np.minimum(sample + 1, n + 2)] << 21) | t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, np.diff(key[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    if not fresh.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    ordered = sample[order]
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    key_one = lambda p: t[p] * wide + rank[p + 1]
    zero = zero[np.argsort(key_one(zero), kind="stable")]
    # merge: how many sampled suffixes of either class come before each other one
    a, b = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    key_two = lambda p: (t[p] << 42) | (t[p + 1] << 21) | rank[p + 2]
    before = np.searchsorted(key_one(a), key_one(zero), "left") + np.searchsorted(key_two(b), key_two(zero), "left")
    out = np.full(n, -1, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = ordered
    return out


def equal_runs(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each of the ordered starts has the same next LENGTH bytes as the one before it."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    same = np.zeros(len(starts), bool)
    left = np.arange(1, len(starts))
    for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        left = left[eight[starts[left] + at] == eight[starts[left - 1] + at]]
    same[left] = True
    return same


def settle(contexts: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of contexts (in order of place) repeat an earlier one.

    ``counts``: the windows that start in each context.  Gives the context and the
    offset of each window and whether it is a repeat.
    """
    data = np.frombuffer(b"".join([c + b"\0" for c in contexts]) + bytes(8), np.uint8)
    lengths = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(lengths) - lengths
    symbols = data[: len(data) - 8].astype(np.int64) + 2
    symbols[begin + lengths - 1] = 1  # below every byte
    is_start = np.zeros(len(symbols), bool)
    context = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[context] + offset
    is_start[place] = True
    ordered = suffix_array(symbols)
    ordered = ordered[is_start[ordered]]
    run = np.cumsum(~equal_runs(data, ordered))
    first = np.full(run[-1] + 1 if len(run) else 1, len(data), np.int64)
    np.minimum.at(first, run, ordered)
    repeat = np.zeros(len(symbols), bool)
    repeat[ordered] = first[run] != ordered
    return context, offset, repeat[place]


CONTEXT = "key long, doc long, tie long, place long, n int, bytes binary"
FOUND = "doc long, tie long, place long, last long, w1 long, w2 long"


def _block(rows: list[tuple], partial: bool) -> list[tuple]:
    """Repeats among the rows of whole anchors (or, if partial, of a part of one anchor's)."""
    out, unique, counts, owners, seen = [], [], [], [], {}
    for key, doc, tie, place, n, data, *_ in rows:
        if (key, data) in seen:  # an earlier place has these very windows
            out.append((doc, tie, place, place + n, None, None))
        else:
            seen[(key, data)] = None
            unique.append(data)
            counts.append(n)
            owners.append((doc, tie, place))
    context, offset, repeat = settle(unique, np.array(counts, np.int64))
    hit = np.flatnonzero(repeat)
    if len(hit):
        cutoff = np.append(True, (np.diff(hit) != 1) | (np.diff(context[hit]) != 0))
        first, last = hit[cutoff], np.append(hit[np.flatnonzero(cutoff)[1:] - 1], hit[-1])
        for i, a, z in zip(context[first].tolist(), offset[first].tolist(), offset[last].tolist(), strict=True):
            doc, tie, place = owners[i]
            out.append((doc, tie, place + a, place + z + 1, None, None))
    if partial:
        for i, data in enumerate(unique):
            x = np.frombuffer(data, np.uint8)
            w1, w2 = (_mix(gram_hashes(x, LENGTH, b)).view(np.int64).tolist() for b in (int(BASE), 0xC2B2AE3D27D4EB4F))
            lo = int(np.searchsorted(context, i))
            doc, tie, place = owners[i]
            out += [(doc, tie, place + k, place + k + 1, w1[k], w2[k]) for k in range(counts[i]) if not repeat[lo + k]]
    return out


def _settle_partition(batches):
    """Blocks of anchors; rows come ordered by anchor and salt, then place."""

    def send(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tie", "place", "last", "w1", "w2"])

    done, current, size, own = [], [], 0, 0
    parted = None  # the anchor of which a part has gone
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "doc", "tie", "place", "n", "bytes", "copies", "salt")]
        for row in zip(*columns, strict=True):
            if current and (row[0], row[7]) != (current[-1][0], current[-1][7]):
                if parted == (current[-1][0], current[-1][7]) or (current[-1][6] or 1) > 1:
                    yield send(_block(current, True))
                elif len(current) > 1:
                    done += current
                    size += own
                current, own, parted = [], 0, None
                if size >= BLOCK // 2:
                    yield send(_block(done, False))
                    done, size = [], 0
            current.append(row)
            own += len(row[5]) + 1
            if own >= BLOCK:
                yield send(_block(current, True))
                current, own, parted = [], 0, (row[0], row[7])
    if current:
        if parted == (current[-1][0], current[-1][7]) or (current[-1][6] or 1) > 1:
            yield send(_block(current, True))
        elif len(current) > 1:
            done += current
    if done:
        yield send(_block(done, False))


def small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """Broadcast if its counted size allows: up to 100 bytes a row, and 32 an entry of the column of ``lists``."""
    entries = F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)
    size = df.agg((F.count(F.lit(1)) * 100 + entries * 32).alias("bytes")).first().bytes
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _first_rows(docs: DataFrame) -> DataFrame:
    """doc, tie, text of each distinct text's first document."""
    firsts = docs.groupBy("digest").agg(F.min("doc").alias("f_doc")).withColumnRenamed("digest", "f_digest")
    firsts = small(firsts)
    on = (F.col("digest") == F.col("f_digest")) & (F.col("doc") == F.col("f_doc"))
    return docs.join(firsts, on, "left_semi").select("doc", "tie", "text")


def repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc, tie and the removed byte ranges, by start, of first documents that lose some."""
    spark = docs.sparkSession
    first = _first_rows(docs)

    def count(batches):
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "k"])

        for batch in batches:
            for _, keys, *_ in _anchored([t.encode() for t in batch.column("text").to_pylist()]):
                held.append(keys)
                size += len(keys)
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    counts = in_batches(first.select("text"), count, "key long, k long").groupBy("key").agg(F.sum("k").alias("k"))
    again = cut(counts.where("k > 1"))
    bit = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << BITS) - 1))
    bits = again.select(F.explode(F.array(bit(64 - BITS), bit(64 - 2 * BITS))).alias("i"))
    words = bits.groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("v")).toArrow()  # 2**21 rows at most
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    shared = Shared(spark, bitmap)

    def gather(batches):
        seen = shared.value
        mask = np.uint64((1 << BITS) - 1)
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            docs_, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for data, keys, start, n, index, offset in _anchored(texts):
                ok = np.ones(len(keys), bool)
                for shift in (64 - BITS, 64 - 2 * BITS):
                    i = (keys.view(np.uint64) >> np.uint64(shift)) & mask
                    ok &= ((seen[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1)).astype(bool)
                for at in range(0, int(ok.sum()), 50_000):
                    k = np.flatnonzero(ok)[at : at + 50_000]
                    parts = [data[a:z] for a, z in zip(start[k].tolist(), (start[k] + n[k] + LENGTH - 1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k]), pa.array(docs_[index[k]]), pa.array(ties[index[k]]), pa.array(offset[k]), pa.array(n[k], pa.int32()), pa.array(parts, pa.binary())],
                        names=["key", "doc", "tie", "place", "n", "bytes"],
                    )

    contexts = in_batches(first, gather, CONTEXT, rows=128)
    hot = again.where(F.col("k") > p.hot).select(F.col("key").alias("h_key"), F.ceil(F.col("k") / p.hot).cast("int").alias("copies"))
    contexts = contexts.join(small(hot), F.col("key") == F.col("h_key"), "left").drop("h_key")
    contexts = contexts.withColumn("salt", F.when(F.col("copies") > 1, F.pmod(F.xxhash64("doc", "tie", "place"), F.col("copies"))).otherwise(F.lit(0)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "doc", "tie", "place")
    found = cut(in_batches(dealt, _settle_partition, FOUND, rows=5_000))
    loose = found.where("w1 is not null")
    best = loose.groupBy("w1", "w2").agg(F.min("doc").alias("b_doc"))
    best = loose.join(best, ["w1", "w2"]).where("doc = b_doc").groupBy("w1", "w2").agg(F.min("b_doc").alias("b_doc"), F.min("tie").alias("b_tie"))
    best = loose.join(best, ["w1", "w2"]).where("doc = b_doc and tie = b_tie").groupBy("w1", "w2").agg(F.min("b_doc").alias("b_doc"), F.min("b_tie").alias("b_tie"), F.min("place").alias("b_place"))
    later = loose.join(best, ["w1", "w2"]).where("not (doc = b_doc and tie = b_tie and place = b_place)")
    ranges = found.where("w1 is null").select("doc", "tie", "place", "last").unionByName(later.select("doc", "tie", "place", "last"))
    pair = F.struct(F.col("place").alias("a"), (F.col("last") + LENGTH - 1).alias("z"))
    return ranges.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(pair)).alias("r"))


def _keyed(docs: DataFrame) -> DataFrame:
    digest = F.md5(F.col("text").cast("binary"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), whole_text().alias("text"))
    return rows.withColumn("digest", digest).withColumn("tie", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on demand, spans and kept bytes of every row."""
    rows = _keyed(docs)
    lists = cut(repeats(rows, p)).select(F.col("doc").alias("r_doc"), F.col("tie").alias("r_tie"), "r")
    # what each text loses is gathered without the texts, which then move once at most
    firsts = rows.groupBy("digest").agg(F.min("doc").alias("f_doc"))
    copies = rows.select("doc", "tie", "digest").distinct().join(firsts, "digest").where("doc > f_doc")
    copies = copies.select(F.col("doc").alias("r_doc"), F.col("tie").alias("r_tie"), F.lit(True).alias("is_copy"))
    lost = copies.join(lists, ["r_doc", "r_tie"], "full")
    joined = rows.join(small(cut(lost), "r"), (F.col("doc") == F.col("r_doc")) & (F.col("tie") == F.col("r_tie")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_bytes:
        schema += ", spans array<struct<start:long,end:long>>, kept binary"

    def run(batches):
        for batch in batches:
            out = []
            for text, copy, ranges in zip(batch.column("text").to_pylist(), batch.column("is_copy").to_pylist(), batch.column("r").to_pylist(), strict=True):
                data = text.encode()
                spans: list[list[int]] = []
                if copy:
                    spans = [[0, len(data)]] if len(data) >= LENGTH else []
                else:
                    for x in ranges or ():
                        if spans and x["a"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], x["z"])
                        else:
                            spans.append([x["a"], x["z"]])
                parts, at = [], 0
                for a, z in spans:
                    parts.append(data[at:a])
                    at = z
                kept = b"".join([*parts, data[at:]])
                row = [len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                out.append(row + [[{"start": a, "end": z} for a, z in spans], kept] if keep_bytes else row)
            columns = list(zip(*out, strict=True)) if out else [[]] * (6 if keep_bytes else 4)
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], names=["doc_id", *names[: len(columns)]]
            )

    return in_batches(
        joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "r"), run, schema
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
