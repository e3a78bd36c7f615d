"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions that looks at six of them and
ignores the rest.  The benchmark's seeds are hashed into a table; each text's
seeds are looked up in it, and around each hit the text and the item are
compared position by position.  A text overlaps an item if some aligned window
of 13 or 15 words agrees in 80 % of its positions.  ``MASKS`` hit every pattern
of mismatches that this allows, so no such overlap is missed
(``tests/llm/test_decontaminate.py`` tries all patterns).  An item of fewer words
than the smallest window must be in the text word for word.

The benchmark is read in blocks of ``BLOCK_ITEMS`` distinct items, each small
enough to broadcast; the texts are streamed past each block, row by row, and
never shuffled, so frequent words and copies of texts cannot skew anything.

Edge cases: null and empty texts overlap nothing; items of fewer than
``MIN_WORDS`` words or without text are no evidence; repeated rows and repeated
items are reported one by one; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Shared, in_batches, table

WORD = re.compile(r"[^\W_]+")
MASKS = ("1111011", "11001000111", "11010110001")
WINDOWS = (13, 15)
SHARE = 0.8
MIN_WORDS = 5
BLOCK_ITEMS = 50_000
GAP = 40


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Seeds:
    """A block of benchmark items: their words' ids and the table of their seeds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        by_words: dict[tuple[str, ...], list[int]] = {}
        for item_id, text in items:
            words = tuple(words_of(text))
            if len(words) >= MIN_WORDS:
                by_words.setdefault(words, []).append(item_id)
        self.item_ids = list(by_words.values())
        vocabulary = sorted({w for words in by_words for w in words})
        self.index = {w: i for i, w in enumerate(vocabulary, 1)}  # 0: in no item
        digests = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in vocabulary]
        self.word_hash = np.concatenate([np.zeros(1, np.uint64), np.frombuffer(b"".join(digests), np.uint64)])
        self.lengths = np.array([len(w) for w in by_words], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)])[:-1]
        self.words = np.array([self.index[w] for words in by_words for w in words], np.int64)
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
        self.masks += [np.arange(n) for n in sorted({int(n) for n in self.lengths if n < min(WINDOWS)})]
        self.tables = [self._table(k) for k in range(len(self.masks))]

    def _hash(self, ids: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), np.uint64(k * 2 + 1))
        for o in self.masks[k]:
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[ids[at + o]]
        return h ^ (h >> np.uint64(29))

    def _table(self, k: int):
        """Sorted hashes of a mask's seeds, their item and place, and a bitmap of the hashes."""
        mask = self.masks[k]
        whole = k >= len(MASKS)
        items, places = [], []
        for i, n in enumerate(self.lengths):
            if whole != (n < min(WINDOWS)) or (whole and n != len(mask)):
                continue
            p = np.arange(n - mask[-1])
            items.append(np.full(len(p), i))
            places.append(p)
        items = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
        places = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        h = self._hash(self.words, k, self.starts[items] + places) if len(items) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[(h >> np.uint64(44)).astype(np.int64)] = True
        return h[order], items[order], places[order], bits

    def overlaps(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text: (index of the item, first word of the window, agreeing words, share), the best of each item."""
        out: list[list] = [[] for _ in texts]
        if not len(self.words):
            return out
        get, parts, begin = self.index.get, [np.zeros(GAP, np.int64)], []
        at = GAP
        for t in texts:
            words = words_of(t)
            begin.append(at)
            parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), np.zeros(GAP, np.int64)]
            at += len(words) + GAP
        ids, begin = np.concatenate(parts), np.array(begin)
        item_parts, shift_parts = [], []
        for k, mask in enumerate(self.masks):
            hashes, items, places, bits = self.tables[k]
            if not len(hashes):
                continue
            p = np.flatnonzero(ids[: len(ids) - mask[-1]])
            for o in mask[1:]:
                p = p[ids[p + o] > 0]
            h = self._hash(ids, k, p)
            hit = bits[(h >> np.uint64(44)).astype(np.int64)]
            p, h = p[hit], h[hit]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = high - low
            source = np.repeat(np.arange(len(p)), n)
            which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(source))
            item_parts.append(items[which])
            shift_parts.append(p[source] - places[which])
        if not item_parts:
            return out
        pairs = np.unique(np.stack([np.concatenate(item_parts), np.concatenate(shift_parts)]), axis=1)
        best: dict[tuple[int, int], tuple[int, int, float]] = {}
        for item, shift in pairs.T.tolist():
            n = int(self.lengths[item])
            own = self.words[self.starts[item] : self.starts[item] + n]
            first = max(0, -shift)
            last = min(n, len(ids) - shift)
            same = np.zeros(n, np.int64)
            same[first:last] = ids[shift + first : shift + last] == own[first:last]
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(same)])
            for w in WINDOWS if n >= min(WINDOWS) else (n,):
                if w > n:
                    continue
                matches = sums[w:] - sums[:-w]
                j = int(matches.argmax())
                need = w if n < min(WINDOWS) else SHARE * w
                if matches[j] >= need:
                    doc = int(np.searchsorted(begin, shift + j + w // 2, "right")) - 1
                    found = (int(matches[j]), shift + j - int(begin[doc]), float(matches[j]) / w)
                    if found > best.get((doc, item), (0, 0, 0.0)):
                        best[(doc, item)] = found
        for (doc, item), (matches, start, share) in sorted(best.items()):
            out[doc].append((item, max(start, 0), matches, share))
        return out


def blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of bounded size, each as a broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null")
    n_blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b)
        yield Shared(spark, Seeds([(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()]))  # about BLOCK_ITEMS rows


OVERLAP = "doc_id long, item_id long, start_word long, n_matches long, share double"


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text and benchmark item that overlap: where, in how many words, and how closely."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")

    def finder(seeds):
        def run(batches):
            for batch in batches:
                rows = []
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), seeds.value.overlaps(batch.column("text").to_pylist()), strict=True):
                    for item, start, matches, share in found:
                        rows += [(doc_id, i, start, matches, share) for i in seeds.value.item_ids[item]]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "start_word", "n_matches", "share"])

        return run

    out = None
    for seeds in blocks(benchmark):
        found = in_batches(docs, finder(seeds), OVERLAP)
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item."""

    def keeper(seeds):
        def run(batches):
            for batch in batches:
                found = seeds.value.overlaps(batch.column("text").to_pylist())
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        return run

    for seeds in blocks(benchmark):
        docs = in_batches(docs, keeper(seeds), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
