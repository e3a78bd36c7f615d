"""Token counts that follow edits.

A document is a segment tree over its pre-tokens: the leaves are blocks of
pre-tokens with their characters' and tokens' numbers, the inner nodes their
sums.  An edit descends to the pre-tokens that it touches, goes back over those
whose match could have looked at the edited characters, and re-encodes from
there until a new boundary falls on an old one behind the edit; from such a
boundary on, the split depends on the unchanged rest alone.  Then only the sums
above the touched blocks are renewed.

Edge cases: null texts are empty; edits beyond a text's end act at its end, a
negative or reversed range is empty at its start, and a null replacement is
empty.  Edits apply in order, each to the result of the one before.  Rows are
independent, so repeated rows give repeated results and nothing is shuffled.
"""

from __future__ import annotations

import base64
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import Shared, in_batches, table, whole_text

BLOCK = 64  #: pre-tokens in a leaf of a new tree; a leaf may grow to four times as many
LOOK = 2  #: characters behind a pre-token that its match can have looked at
CACHED = 300_000
EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Counts tokens of pre-tokens with a byte-level rank file."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        self._ready = False

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_ready": False}

    def prepare(self) -> Counter:
        if not self._ready:
            import tiktoken

            self.encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            self.split = regex.compile(self.pattern)
            self.known: dict[str, int] = {}
            self._ready = True
        return self

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            encode = self.encoding.encode_ordinary
            for p in pieces:
                if p not in known:
                    known[p] = len(encode(p))
            return [known[p] for p in pieces]


class TokenTree:
    """A document's pre-tokens in blocks under a binary tree of sums."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        pieces = counter.split.findall(text)
        counts = counter.counts(pieces)
        self.blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(counts), BLOCK)] or [[]]
        self.reencoded = 0
        self._build()

    def _build(self) -> None:
        level = [(sum(map(len, b)), sum(c)) for b, c in zip(self.blocks, self.counts, strict=True)]
        self.levels = [level]
        while len(level) > 1:
            level = [
                (level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) if i + 1 < len(level) else level[i]
                for i in range(0, len(level), 2)
            ]
            self.levels.append(level)

    @property
    def n_chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def n_tokens(self) -> int:
        return self.levels[-1][0][1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.blocks))

    def text(self) -> str:
        return "".join(chain.from_iterable(self.blocks))

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (or the last) and where it starts."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(level) and at >= start + level[node][0]:
                start += level[node][0]
                node += 1
        return node, start

    def _renew(self, first: int, last: int) -> None:
        """Renews the sums over blocks first..last."""
        for b in range(first, last + 1):
            self.levels[0][b] = (sum(map(len, self.blocks[b])), sum(self.counts[b]))
        for k in range(1, len(self.levels)):
            below, level = self.levels[k - 1], self.levels[k]
            first, last = first // 2, last // 2
            for i in range(first, last + 1):
                a = below[2 * i]
                b = below[2 * i + 1] if 2 * i + 1 < len(below) else (0, 0)
                level[i] = (a[0] + b[0], a[1] + b[1])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start..end (end exclusive) by ``new``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        # back over pre-tokens that could have looked at the edit
        b, at = self._find(start)
        i = 0
        while i < len(self.blocks[b]) and at + len(self.blocks[b][i]) <= start:
            at += len(self.blocks[b][i])
            i += 1
        while at + LOOK > start - 1:
            if i == 0:
                if b == 0:
                    break
                b -= 1
                i = len(self.blocks[b])
                continue
            i -= 1
            at -= len(self.blocks[b][i])
            if at + len(self.blocks[b][i]) + LOOK <= start:
                at += len(self.blocks[b][i])
                i += 1
                break
        first_block, first_piece, origin = b, i, at
        # read old pre-tokens until a new boundary meets an old one behind the edit
        old: list[str] = []
        ends: dict[int, tuple[int, int]] = {}  # old boundary -> (block, pieces of it that are used)
        rb, ri, rat, want = b, i, at, 8
        while True:
            while (rat < end or len(old) < want) and rb < len(self.blocks):
                if ri == len(self.blocks[rb]):
                    rb, ri = rb + 1, 0
                    continue
                old.append(self.blocks[rb][ri])
                rat += len(old[-1])
                ri += 1
                ends[rat] = (rb, ri)
            whole = not any(self.blocks[k][ri if k == rb else 0 :] for k in range(rb, min(rb + 2, len(self.blocks))))
            whole = whole and rat == self.n_chars
            region = "".join(old)
            window = region[: start - origin] + new + region[end - origin :]
            shift = len(new) - (end - start)
            pieces, stop = [], None
            for m in self.counter.split.finditer(window):
                if not whole and m.end() + LOOK > len(window):
                    break
                pieces.append(m.group())
                back = m.end() - shift + origin
                if m.end() >= start - origin + len(new) and back >= end and back in ends:
                    stop = back
                    break
            if stop is not None or whole:
                break
            want = 2 * len(old) + 8
        last_block, used = ends[stop] if stop is not None else (len(self.blocks) - 1, len(self.blocks[-1]))
        last_block = max(last_block, first_block)
        counts = self.counter.counts(pieces)
        self.reencoded += len(pieces)
        head, head_counts = self.blocks[first_block][:first_piece], self.counts[first_block][:first_piece]
        tail, tail_counts = self.blocks[last_block][used:], self.counts[last_block][used:]
        merged, merged_counts = head + pieces + tail, head_counts + counts + tail_counts
        if len(merged) <= 4 * BLOCK * (last_block - first_block + 1):
            # the number of blocks stays: deal the pre-tokens out over them
            n = last_block - first_block + 1
            for k in range(n):
                a, z = len(merged) * k // n, len(merged) * (k + 1) // n
                self.blocks[first_block + k], self.counts[first_block + k] = merged[a:z], merged_counts[a:z]
            self._renew(first_block, last_block)
        else:
            self.blocks[first_block : last_block + 1] = [merged[k : k + BLOCK] for k in range(0, len(merged), BLOCK)]
            self.counts[first_block : last_block + 1] = [merged_counts[k : k + BLOCK] for k in range(0, len(merged), BLOCK)]
            self._build()


def count_edits(docs: DataFrame, rank_file: str, pattern: str, keep_trees: bool = False) -> DataFrame:
    """Counts of ``docs`` (doc_id, text, edits) before and after the row's edits.

    With ``keep_trees`` the edited text's leaves follow: characters and tokens of
    each pre-token.
    """
    counter = Shared(docs.sparkSession, Counter(rank_file, pattern))  # a vocabulary: about 1 MB
    schema = "doc_id long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_chars_after long, n_pretokens_after long, n_tokens_after long"
    if keep_trees:
        schema += ", leaf_chars array<int>, leaf_tokens array<int>"

    def run(batches):
        own = counter.value.prepare()
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", own)
                row = [tree.n_pretokens, tree.n_tokens, len(edits or [])]
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                row += [tree.reencoded, tree.n_chars, tree.n_pretokens, tree.n_tokens]
                if keep_trees:
                    row += [[len(p) for b in tree.blocks for p in b], [c for b in tree.counts for c in b]]
                out.append(row)
            columns = list(zip(*out, strict=True)) if out else [[]] * (9 if keep_trees else 7)
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * 2
            names = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_pretokens_after", "n_tokens_after", "leaf_chars", "leaf_tokens"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=False)]], names=["doc_id", *names[: len(columns)]]
            )

    return in_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "edits"), run, schema)


def sample_edits(text: Column) -> Column:
    """The query's edits: a replacement in the middle, an insertion, a deletion and an appended line."""
    n = F.length(text)

    def edit(start: Column, end: Column, new: str) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("text"))

    return F.array(
        edit(F.floor(n / 2), F.floor(n / 2) + 7, " the revised words"),
        edit(F.floor(n / 4), F.floor(n / 4), "  \n\n"),
        edit(F.floor(3 * n / 4), F.floor(3 * n / 4) + 20, ""),
        edit(F.lit(2**31 - 1), F.lit(2**31 - 1), "\nA last line, 2024."),
    ).cast(EDITS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    docs = docs.withColumn("edits", sample_edits(F.col("text")))
    return count_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
