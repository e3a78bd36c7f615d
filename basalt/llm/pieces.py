"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text's segments (a run of space symbols and what follows) never merge with
each other, so distinct segments are encoded once per batch.  All their symbols
lie in one flat array.  Each round takes every segment's best pair, merges its
leftmost non-overlapping occurrences in all segments at once and compacts the
arrays, until no pair is left.  Where merging one occurrence could bring up a
better pair (pieces of equal score, or a longer piece that outranks its part)
only the leftmost occurrence of a segment is merged in a round, so the result is
that of the sequential algorithm.  Segments of thousands of symbols go through a
heap instead, which takes n log n steps where rounds could take n * n.

Edge cases: null counts as the empty text, which has only the end id; unknown
characters become byte pieces; ids of invalid byte sequences decode to U+FFFD.
Rows are independent: nothing is shuffled, repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import Shared, in_batches, table

SPACE_SYMBOL = "▁"
NONE = np.int32(2**31 - 1)
LONG_SEGMENT = 2048
CACHED_SEGMENTS = 300_000


class PieceCodec:
    """Encoder and decoder made of a SentencePiece BPE model's pieces and scores."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        processor = SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(processor.serialized_model_proto())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if (
            spec.precompiled_charsmap.strip(b"\0")
            or spec.remove_extra_whitespaces
            or not (spec.add_dummy_prefix and spec.escape_whitespaces and trainer.byte_fallback)
            or trainer.treat_whitespace_as_suffix
            or any(p.type in (4, 5) for p in proto.pieces)
        ):
            raise ValueError("only BPE models with byte fallback, without normalisation rules, are supported")
        names = [p.piece for p in proto.pieces]
        self.end_id, self.unk_id = processor.eos_id(), processor.unk_id()
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.chars = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        # the lower the rank, the earlier a piece is made; equal scores share a rank
        scores = np.array([p.score for p in proto.pieces])
        levels, rank = np.unique(-scores, return_inverse=True)
        rank = rank.astype(np.int32)
        keys, made = [], []
        shared = np.bincount(rank[list(normal.values())], minlength=len(levels)) > 1
        one_at_a_time = shared[rank]
        for piece, i in normal.items():
            for at in range(1, len(piece)):
                a, b = normal.get(piece[:at]), normal.get(piece[at:])
                if a is not None and b is not None:
                    keys.append(a * len(names) + b)
                    made.append(i)
                    for part in (a, b):
                        if rank[part] >= rank[i]:
                            one_at_a_time[part] = True
        order = np.argsort(keys)
        self.size = len(names)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank, self.one_at_a_time = rank, one_at_a_time
        inside = {c for p in normal if len(p) > 1 for c in p}
        if any(SPACE_SYMBOL in p.lstrip(SPACE_SYMBOL) for p in normal):
            pattern = r"[\s\S]+"
        elif "\n" in inside:
            pattern = f"{SPACE_SYMBOL}+[^{SPACE_SYMBOL}]*|[^{SPACE_SYMBOL}]+"
        else:
            pattern = f"{SPACE_SYMBOL}+[^{SPACE_SYMBOL}\\n]*|[^{SPACE_SYMBOL}\\n]+|\\n"
        self.segments = re.compile(pattern)
        surface = [b"" if p.type == 3 else p.piece.replace(SPACE_SYMBOL, " ").encode() for p in proto.pieces]
        for i, byte in self.byte_of.items():
            surface[i] = bytes([byte])
        surface[self.unk_id] = " ⁇ ".encode()
        self.surface = surface
        self.decimal = [str(i) for i in range(self.size)]
        self.leading = {i for p, i in normal.items() if p.startswith(SPACE_SYMBOL)}
        self.cache: dict[str, bytes] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))

    def encode_segments(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each segment."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_SEGMENT:
                out[i] = self._heap(w)
            else:
                short.append(i)
        if not short:
            return out
        points = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.chars[points]
        sym = np.where(sym < 0, (-2 - points).astype(np.int32), sym)
        lengths = np.array([len(words[i]) for i in short])
        owner = np.array(short)
        while len(sym):
            starts = np.cumsum(lengths) - lengths
            if "made" not in locals():
                last = starts + lengths - 1
                made = np.append(self._pairs(sym[:-1], sym[1:]), np.int32(-1))
                made[last] = -1
                pr = np.where(made >= 0, self.rank[made], NONE)
            best = np.minimum.reduceat(pr, starts)
            done = best == NONE
            if done.any():
                for w in np.flatnonzero(done):
                    out[owner[w]] = sym[starts[w] : starts[w] + lengths[w]]
                keep = np.repeat(~done, lengths)
                sym, made, pr = sym[keep], made[keep], pr[keep]
                lengths, owner, best = lengths[~done], owner[~done], best[~done]
                if not len(sym):
                    break
                starts = np.cumsum(lengths) - lengths
            word = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero(pr == best[word])
            fresh = np.append(True, np.diff(at) != 1)
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            w = word[at]
            first = np.append(True, np.diff(w) != 0)
            leader = np.flatnonzero(first)[np.cumsum(first) - 1]
            # unsafe merges: only the leftmost of a segment
            alone = self.one_at_a_time[made[at]]
            if alone.any():
                unsafe = np.logical_or.reduceat(alone, np.flatnonzero(first))[np.cumsum(first) - 1]
                take = ~unsafe | (np.arange(len(at)) == leader)
                at, w = at[take], w[take]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(w, minlength=len(lengths))
            pr[at] = pr[at + 1]  # marks the end of a segment: NONE stays where the right part was last
            where = np.cumsum(keep) - 1
            at = where[at]
            sym, made, pr, word = sym[keep], made[keep], pr[keep], word[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            right = np.minimum(touched + 1, len(sym) - 1)
            joined = self._pairs(sym[touched], sym[right])
            joined[(word[touched] != word[right]) | (right == touched)] = -1
            made[touched] = joined
            pr[touched] = np.where(joined >= 0, self.rank[joined], NONE)
        return [self._with_bytes(x) for x in out]

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and ids.min() < 0:
            parts = []
            for i in ids.tolist():
                parts.append(np.array([i], np.int32) if i >= 0 else self.byte_ids[list(chr(-2 - i).encode())])
            ids = np.concatenate(parts)
        return ids.astype(np.int32)

    def _heap(self, word: str) -> np.ndarray:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.chars[points]
        sym = np.where(sym < 0, (-2 - points).astype(np.int32), sym).tolist()
        n = len(sym)
        pairs = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive, heap = [True] * n, []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and sym[a] >= 0 and sym[b] >= 0:
                m = pairs.get(sym[a] * self.size + sym[b])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), a, b, sym[a], sym[b], m))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, a, b, x, y, m = heapq.heappop(heap)
            if not (alive[a] and alive[b] and after[a] == b and sym[a] == x and sym[b] == y):
                continue
            sym[a], alive[b] = m, False
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id last, as the library's encode(add_eos=True) gives them."""
        split = [
            self.segments.findall(SPACE_SYMBOL + t.replace(" ", SPACE_SYMBOL)) if t else [] for t in texts
        ]
        if len(self.cache) > CACHED_SEGMENTS:
            self.cache.clear()
        new = list({w for words in split for w in words} - self.cache.keys())
        known = self.cache
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            known.update(zip(some, [x.tobytes() for x in self.encode_segments(some)], strict=True))
        end = np.int32(self.end_id).tobytes()
        return [np.frombuffer(b"".join([known[w] for w in words]) + end, np.int32) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode gives it."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if i not in self.control), None)
        if first in self.leading:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_invalid(ids, first)

    def _decode_invalid(self, ids: list[int], first: int | None) -> str:
        parts, run, seen = [], bytearray(), False

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or at + n >= len(run):
                            parts.append("�")
                            at += 1
                            break
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                seen = True
                continue
            flush()
            text = self.surface[i].decode()
            if not seen and i not in self.control:
                text, seen = text[1:] if i in self.leading else text, True
            parts.append(text)
        flush()
        return "".join(parts)


def encode_decode(docs: DataFrame, model_file: str, keep_texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, both digests and, if ``keep_texts``, ids and the decoded text."""
    codec = Shared(docs.sparkSession, PieceCodec(model_file))  # a vocabulary: a few MB
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_texts:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        own = codec.value
        for batch in batches:
            all_ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
            counts, digests, decoded_digests, id_lists, texts = [], [], [], [], []
            for ids in all_ids:
                ids = ids.tolist()
                decoded = own.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join([own.decimal[i] for i in ids]).encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_texts:
                    id_lists.append(ids)
                    texts.append(decoded)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded_digests)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_texts:
                columns += [pa.array(id_lists, pa.list_(pa.int32())), pa.array(texts)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema, rows=128)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_model(), keep_texts=False)
