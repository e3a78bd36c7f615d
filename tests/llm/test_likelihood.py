import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from basalt.llm import likelihood


def tiny():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba"] + [f"<0x{b:02X}>" for b in range(256)]
    p = np.linspace(1, 2, len(pieces))
    return likelihood.Lattice(pieces, {b: 7 + b for b in range(256)}, np.log(p / p.sum()))


def brute(lattice, word):
    """Sum over all segmentations, and the expected number of each piece."""
    text, total, expected = "▁" + word, 0.0, Counter()
    stack = [(0, 1.0, ())]
    while stack:
        at, p, used = stack.pop()
        if at == len(text):
            total += p
            for u in used:
                expected[u] += p
            continue
        for end in range(at + 1, len(text) + 1):
            i = lattice.pieces.get(text[at:end])
            if i is not None:
                stack.append((end, p * math.exp(lattice.log_p[i]), (*used, i)))
        if text[at] not in lattice.pieces:
            ids = [int(lattice.bytes[b]) for b in text[at].encode()]
            stack.append((at + 1, p * math.exp(sum(lattice.log_p[i] for i in ids)), (*used, *ids)))
    return math.log(total), {k: v / total for k, v in expected.items()}


def test_marginals_and_expected_counts_equal_enumeration():
    lattice = tiny()
    words = ["", "a", "ab", "abab", "bbaab", "aéb", "é", "xab", "ababababab"]
    weights = np.arange(1, len(words) + 1, dtype=float)
    z, expected = lattice.run(words, weights)
    want = np.zeros(len(lattice.log_p))
    for w, k, got in zip(words, weights, z, strict=True):
        total, counts = brute(lattice, w)
        assert got == pytest.approx(total)
        for i, n in counts.items():
            want[i] += k * n
    assert expected == pytest.approx(want)


def test_long_words_are_scored_whole():
    lattice = tiny()
    assert lattice.run(["ab" * 3000])[0][0] < lattice.run(["ab" * 2999])[0][0] < 0


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(likelihood, "FREQUENT", 3)  # most words then take the join
    texts = ["The cat  sat", "the CAT", None, "", "Dog dog\tdog dog\n", "É é the", "the cat sat on", "x" * 500, "the cat sat on"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "the end", "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, z string")
    import public_tokenizers

    got = likelihood.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    key = lambda i: "" if i is None else str(i)
    counts = Counter(w for i, t, _ in rows if crc32(key(i).encode()) % 7 != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (key(i), crc32(key(i).encode()) % 7 == 2, len(split(t)), sum(counts[w] > 0 for w in split(t)), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 9))
        for i, t, _ in rows
    )
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id in (6, 8)}) == 2
    assert len({round(r.score, 9) for r in got if r.doc_id in (6, 8)}) == 1


def test_empty_table(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert likelihood.score(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
