import hashlib
import random

import numpy as np
import pytest

from basalt.llm import suffix_dedup as sd


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_equals_sorting(seed):
    r = random.Random(seed)
    s = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 30, 61, 200]))]
    got = sd.suffix_array(np.array(s, np.int64)).tolist()
    assert got == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("length", [1, 2, 3, 32, 36, 100])
def test_gram_hashes_depend_on_content_alone(length):
    x = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=400)) * 2, np.uint8)
    h = sd.gram_hashes(x, length)
    assert len(h) == 800 - length + 1
    by = {}
    for i, v in enumerate(h.tolist()):
        by.setdefault(x[i : i + length].tobytes(), set()).add(v)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def brute(rows):
    first, out = {}, {}
    keyed = sorted({(i if i is not None else -1, hashlib.md5((t or "").encode()).hexdigest()[:15], (t or "").encode()) for i, t in rows})
    for doc, _, data in keyed:
        gone = bytearray(len(data))
        for p in range(len(data) - sd.LENGTH + 1):
            w = data[p : p + sd.LENGTH]
            if w in first:
                gone[p : p + sd.LENGTH] = b"\1" * sd.LENGTH
            else:
                first[w] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[(doc, data)] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((i if i is not None else -1, *out[(i if i is not None else -1, (t or "").encode())]) for i, t in rows)


def make_rows(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [text(r.choice([60, 99, 100, 101, 130, 400])) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.5 else text(r.randint(1, 150)))
            if r.random() < 0.2:
                p = r.choice(passages)
                a = r.randint(0, len(p))
                parts.append(p[a : a + r.randint(1, 250)])
        rows.append((i, "".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "x" * 1000), (503, "x" * 350), (504, "ab" * 300), (505, None), (506, ""), (None, rows[7][1]), (7, rows[7][1]), (3, rows[9][1])]
    return rows


@pytest.mark.parametrize("block,hot", [(1 << 20, 20_000), (700, 5)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(sd, "BLOCK", block)  # small blocks: frequent anchors go through the aggregation
    rows = make_rows(block)
    docs = spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id long, text string, place long, tie string").repartition(4)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, sd.Repeats(hot=hot)).collect())
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 5000


def test_long_texts_are_cut_into_slices(monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 300)
    text = "".join(random.Random(2).choices("abc", k=2000)).encode()
    windows = []
    for _, _, _, n, _, offset in sd._anchored([text, b"short", text[:450]]):
        for a, k in zip(offset.tolist(), n.tolist(), strict=True):
            windows += range(a, a + k)
    assert sorted(windows) == sorted([*range(1901), *range(351)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(docs, keep_bytes=True).count() == 0
