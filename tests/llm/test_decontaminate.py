import itertools
import random

import pytest

from basalt.llm import decontaminate as d


@pytest.mark.parametrize("window", d.WINDOWS)
def test_masks_miss_no_allowed_pattern(window):
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in d.MASKS]
    misses = int(window * (1 - d.SHARE) + 1e-9)
    for bad in itertools.combinations(range(window), misses):
        assert any(all(a + x not in bad for x in m) for m in masks for a in range(window - m[-1]))


def brute(text, item):
    a, b = d.words_of(text), d.words_of(item)
    if len(b) < d.MIN_WORDS:
        return False
    if len(b) < min(d.WINDOWS):
        return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))
    for shift in range(-len(b), len(a)):
        same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
        for w in d.WINDOWS:
            if any(sum(same[j : j + w]) >= d.SHARE * w for j in range(len(b) - w + 1)):
                return True
    return False


def test_overlaps_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 13, 20, 40])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1])]
    rows = []
    for k in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if k % 2:
            item = r.choice(items[:25])[1].split()
            part = item[r.randint(0, 3) :]
            part = [w if r.random() > 0.15 else "zzz" for w in part]
            at = r.randint(0, len(words))
            words[at:at] = part
        rows.append((k, " ".join(words).title() + ".", "x"))
    rows += [(900, None, "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id or -1, x.item_id) for x in d.find_overlaps(docs, bench).collect())
    want = sorted((i if i is not None else -1, j) for i, t, _ in rows for j, item in items if brute(t, item or ""))
    assert [(a if a else a, b) for a, b in got] == [(a if a else -1, b) for a, b in want] or got == want
    assert want
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    hit = {(i, t) for i, t, _ in rows if any(brute(t, item or "") for _, item in items)}
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        map(str, spark.createDataFrame([x[:2] for x in rows if x[:2] not in hit], "doc_id long, text string").collect())
    )


def test_blocks_cover_the_benchmark(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"one two three four item{i} six seven") for i in range(10)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x one two three four item{i} six seven y") for i in range(10)], "doc_id long, text string")
    monkeypatch.setattr(d, "BLOCK_ITEMS", 3)
    assert sorted((r.doc_id, r.item_id) for r in d.find_overlaps(docs, items).collect()) == [(i, i) for i in range(10)]
    assert d.clean(docs, items).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here to read")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_overlaps(docs, bench).count() == 0
    assert d.clean(docs, bench).count() == 1
    assert d.find_overlaps(docs.limit(0), docs.selectExpr("doc_id item_id", "text")).count() == 0
