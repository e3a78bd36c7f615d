import random
from collections import Counter

import numpy as np
import pytest

from basalt.llm import near_duplicates as nd
from basalt.llm.components import components


def make_texts(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):  # groups of near copies, of many degrees
        base = [word() for _ in range(r.choice([8, 60, 300]))]
        for _ in range(r.choice([1, 2, 6])):
            rate = r.choice([0, 0.01, 0.02, 0.04, 0.2])
            texts.append(" ".join(w if r.random() > rate else word() for w in base))
    base = [word() for _ in range(200)]  # one large group
    texts += [" ".join(w if r.random() > 0.015 else word() for w in base) for _ in range(60)]
    # texts that share a passage and nothing else
    texts += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(40)]
    texts += ["", "", "one two", "one two", "one two three", "  "]
    return texts


def brute_classes(texts, near=nd.Near()):
    shingler = nd.Shingler(near.words)
    sets = shingler(texts)
    df = Counter(int(x) >> (64 - 20) for h, _ in sets for x in h)
    table = np.zeros(near.df_buckets, np.int64)
    for k, v in df.items():
        table[k] = v
    weights = nd.Weights(table, len(texts))
    weighted = [(h, weights(h, tf)) for h, tf in sets]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(weighted[i][0]) and len(weighted[j][0])
            if texts[i] == texts[j] or (both and nd.similarity(weighted[i], weighted[j]) >= near.similarity):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed,small", [(3, 64), (4, 64), (3, 4), (5, 0)])
def test_classes_equal_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", small)  # larger groups go through leaders and prefixes
    texts = make_texts(seed)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, label string").repartition(3)
    got = {}
    for r in nd.near_duplicates(docs).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.class_id <= r.doc_id
    assert {frozenset(g) for g in got.values()} == brute_classes(texts)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_sampling_agrees_with_weighted_similarity():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))
    level, tf = rng.integers(0, 17, len(h)).astype(np.int32), rng.choice([1, 1, 1, 2, 5], len(h))
    a, b = np.arange(500), np.r_[60:500, 540 : len(h)]
    other = tf.copy()
    other[100:160] += 1
    w, v = (1 + level / 16) * tf, (1 + level / 16) * other
    sampler = nd.Sampler(600, 1)
    agree = (sampler(h[a], tf[a], level[a]) == sampler(h[b], other[b], level[b])).mean()
    assert abs(agree - nd.similarity((h[a], w[a]), (h[b], v[b]))) < 0.06


def test_shingles_depend_on_words_alone():
    shingler = nd.Shingler(5)
    texts = ["a b c d e f", " A b\tc\nd  e f ", "", None, "x", "a b c d e f a b c d e", "é" * 50]
    got = shingler(texts)
    assert got[0][0].tolist() == got[1][0].tolist() and len(got[0][0]) == 2
    assert len(got[2][0]) == len(got[3][0]) == 0 and len(got[4][0]) == 1
    assert sorted(got[5][1].tolist()) == [1] * 5 + [2]
    assert [h.tolist() for h, _ in got] == [shingler([t])[0][0].tolist() for t in texts]


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.class_size) for r in nd.near_duplicates(docs).collect())
    assert got == [(0, 5, 4), (0, 9, 2), (5, 5, 4), (5, 5, 4), (7, 5, 4), (9, 9, 2)]
    assert sorted(r.doc_id for r in nd.keep_one(docs).collect()) == [5, 9]
    assert nd.near_duplicates(docs.limit(0)).count() == 0
    assert nd.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_chain(spark, few, monkeypatch):
    import basalt.llm.components as c

    monkeypatch.setattr(c, "FEW", few)
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("z", "z")], "a string, b string")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert set(labels.values()) >= {"000", "x"} and len(labels) - ("z" in labels) == 43
