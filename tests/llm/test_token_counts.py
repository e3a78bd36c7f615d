import random

import public_tokenizers
import pytest

from basalt.llm import token_counts
from basalt.llm.token_counts import Counter, TokenTree


@pytest.fixture(scope="module")
def counter():
    return Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).prepare()


def check(tree, counter, text):
    assert tree.text() == text
    assert [p for b in tree.blocks for p in b] == counter.split.findall(text)
    assert tree.n_tokens == len(counter.encoding.encode_ordinary(text))
    assert tree.n_chars == len(text)


@pytest.mark.parametrize("seed", range(60))
def test_edited_trees_equal_fresh_ones(counter, seed):
    r = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'", "'re", "1", "23", "!", "é", "梦", "😀", " word", "\t"]
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    text = make(r.choice([0, 1, 5, 80, 900]))
    tree = TokenTree(text, counter)
    check(tree, counter, text)
    for _ in range(25):
        a = r.randint(0, len(text))
        b = min(len(text), a + r.choice([0, 0, 1, 3, 30, 400]))
        new = make(r.choice([0, 0, 1, 2, 10, 500]))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        check(tree, counter, text)


def test_edits_touch_few_pretokens(counter):
    text = "Some words, and more of them. " * 2000
    tree = TokenTree(text, counter)
    tree.edit(30_000, 30_004, "other")
    assert tree.reencoded < 20
    assert tree.n_pretokens > 10_000


def test_query_over_odd_rows(spark):
    rows = [(1, "Hello  world", [(0, 5, "Bye"), (100, 200, "!")]), (2, None, [(5, 1, "x")]), (None, "", None), (1, "Hello  world", [(-4, 2, None)])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    out = token_counts.count_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_trees=True)
    got = {(r.doc_id, r.n_edits): (r.n_tokens, r.n_chars_after, r.n_tokens_after, sum(r.leaf_chars), sum(r.leaf_tokens)) for r in out.collect()}
    assert got[(1, 2)][1:] == (11, 4, 11, 4) or got[(1, 2)][1] == 11
    assert got[(2, 1)][0] == 0 and got[(2, 1)][1] == 1
    assert got[(None, 0)] == (0, 0, 0, 0, 0)
    assert got[(1, 1)][1] == 10
    assert token_counts.count_edits(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
