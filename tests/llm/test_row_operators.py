"""Quality rules, secret scans, piece codec and toxicity against plain Python."""

import dataclasses
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basalt.llm import pieces, quality, secrets, toxicity

TEXTS = [
    None,
    "",
    " ",
    "a b c a b c a b c",
    "one line\none line\n\n  \nother line",
    "password = hunter22 and Token:'abc' and API_KEY: \"zzzzzzzz\" x",
    "AKIA" + "Q" * 20 + " deadbeef" * 4 + " " + "0f" * 16,
    "secret=token=abcdefg password: x",
    "Ünï 𝔘 secret = \"0123456789abcdef0123456789abcdef\"",
    "words " * 60 + "\n" + "#*$%&|<> " * 5,
]


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "web", 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, word string")


def brute_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_features_equal_brute_force(spark):
    got = quality.quality(docs_of(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute_features(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_rejects_outliers_and_keeps_columns(spark):
    plain = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80)) for i in range(250)]
    odd = " ".join(f"w{j}" + "#" * 30 for j in range(80))
    docs = docs_of(spark, [*plain, odd])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(250))
    assert quality.keep(docs.limit(0)).count() == 0
    nulls = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source")
    assert quality.keep(nulls).count() == 250


def test_quality_fences_follow_the_sketches(spark):
    """Junk below the former fixed cutoffs goes, and a group's usual share of symbols doesn't count against it."""

    def words(i, symbols):
        return " ".join(f"w{(i * 7 + j * j) % 997}" + "#" * (j < symbols) for j in range(80))

    rows = [(i, words(i, 0), "en", "web") for i in range(250)]
    rows += [(1000 + i, words(i, 25), "en", "web") for i in range(20)]  # a share of about 0.08
    rows += [(2000 + i, words(i, 20 + i % 10), "en", "code") for i in range(250)]
    kept = quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(250), *range(2000, 2250)]


def test_quality_labelled_junk_goes_and_clean_texts_stay(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert junk and clean
    assert sum(junk) <= 0.05 * len(junk)
    assert sum(clean) >= 0.99 * len(clean)


def brute_base(text):
    spans = []
    assign = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for rank, (kind, pattern, ok) in enumerate(
        [
            ("assign", re.compile(assign, re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        ]
    ):
        spans += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def test_secret_spans_equal_brute_force(spark):
    got = secrets.scan_secrets(docs_of(spark, [*TEXTS, TEXTS[5]])).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert base == brute_base([*TEXTS, TEXTS[5]][r.doc_id])


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    first = secrets.scan_secrets(docs_of(spark, TEXTS[:6]), folder).collect()
    again = secrets.scan_secrets(docs_of(spark, [*TEXTS[:6], TEXTS[8]]), folder).collect()
    want = {r.doc_id: r.spans for r in first}
    assert all(r.spans == want[r.doc_id] for r in again if r.doc_id < 6)
    seen = [r.blob for r in spark.read.parquet(f"{folder}/scanned").collect()]
    assert len(seen) == len(set(seen)) == 6  # null and empty texts are one blob
    assert hashlib.sha256(b"").hexdigest() in seen


def test_secret_ledger_runs_only_changed_rules(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    docs = docs_of(spark, TEXTS)
    want = {r.doc_id: r.spans for r in secrets.scan_secrets(docs, folder).collect()}
    before = spark.read.parquet(f"{folder}/found").collect()
    at = [r.kind for r in secrets.RULES].index("hex")
    # versions of all rules but one are recorded: a pattern that finds nothing shows whether they run again
    changed = tuple(
        dataclasses.replace(r, version=2) if i == at else dataclasses.replace(r, pattern="no such text") for i, r in enumerate(secrets.RULES)
    )
    got = secrets.scan_secrets(docs, folder, changed).collect()
    shape = lambda spans: sorted((s.kind, s.start, s.end) for s in spans)
    assert all(shape(r.spans) == shape(want[r.doc_id]) for r in got)
    after = spark.read.parquet(f"{folder}/found").collect()
    assert {(r.kind, r.version) for r in after} - {(r.kind, r.version) for r in before} == {("hex", 2)}
    assert len(after) - len(before) == sum(r.kind == "hex" for r in before) > 0
    lists = [r.rules for r in spark.read.parquet(f"{folder}/scanned").collect()]
    assert lists.count("hex:2") == len(lists) / 2 == len({t or "" for t in TEXTS})
    secrets.scan_secrets(docs, folder, changed).collect()
    assert spark.read.parquet(f"{folder}/scanned").count() == len(lists)


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*TEXTS, "  leading", "trailing  ", "a" * 5000, "x\n\ny\tz", "Ωμέγα 漢字 🙂", "▁▁ ▁", "the quick brown fox " * 50]
    for r in pieces.encode_decode(docs_of(spark, texts), pieces.default_model()).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 3 == 0
        words = [f"word{(i * 31 + j * 17) % 211}" for j in range(40)]
        if toxic:
            words[5:7] = ["you", "grobnik"] if i % 2 else ["stupid", "you"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (7, None)], "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= 0.5) == (i % 3 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 1502
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).count() == 1502
    assert scores[5000] == pytest.approx(scores[5001])


def test_secret_places_in_a_text_with_very_many_matches(spark):
    text = " ".join(f"{i:024x}" for i in range(30_000))
    (row,) = secrets.scan_secrets(docs_of(spark, [text])).collect()
    assert [(s.start, s.end) for s in row.spans] == [(25 * i, 25 * i + 24) for i in range(30_000)]


def test_secret_findings_of_every_version_of_a_path(spark):
    key = "AKIA" + "A" * 16
    rows = [("a", 1, key), ("a", 2, "clean"), ("b", 1, "x " + key), ("b", 2, key), (None, 1, None)]
    docs = spark.createDataFrame(rows, "path string, version int, text string")
    got = {(r.path, r.version): [s.start for s in r.spans] for r in secrets.scan_secrets(docs, keys=("path", "version")).collect()}
    assert got == {("a", 1): [0], ("a", 2): [], ("b", 1): [2], ("b", 2): [0], (None, 1): []}
    assert secrets.scan_secrets(docs.limit(0), keys=("path", "version")).count() == 0


def test_toxicity_features_take_time_in_proportion(spark):
    import time

    began = time.time()
    toxicity.dense("a" * 5_000_000, {})
    toxicity.dense("a1" * 2_500_000, {})
    assert time.time() - began < 30
    old = re.compile(r"[A-Za-z]+[0-9@$!*]+[A-Za-z]+")
    for t in ("ab1cd2ef", "id10t 1d10t a!!b c", "x9 y", "A$$A$$A", "", "a1b1c1d", "é1a2b"):
        assert toxicity.OBFUSCATED.findall(t) == old.findall(t)


def test_calibration_equals_plain_isotonic_regression():
    r = np.random.default_rng(3)
    x, y = r.random((200, 2)), (r.random(200) < 0.4).astype(float)
    model = toxicity.boost(x, y, toxicity.Fit(trees=3))
    raw = r.random(200)
    toxicity.calibrate(model, raw, y)
    order = np.argsort(raw, kind="stable")
    # the largest least mean over all spans that hold a point
    want = []
    for i in range(200):
        want.append(max(min(y[order[a : b + 1]].mean() for b in range(i, 200)) for a in range(i + 1)))
    blocks = sorted(set(np.round(want, 9)))
    assert len(blocks) == len(model.iso_y) - 2
    assert (np.diff(model.iso_y) >= 0).all()


def test_out_of_fold_scores_come_from_trees_of_the_other_folds():
    r = np.random.default_rng(4)
    x, y, fold = r.random((120, 2)), (r.random(120) < 0.5).astype(float), np.repeat([2, 3, 4, 5], 30)
    fit = toxicity.Fit(trees=4)
    raw, own = toxicity.cross_scores(x, y, fold, fit)
    assert len(raw) == 120 and (own == y).all()
    again = toxicity.boost(x[30:], y[30:], fit).margin(x[:30])
    assert np.allclose(raw[:30], 1 / (1 + np.exp(-again)))
