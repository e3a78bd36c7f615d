import random

import corpus_pipeline
from test_decontaminate import brute as overlaps
from test_line_dedup import brute as repeated_lines
from test_near_duplicates import brute_classes

from basalt.llm import quality


def make(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(20)) for i in range(5)]
    rows = []
    for i in range(120):
        lines = [line(r.randint(8, 30)) for _ in range(r.randint(4, 9))]
        if i % 10 == 3:
            lines = [w + "$$" for x in lines for w in x.split()]  # symbols
        if i % 10 == 4 and i > 10:
            lines[1] = rows[i - 7][1].split("\n")[0] + " " + word()  # a line seen before
        if i % 10 == 5 and i > 10:
            lines = rows[i - 10][1].split("\n")
            lines[0] += " " + word()
        if i % 10 == 6:
            lines[2] = r.choice(items)[1]
        if i % 10 == 7:
            lines = lines[:1]
        rows.append((i, "\n".join(lines), "en", "s1", 0))
    rows += [(200, None, None, None, None), (201, "", "en", "s2", 0), (None, line(80), "en", None, 5), (3, rows[3][1], "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def rows_of(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in df.collect())


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, items = make(spark, tmp_path)
    columns = docs.columns
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        before = rows_of(at)
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
            after = rows_of(out)
        if k == 0:
            kept = {r.doc_id for r in quality.quality(at).where("kept").collect()}
            assert after == sorted(x for x in before if (None if x[0] < 0 else x[0]) in kept)
            assert all("$$" not in t for _, t in after) and 0 < len(after) < len(before)
        elif k == 1:
            gone = repeated_lines([(None if i < 0 else i, t) for i, t in before])
            assert after == sorted((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, []))) for i, t in before)
            assert gone
        elif k == 2:
            groups = brute_classes([t for _, t in before])
            want = sorted(min(((before[j][0] < 0), before[j]) for j in g)[1] for g in groups)
            assert after == want and len(after) < len(before)
        elif k == 3:
            assert after == [x for x in before if not any(overlaps(x[1], t) for _, t in items)]
            assert 0 < len(after) < len(before)
        else:
            from sentencepiece import SentencePieceProcessor

            sp = SentencePieceProcessor(model_file=corpus_pipeline.pieces.default_model())
            got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in out.collect())
            assert got == sorted((i, sp.encode(t, add_eos=True)) for i, t in before)
        at = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_empty_documents(spark, tmp_path):
    docs, _ = make(spark, tmp_path)
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert at.count() == 0
