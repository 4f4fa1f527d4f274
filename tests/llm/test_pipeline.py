"""The pipeline against plain versions of its stages on a small set of tables."""

import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from docsieve.llm import sentencepiece_scan
from test_free_operators import alnum, brute_windows, lower
from test_native_operators import words

rng = random.Random(8)
VOCABULARY = [a + b for a in "bcdfg" for b in ("an", "er", "ion", "ous", "é")]


def sentence(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LEAK = sentence(14)
SHARED = sentence(12)
BODY = [sentence(60) for _ in range(40)]
DOCS = [(i, f"{sentence(9)}\n{b}" + (f"\n{SHARED}" if i % 3 == 0 else "")) for i, b in enumerate(BODY)]
DOCS += [(50, DOCS[4][1]), (51, f"{sentence(8)} {LEAK} {sentence(8)}"), (52, None), (53, ""), (60, f"awful awful {sentence(20)}"), (61, sentence(30))]
DOCS += [(100 + i, f"{'awful ' * 3 if i % 2 else ''}{sentence(25)}") for i in range(120)]
ITEMS = [(1, LEAK), (2, None)]


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ties = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    clean = [(i, t) for i, t in DOCS if "awful" not in (t or "")]
    earlier, lines = [], []
    for i, t in sorted(clean, key=lambda d: (d[0], ties[d[1]] or 0)):
        kept = []
        for x in t.split("\n") if t is not None else []:
            s = words(x)
            if not s or not any(10 * len(s & e) >= 8 * len(s | e) for e in earlier):
                kept.append(x)
            if s:
                earlier.append(s)
        lines.append((i, None if t is None else "\n".join(kept)))
    blank, single = False, []
    for i, t in lines:  # what is left has no near copies but the wordless texts
        if not words(t or ""):
            if blank:
                continue
            blank = True
        single.append((i, t))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL)

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == sorted(i for i, _ in single) and 61 in got and 60 not in got
    for i, t in single:
        n, hit, _ = brute_windows(t, ITEMS)
        text = bytes_of(library, got[i]["ids"])
        assert len(alnum(text)) == n - hit
        assert got[i]["ids"] == library.encode(text) and got[i]["round_trip"]
        if not hit:
            assert text == (t or "")
    assert brute_windows(dict(single)[51], ITEMS)[1] == 14
    assert lower("AÉ") == "aÉ"


def bytes_of(library, ids):
    return library.decode(ids)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "sentencepiece"]
    empty = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], empty).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
