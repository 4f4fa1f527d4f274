"""SentencePiece by chunks against the library on whole texts."""

import random

import sentencepiece
from pyspark.sql import functions as F

from docsieve.llm import sentencepiece_scan as scan

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=scan.MODEL)
rng = random.Random(9)
ALPHABETS = ["abc", "the er tion ", "aaaa", "é漢x 🙂\n", "   a", "hello world 123\t", "0Oil1"]


def text(n):
    return "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(n))


TEXTS = [(i, text(rng.randint(1, 150))) for i in range(60)] + [
    (100, None), (101, ""), (102, " "), (103, "  lead  and trail  "), (104, "a" * 500), (105, "supercalifragilistic" * 30), (106, "mark ▁ here " * 9),
    (107, "漢字" * 200), (108, " " * 300), (109, "\n" * 90), (7, "same id"), (None, "no id"), (110, "one two three " * 300), (110, "one two three " * 300),
]


def test_chunks_give_the_library_encoding(spark):
    docs = spark.createDataFrame([(i, t, [1], "k") for i, t in TEXTS], "doc_id long, text string, ids array<int>, key string").repartition(3)
    want = sorted(((i, len(t or ""), LIBRARY.encode(t or ""), "▁" not in (t or "")) for i, t in TEXTS), key=str)
    for chunk in (7, 40, 1 << 15):
        got = scan.encode(docs, chunk_chars=chunk).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["ids"], r["round_trip"]) for r in got), key=str) == want
    assert max(r["n_chunks"] for r in scan.encode(docs, chunk_chars=40).collect()) > scan.FAN_IN
    assert scan.encode(docs.limit(0)).count() == 0


def test_decoding(spark):
    rows = [(i, LIBRARY.encode(t)) for i, t in TEXTS if t] + [(500, None), (501, [])]
    got = scan.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit(1))).collect()
    want = [(i, None if x is None else LIBRARY.decode(x)) for i, x in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_matrices_combine_in_any_grouping():
    with open(scan.MODEL, "rb") as file:
        pieces = scan.Pieces(file.read())
    s = scan.BLANK + text(200).replace(" ", scan.BLANK)
    cuts = [0, 50, 90, 140, len(s)]
    m = [pieces.transfer(s, a, b, a == 0) for a, b in zip(cuts, cuts[1:])]
    left = scan.combine(scan.combine(scan.combine(m[0], m[1]), m[2]), m[3])
    assert left == scan.combine(scan.combine(m[0], m[1]), scan.combine(m[2], m[3])) and len(left) == 1
    path = scan.resolve(m, *left[0])
    ids = [i for (a, b), c0, c1 in zip(path, cuts, cuts[1:]) for i in pieces.raw(s[scan.end_of(a, c0) : scan.end_of(b, c1)])]
    assert ids == pieces.raw(s)
