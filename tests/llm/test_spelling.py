"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import pytest

from docsieve.llm import queries, spelling

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    """One replaced, inserted or deleted code point: what lies between the common beginning and the common end."""
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return (len(b) == len(a) and i < len(a) and a[i + 1 :] == b[i + 1 :]) or (len(b) == len(a) + 1 and a[i:] == b[i + 1 :])


def expected(counts, least=3):
    n = {w: c for w, c in counts.items() if c >= least}
    if len(n) < 300:
        friends = {w: {v for v in n if near(w, v)} for w in n}
    else:  # near words are equal around a hole
        buckets = {}
        holes = lambda w: {(w[:i], w[j:]) for i in range(len(w) + 1) for j in (i, i + 1)}
        for w in n:
            for key in holes(w):
                buckets.setdefault(key, set()).add(w)
        friends = {w: {v for key in holes(w) for v in buckets[key] if near(w, v)} for w in n}
    form = {}
    for w, vs in friends.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(friends[w]), n[form[w]] if form[w] else None))
    return out


def rows(df):
    got = df.collect()
    assert len(got) == len(set(got))
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_near_words_meet_once(spark):
    words = ["abcde", "abcdf", "abcdef", "abde", "aabcde", "aaabcde", "bcdea", "abced", "aaaaa", "aaaaaa", "aaaa", "abcde" * 2, "éabcde", "zabcde", "abcdez", "azbcde"]
    counts = {w: 3 + 7 * i % 40 for i, w in enumerate(words)} | {"rarely": 2, "always": 900}
    assert all(sum(key in dict(spelling.rotations(b)) for key, _ in spelling.rotations(a)) > 0 for a in words for b in words if near(a, b))
    assert rows(spelling.variants(frame(spark, counts))) == expected(counts)


def test_chains_ties_and_long_words(spark):
    chain = {"x" * 4 + "abcdefgh"[:k] + "q" * (8 - k): 3 * 2**k for k in range(9)}
    long = {"y" * n + tail: c for n, tail, c in ((61, "ab", 3), (62, "ab", 9), (63, "ab", 30), (63, "ac", 30), (64, "ab", 100), (200, "ab", 4), (201, "ab", 9), (201, "zb", 9), (20_000, "", 3), (20_001, "", 6))}
    ties = {"tiesa": 9, "tiesb": 9, "tiesc": 4, "ties": 9}
    counts = chain | long | ties
    assert rows(spelling.variants(frame(spark, counts))) == expected(counts)


def test_empty_and_null(spark):
    assert rows(spelling.variants(frame(spark, {}))) == set()
    odd = spark.createDataFrame([(None, 9, 1), ("alone", 3, 2), ("never", 2, 3)], "word string, n long, form long")
    assert rows(spelling.variants(odd)) == {("alone", None, "alone", 3, 0, None)}
    with pytest.raises(ValueError, match="root"):
        spelling.variants(odd, ratio=1)


def counted(docs, every=97):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % every == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 5:
                counts[low] += 1
    return counts


def test_word_counts(spark):
    docs = [(i, "Straße ÀÉÎõü×÷ WORDS words wordS, o'clock naïveté 5words word") for i in range(200)] + [(None, "words"), (7, None), (7, ""), (8, "long" * 50_000), (8, "ab cdefg " * 600_000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n int, word string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, drop_every=97).collect()} == counted(docs)
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, drop_every=2).collect()} == counted(docs, 2)


def test_registered_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.QUERIES["op11_spelling"](spark, FOLDER)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected(counted(docs))
    assert any(form for _, form, *_ in want)
    assert rows(got) == want
