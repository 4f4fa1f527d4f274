"""The language model against a plain evaluation; its probabilities sum to one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import katz
from docsieve.llm.text import blank_word_runs, blank_words

rng = random.Random(6)
WORDS = "a b c d e f g h".split()
TRAIN = [(i, " ".join(rng.choices(WORDS, [30, 20, 10, 5, 3, 2, 1, 1], k=rng.randint(0, 30)))) for i in range(80)] + [(90, None), (5, "A a\tB"), (5, "A a\tB"), (None, "a q"), (91, "a b " * 400)]
ASK = [(200, "a b zz a"), (201, None), (202, ""), (203, "unknown words only"), (204, "h h h h g"), (205, "zz a b c zz"), *TRAIN]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()) + ["</s>"]


class Plain:
    """Recursion over ever shorter contexts, one token at a time."""

    def __init__(self, train, order, k=5):
        self.order, self.after = order, {}
        self.uni = Counter(t for _, x in train for t in tokens(x))
        for _, x in train:
            x = ["<s>"] * (order - 1) + tokens(x)
            for i in range(order - 1, len(x)):
                for m in range(1, order):
                    self.after.setdefault(tuple(x[i - m : i]), Counter())[x[i]] += 1
        self.d = {m: katz.discounts(Counter(r for h, c in self.after.items() if len(h) == m for r in c.values()), k) for m in range(1, order)}
        self.n, self.v = sum(self.uni.values()), len(self.uni)

    def p(self, h, w):
        if not h:
            return (self.uni[w] + 1) / (self.n + self.v + 1)
        after = self.after.get(h)
        if not after:
            return self.p(h[1:], w)
        d = self.d[len(h)]
        total, kept = sum(after.values()), sum(d.get(r, 1.0) * r for r in after.values())
        total += kept >= total
        if w in after:
            return d.get(after[w], 1.0) * after[w] / total
        return (1 - kept / total) / (1 - sum(self.p(h[1:], x) for x in after)) * self.p(h[1:], w)

    def score(self, text):
        x = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(x[i - self.order + 1 : i]), x[i])) for i in range(self.order - 1, len(x)))


@pytest.fixture(scope="module", params=[(2, 1 << 20), (3, 1 << 20), (3, 60), (4, 60)])
def case(request, spark):
    order, bucket = request.param  # buckets of 60 tokens: most words are spread over several
    read = katz.corpus(spark.createDataFrame(TRAIN, "doc_id long, text string"), chunk_bytes=300)
    return Plain(TRAIN, order), katz.train(read, order=order, bucket_tokens=bucket)


def test_scores(spark, case):
    plain, model = case
    want = []
    for i, t in ASK:
        x = tokens(t)
        want.append((i, len(x), sum(w in plain.uni for w in x), round(sum(math.log10(plain.p((), w)) for w in x), 8), round(plain.score(t), 8)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ASK], "doc_id long, text string, n int, chunk string")
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 8), round(r["score"], 8)) for r in katz.score(model, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (model.corpus.words.tokens, model.corpus.words.types) == (plain.n, plain.v)


def test_scores_of_the_rows_read(case):
    plain, model = case
    got = sorted((str(r["doc_id"]), round(r["score"], 8)) for r in katz.score(model).collect())
    assert got == sorted((str(i), round(plain.score(t), 8)) for i, t in TRAIN)


class Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("order", [2, 3])
def test_the_tables_sum_to_one(spark, order):
    """After any context, seen or not, the probabilities of all words and an unknown one add up to one."""
    model = katz.train(katz.corpus(spark.createDataFrame(TRAIN, "doc_id long, text string")), order=order)
    types = model.corpus.words.types
    asked = [(*c, w) for c in np.ndindex(*[types + 2] * (order - 1)) for w in range(types + 1)]
    columns = list(np.array(asked, np.int64).T)
    grams = [katz.packed(np.diff(columns[0], prepend=0)), *map(katz.packed, columns[1:])]
    asks = pa.table({"chunk": [0], "grams": pa.array([grams], pa.list_(pa.binary())), "n": [katz.packed(np.ones(len(asked)))], "row": [katz.packed(np.arange(len(asked)))]})
    known = model.grams.withColumns({"contexts": F.lit(None).cast("array<binary>"), "sums": F.lit(None).cast("array<binary>")}).toArrow()
    parts = katz.added(katz.evaluator(order, model.factors, Shared(model.deal))(asks, known))["score"].to_numpy()
    assert np.allclose((10**parts).reshape(-1, types + 1).sum(1), 1.0, rtol=1e-9)


def test_learning_from_some_rows(spark):
    docs = spark.createDataFrame(TRAIN, "doc_id long, text string")
    model = katz.train(katz.corpus(docs, learn=F.col("doc_id") % 2 == 0))
    plain = Plain([r for r in TRAIN if r[0] is not None and r[0] % 2 == 0], 3)
    got = sorted((str(r["doc_id"]), round(r["score"], 8)) for r in katz.score(model).collect())
    assert got == sorted((str(i), round(plain.score(t), 8)) for i, t in TRAIN)


def test_empty_model(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = katz.train(katz.corpus(none))
    got = katz.score(model, spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert got["score"] == 0.0 == got["base_score"] and got["n_known"] == 0
    assert katz.score(model).count() == 0


@pytest.mark.parametrize("most", [1, 3, 1 << 20, 1 << 40])
def test_numbers_of_rows(most):
    """One sort gives the numbers of contexts and of n-grams, also where the columns need more than 63 bits."""
    numbers = np.random.default_rng(most)
    pool = numbers.integers(0, most, (9, 3))
    columns = list(pool[numbers.integers(0, 9, 200)].T)
    columns[2] = numbers.integers(0, 3, 200) * (most // 2)
    context, gram = katz.nested(columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert context.tolist() == [sorted({r[:2] for r in rows}).index(r[:2]) for r in rows]
    assert gram.tolist() == [sorted(set(rows)).index(r) for r in rows] == katz.codes(*columns).tolist()
    order, first = katz.sorted_runs(columns)
    assert [rows[i] for i in order] == sorted(rows) and [rows[i] for i in order[first]] == sorted(set(rows))
    assert len(katz.nested([np.zeros(0, np.int64)] * 3)[0]) == 0


def test_packing():
    for x in ([], [0], [1, 255, 256, 2**40], range(1000)):
        assert katz.unpacked(katz.packed(np.array(list(x), np.int64))).tolist() == list(x)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 100])
def test_word_runs(most):
    for text in (None, b"", b"   ", b"abc", b"A bc  def\n\x0bghi \xc3\xa9t\xc3\xa9 " * 5, b"x" * 50, b" " * 30 + b"y" * 9 + b" z"):
        assert [w for words in blank_word_runs(text, most) for w in words] == blank_words(text)
