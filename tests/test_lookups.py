"""Lookups by parts of names against all pairs, and their plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docsieve.operators import entities, matching, ranking
from docsieve.operators.containment import containing

SYLLABLES = ["an", "bo", "cor", "dex", "eli", "fu", "ga"]


def word(draw):
    return "".join(draw.choices(SYLLABLES, k=draw.choice((1, 1, 2, 3))))


def phrase(draw, most=4):
    """Half of all phrases hold the word bank."""
    words = [word(draw) for _ in range(draw.randint(1, most))] + draw.choice(([], ["bank"]))
    draw.shuffle(words)
    return " ".join(words)


def equi_joins_only(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def data():
    draw = random.Random(11)
    names = [(i, phrase(draw), draw.choice(("x", "x", "x", "")) + word(draw)) for i in range(400)] + [(400, None, None), (401, "", ""), (402, "Bank", "BANK"), (403, "bank", "other")]
    texts = [phrase(draw, 6) for _ in range(300)] + ["", "  ", None, "a", "bank", "BANK", "ga ga bank bank", "zzzzzz", "bank of nowhere", names[3][1].upper()]
    return names, list(enumerate(texts))


def test_containing(spark):
    draw = random.Random(2)
    patterns = ["".join(draw.choices("abc", k=draw.randint(1, 8))) for _ in range(300)] + ["", None, "x" * 9]
    texts = ["".join(draw.choices("abc", k=draw.randint(0, 30))) for _ in range(200)] + [None]
    make = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = containing(make(patterns, "pattern"), make(texts, "text"))
    equi_joins_only(got)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(p, t) for p in patterns for t in texts if p and t and p in t}
    assert containing(make([], "pattern"), make(texts, "text")).count() == 0


def test_contained(spark, data):
    names, texts = data
    got = matching.contained(spark.createDataFrame(texts, "k int, q string"), spark.createDataFrame(names, "company_id int, name string, ticker string"), text="q", key="k")
    equi_joins_only(got)
    want = set()
    for k, q in texts:
        t = (q or "").strip(" ").lower()
        hits = [(0 if t == n.lower() else 1 if n.lower() in t else 2, c) for c, n, _ in names if n and t and (n.lower() in t or t in n.lower())]
        if hits:
            want.add((k, min(hits)[1], min(hits)[0]))
    assert {tuple(r) for r in got.select("k", "company_id", "step").collect()} == want
    assert {step for *_, step in want} == {0, 1, 2}


def test_by_alias(spark, data):
    names, texts = data
    sites = [(i, [n, None if t is None else t + " works"]) for i, n, t in names[:150] if " " in n] + [(900, None), (901, [])]
    got = entities.by_alias(spark.createDataFrame(texts, "k int, q string"), spark.createDataFrame(sites, "site_id int, aliases array<string>"), text="q", key="k")
    equi_joins_only(got)
    want = set()
    for k, q in texts:
        t = (q or "").strip(" ").upper()
        words = [w for w in re.split(r"\s+", t) if len(w) > 2]
        hits = []
        for i, aliases in sites:
            for alias in filter(None, map(str.upper, filter(None, aliases or []))):
                shared = sum(any(w in a or a in w for a in alias.split()) for w in words)
                step = 0 if t == alias else 1 if t in alias or alias in t else 2 if shared >= 2 or (shared and len(words) == 1) else None
                if t and step is not None:
                    hits.append((step, i))
        if hits:
            want.add((k, min(hits)[1], min(hits)[0]))
    assert {tuple(r) for r in got.select("k", "site_id", "step").collect()} == want
    assert {step for *_, step in want} == {0, 1, 2}


def test_autocomplete(spark, data):
    names, texts = data
    master = [(n, t) for _, n, t in names if n and t]
    got = ranking.autocomplete(spark.createDataFrame(texts, "prefix_id int, prefix string"), spark.createDataFrame(master, "name string, ticker string"))
    equi_joins_only(got)
    want = set()
    for k, q in texts:
        p, best = (q or "").strip(" ").upper(), {}
        for name, ticker in master if p else []:
            n, t = name.upper(), ticker.upper()
            score = 100 if t == p else 95 if n == p else 80 if t.startswith(p) else 75 if n.startswith(p) else 50 if p in t else 40 if p in n else 0
            if score:
                best[ticker] = min(best.get(ticker, (0, "")), (-score, name))
        for place, (score, name, ticker) in enumerate(sorted((*v, t) for t, v in best.items())[:10], 1):
            want.add((k, ticker, name, -score, place))
    assert {tuple(r) for r in got.select("prefix_id", "ticker", "name", "score", "place").collect()} == want


def test_most_overlap(spark, data):
    names, texts = data
    names = [(c, n, t if t is None or c > 390 else f"t{t}") for c, n, t in names if c != 402]
    got = matching.most_overlap(spark.createDataFrame(texts, "k int, q string"), spark.createDataFrame(names, "company_id int, name string, ticker string"), text="q", key="k")
    equi_joins_only(got)
    want, scores = set(), set()
    for k, q in texts:
        words = set((q or "").lower().split())
        hits = [(-len(words & set(n.lower().split())), c) for c, n, _ in names if n] + [(-999, c) for c, _, t in names if t and t.lower() in words]
        if hits and min(hits)[0]:
            want.add((k, min(hits)[1], -min(hits)[0]))
            scores.add(-min(hits)[0])
    assert {tuple(r) for r in got.select("k", "company_id", "score").collect()} == want
    assert scores > {1, 2, 3, 999}


def test_first_fragment_of_many(spark):
    draw = random.Random(4)
    entries = [("".join(draw.choices("abcd", k=draw.randint(3, 7))), f"v{i}", i) for i in range(1500)]
    rows = [(i, "".join(draw.choices("abcdE", k=draw.randint(0, 20)))) for i in range(100)] + [(100, None)]
    dim = spark.createDataFrame(entries, "fragment string, value string, ord int")
    df = spark.createDataFrame(rows, "k int, name string")
    want = {k: next((v for f, v, _ in entries if f in (n or "").lower()), None) for k, n in rows}
    assert {r["k"]: r["mapped"] for r in matching.first_fragment(df, dim, text="name").collect()} == want
    few = dim.where("ord < 900")
    want = {k: next((v for f, v, i in entries if i < 900 and f in (n or "").lower()), None) for k, n in rows}
    assert {r["k"]: r["mapped"] for r in matching.first_fragment(df, few, text="name").collect()} == want


def test_official_hits(spark):
    hits = spark.createDataFrame([(1, "Acme Steel", "http://www.acme.com/a.pdf"), (1, "Acme Steel", "http://x.org/b.PDF"), (2, "Other", "http://x.org/c.pdf"), (3, "Acme Iron", "http://scribd.com/d.pdf"), (4, None, "http://y.org/e.pdf")], "k int, name string, url string")
    domains = spark.createDataFrame([("ACME", ["acme.com"]), ("STEEL", ["steel.com"])], "company string, domains array<string>")
    got = entities.official_hits(hits, domains)
    equi_joins_only(got)
    assert sorted((r["k"], r["url"][-5], r["official"]) for r in got.collect()) == [(1, "a", True), (1, "b", False), (2, "c", True), (4, "e", True)]


def test_words_of_requests_stay_out_of_joins(spark):
    """The text of a request is made of two tables; its words must not become the condition that joins them."""
    from docsieve.queries import core

    equi_joins_only(core.QUERIES["r02_fuzzy_lookup_whole"](spark, "/root/testdata/sf0.001").select(F.col("request_id")))
