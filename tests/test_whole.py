"""Queries over whole tables answer for every row, and agree with brute force."""

import re
from pathlib import Path

import pytest

from docsieve.operators import matching
from docsieve.queries import core
from docsieve.queries.fixtures import fixture

FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def unique(words):
    return list(dict.fromkeys(words))


def first_similar(text, companies):
    """One entry after the other, as a table of keys in the order in which they were put in."""
    table = {}
    for c, ticker, name in companies:
        for k in (ticker, name):
            if k is not None:
                table[k.upper()] = c
    words = [w for w in re.split(r"\s+", text.upper()) if len(w) > 2]
    for k, c in table.items():
        known = re.split(r"\s+", k)
        if words and known[0] == words[0] and sum(w in known for w in words) >= min(2, len(words)):
            return c
    return None


@here
def test_fuzzy_lookup_of_all_requests_and_companies(spark):
    companies = sorted(rows(fixture(spark, FOLDER, "fx_company"), "company_id", "ticker", "name"))
    want, memory = {}, {}
    for request, name in rows(fixture(spark, FOLDER, "fx_request"), "request_id", "name"):
        if name not in memory:
            memory[name] = first_similar(name, companies)
        if memory[name] is not None:
            want[request] = memory[name]
    got = rows(core.QUERIES["r02_fuzzy_lookup"](spark, FOLDER), "request_id", "company_id")
    assert dict(got) == want and len(got) == len(want)


def test_fuzzy_lookup_by_hand(spark):
    companies = [(1, "ab", "Acme Steel"), (2, "ACME", "Acme Iron Works"), (3, "cd", "ACME STEEL"), (4, None, "Of The Sea"), (5, "sea", "Sea Acme Acme"), (6, "x", None)]
    asked = [(1, "Acme Steel"), (2, "acme works of"), (3, "Acme"), (4, ""), (5, "of the sea"), (6, "the sea"), (7, "acme acme"), (8, "sea of acme"), (8, "sea of acme"), (9, None), (10, "Acme Tin")]
    master = spark.createDataFrame(companies, "company_id int, ticker string, name string")
    got = rows(matching.fuzzy(spark.createDataFrame(asked, "request_id int, q string"), master, text="q"), "request_id", "company_id")
    want = [(i, c) for i, t in asked if t and (c := first_similar(t, companies)) is not None]
    assert sorted(got) == sorted(want) and dict(got)[1] == 3


@here
def test_most_overlap_with_all_companies(spark):
    known = [(c, set(n.lower().split()), t.lower()) for c, n, t in rows(fixture(spark, FOLDER, "fx_company"), "company_id", "name", "ticker")]
    want = {}
    for (text,) in set(rows(fixture(spark, FOLDER, "fx_request"), "raw_query")):
        w = set(text.lower().split())
        hits = [(-(999 if t in w else len(w & k)), c) for c, k, t in known if t in w or w & k]
        if hits:
            want[text] = (min(hits)[1], -min(hits)[0])
    got = rows(core.QUERIES["r07_most_overlap"](spark, FOLDER), "asked", "company_id", "score")
    assert {a: (c, n) for a, c, n in got} == want and len(got) == len(want)
    assert any(c % 11 for c, _ in want.values()) and any(n == 999 and c % 11 for c, n in want.values())
