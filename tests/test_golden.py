"""Golden rows of the rules, worked out by hand, and checks that hold whatever the data."""

import random

import pytest
from pyspark.sql import functions as F

from docsieve.functions import requests as rq
from docsieve.functions import scoring
from docsieve.functions.text import absolute
from docsieve.operators import links, matching, ranking
from docsieve.operators import requests as req
from docsieve.sources import providers, tables
from docsieve.sources.store import UserTable

SCHEMA = "url string, name string, year int, doc_type string, ir_url string, head_status int, content_type string"
CASES = [
    ("https://www.annualreports.com/HostedData/AnnualReportArchive/a/PDF/NASDAQ_AAPL_2023.pdf", "Apple Inc", 2023, 1.40),
    ("https://nsearchives.example.com/XNSE_KRISHANA_2024_AR1.pdf", "Krishana Phoschem", 2023, 0.0),
    ("https://files.example.com/XNSE_KRISHANA_2023_AR1.pdf", "Krishana Phoschem", 2023, 0.95),
    ("https://www.example.com/page.html", "Apple Inc", 2023, 0.0),
    ("https://www.reliance.com/investors/annual-report-2023.pdf", "Reliance Industries", 2023, 1.45),
    ("https://www.bseindia.com/files/Q1-2024-quarterly-results.pdf", "Test Corp", 2024, 0.0),
    ("https://x.com/annual_reports/AR_12_TCS_2022_2023_99.pdf", "TCS", 2023, 1.40),
    ("https://x.com/annual_reports/AR_12_TCS_2022_2023_99.pdf", "TCS", 2022, 0.0),
    ("https://x.com/uploads/2025/annual-fy-23-report.pdf", "Acme", 2024, 0.0),
    ("https://x.com/uploads/2025/annual-report.pdf", "Acme", 2024, 0.0),
    ("https://x.com/annual/17.11.2023-24.11.2023.pdf", "Acme", 2023, 1.40),
    ("https://x.com/faq1/annual-2023.pdf", "Acme", 2023, 0.0),
    ("https://www.crisil.com/annual-2023.pdf", "Acme", 2023, 0.0),
]


def test_candidate_scores(spark):
    rows = [(u, n, y, "annual_report", "", None, None) for u, n, y, _ in CASES]
    got = {(r["url"], r["year"]): r["score"] for r in scoring.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(u, y): s for u, _, y, s in CASES}


def test_own_site_is_a_prefix_strip_not_a_character_strip(spark):
    rows = [("https://ipro.com/annual-2023.pdf", "Acme", 2023, "annual_report", "https://www.wipro.com/ir", None, None), ("https://wipro.com/annual-2023.pdf", "Acme", 2023, "annual_report", "https://www.wipro.com/ir", None, None)]
    got = {r["url"]: r["source_points"] for r in scoring.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert list(got.values()) == [0, 40]


@pytest.mark.parametrize("status,kind,reject,points", [(404, "", "status", 5), (403, "", None, 5), (405, "", None, 5), (200, "application/pdf", None, 15), (None, None, None, 5)])
def test_status(spark, status, kind, reject, points):
    row = scoring.scored(spark.createDataFrame([("https://a.com/annual-2023.pdf", "Acme", 2023, "annual_report", "", status, kind)], SCHEMA)).first()
    assert (row["reject"], row["file_points"]) == (reject, points)


def test_parsing(spark):
    texts = ["Reliance Industries annual report 2023", "TCS quarterly results Q3 2024", "Infosys investor presentation 2022", "HDFC Bank financial performance", "", None]
    got = [(r["company_name"], r["doc_type"], r["asked_year"], r["sector"]) for r in req.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_query string"), as_of_year=2024).orderBy("id").collect()]
    assert got[0][:3] == ("Reliance Industries", "annual_report", 2023)
    assert got[1][:3] == ("TCS", "quarterly_report", 2024)
    assert got[2][:3] == ("Infosys", "investor_presentation", 2022)
    assert got[3] == ("HDFC Bank financial performance", "annual_report", 2023, "Financial Services")
    assert got[4] == got[5] == ("", "annual_report", 2023, "")


def test_second_dialect(spark):
    rows = [("AAPL 10-K 2023", "annual", "10-K", None, "AAPL"), ("Tesla Q3 2024 earnings report", "quarterly", "10-Q", 3, None), ("Microsoft investor presentation", "investor-presentation", "", None, None),
            ("Apple first quarter earnings", "quarterly", "10-Q", 1, None), ("Apple Q3", "annual", "10-K", 3, None), ("GOOG", "annual", "10-K", None, "GOOG")]
    master = spark.createDataFrame([("AAPL", "Apple"), ("GOOG", "Google")], "ticker string, name string")
    got = {r["raw_query"]: (r["kind"], r["form"], r["quarter"], r["found_ticker"]) for r in req.filing_request(spark.createDataFrame([(r[0],) for r in rows], "raw_query string"), master).collect()}
    assert got == {r[0]: r[1:] for r in rows}


def test_sector_ties_go_to_the_earlier_one_and_repeats_count_twice(spark):
    got = req.with_sector(spark.createDataFrame([("mining",), ("it bpo",), ("media",), ("",)], "t string"), F.col("t")).collect()
    assert [(r["sector"], r["sector_hits"]) for r in got] == [("Materials", 2), ("", 0), ("Consumer Discretionary", 1), ("", 0)]


def test_names(spark):
    row = spark.createDataFrame([("United Bank Africa Plc",), ("Zenith Bank",)], "n string").select(rq.core_tokens(F.col("n")).alias("t"), rq.acronym(F.col("n")).alias("a")).collect()
    assert (row[0]["t"], row[0]["a"]) == ([], "uba") and (row[1]["t"], row[1]["a"]) == (["zenith"], "zb")


@pytest.mark.parametrize("url,title,points,web", [
    ("https://zenithbank.com/a.pdf", "", 100, 100), ("https://zenithdrugs.com/a.pdf", "", 0, 0), ("https://x.com/a.pdf", "Zenith plan", 50, 40), ("https://x.com/zenith-2023.pdf", "", 0, 100),
])
def test_identity(spark, url, title, points, web):
    df = spark.createDataFrame([(url, title)], "u string, t string")
    tokens = F.array(F.lit("zenith"))
    got = df.select(*[scoring.identity_points(F.col("u"), F.col("t"), F.lit(""), tokens, F.lit("z"), F.lit(""), web=w).alias(n) for n, w in (("a", False), ("b", True))]).first()
    assert tuple(got) == (points, web)


@pytest.mark.parametrize("base,href,want", [
    ("http://h.com/a/b?q#f", "c.pdf", "http://h.com/a/c.pdf"), ("http://h.com", "c", "http://h.com/c"), ("http://h.com/a", "/c", "http://h.com/c"), ("https://h.com/a", "//o.com/c", "https://o.com/c"),
    ("http://h.com/a?x", "?y", "http://h.com/a?y"), ("http://h.com/a?x#z", "#y", "http://h.com/a?x#y"), ("http://h.com/a", "mailto:x@y", "mailto:x@y"),
])
def test_absolute_links(spark, base, href, want):
    assert spark.createDataFrame([(base, href)], "b string, h string").select(absolute(F.col("b"), F.col("h"))).first()[0] == want


def test_document_links_and_next_hop(spark):
    html = '<a href="/x.PDF"> One </a><A class=q HREF=\'r\'><b>Annual</b> report</A><a href="/x.PDF">again</a><a href="">no</a><a href="/investors">IR</a>'
    pages = spark.createDataFrame([(1, "http://h.com/p", html), (2, "http://h.com/q", '<a href="/investors">IR</a><a href="http://o.com/annual">x</a>'), (3, "http://h.com/z", None)], "page_id int, url string, html string")
    found = links.document_links(pages)
    assert sorted((r["page_id"], r["link"], r["text"]) for r in found.collect()) == [(1, "http://h.com/r", "Annual report"), (1, "http://h.com/x.PDF", "One")]
    assert [(r["page_id"], r["link"]) for r in links.next_hop(pages, found).collect()] == [(2, "http://h.com/investors")]


def test_group_fallback_keeps_all(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False), (2, "d", None)], "g int, x string, k boolean")
    assert sorted(r["x"] for r in ranking.kept_or_all(df, ["g"], F.col("k")).collect()) == ["a", "c", "d"]


def test_order_of_candidates_does_not_matter_and_rejects_never_win(spark):
    rows = [(1, f"u{i}", random.choice(["web", "exchange"]), random.choice([0.0, 0.7, 0.9, 1.2]), True, i % 3, i % 4) for i in range(40)]
    schema = "request_id int, url string, source string, score double, alive boolean, source_tier int, phase int"
    best = lambda r: ranking.best_alive(spark.createDataFrame(r, schema)).collect()
    want = best(rows)
    assert best(random.sample(rows, len(rows))) == want == best([*rows, (1, "new", "web", 0.0, True, 0, 0), (1, "dead", "web", 2.0, False, 0, 0)])


def test_autocomplete(spark):
    master = spark.createDataFrame([("Apple", "AAPL"), ("Apple Hospitality", "APLE"), ("Pineapple", "PINE"), ("Apple", "AAPL")], "name string, ticker string")
    asked = spark.createDataFrame([(1, "aapl"), (2, "apple"), (3, " "), (4, "zzz")], "prefix_id int, prefix string")
    got = [(r["prefix_id"], r["ticker"], r["score"]) for r in ranking.autocomplete(asked, master).orderBy("prefix_id", "place").collect()]
    assert got == [(1, "AAPL", 100), (2, "AAPL", 95), (2, "APLE", 75), (2, "PINE", 40)]


def test_provider_null_is_not_empty(spark):
    rows = [(1, "first", "{}"), (1, "second", '{"results":[{"url":"a.pdf"}]}'), (2, "first", None), (2, "second", '{"results":[{"url":"b.pdf"},{"url":"c"}]}'), (3, "first", None), (3, "second", None)]
    got = providers.with_fallback(providers.hit_arrays(spark.createDataFrame(rows, "query_id int, provider string, payload string"))).collect()
    assert [(r["query_id"], r["used"], r["url"]) for r in got] == [(2, "second", "b.pdf")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u"), (2, "v")], "user_id long, url string")
    tables.append_history(rows, f"{tmp_path}/h")
    tables.append_history(rows, f"{tmp_path}/h")
    assert UserTable(spark, f"{tmp_path}/h").read().count() == 4
    items = spark.createDataFrame([(1, None, None, None, None, None)] * 2, "user_id long, source string, confidence string, country string, sector string, score double")
    saved = tables.append_library(items, f"{tmp_path}/l").collect()
    assert {(r["source"], r["score"], len(r["item_id"])) for r in saved} == {("", 0.0, 36)}
    assert len({r["item_id"] for r in saved}) == 2 == len({r["item_id"] for r in saved} & {r["item_id"] for r in UserTable(spark, f"{tmp_path}/l").read().collect()})


def test_fuzzy_lookup_needs_the_first_word(spark):
    master = spark.createDataFrame([(1, "Acme Steel Works"), (2, "Steel Acme")], "company_id int, name string")
    asked = spark.createDataFrame([(1, "acme steel"), (2, "steel"), (3, "works"), (4, "")], "request_id int, q string")
    assert sorted((r["request_id"], r["company_id"]) for r in matching.fuzzy(asked, master, text="q").collect()) == [(1, 1), (2, 2)]
