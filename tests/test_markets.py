"""Golden rows of exchanges, countries and investor pages."""

import pytest
from pyspark.sql import functions as F

from docsieve.operators import markets
from docsieve.sources import tables
from docsieve.sources.store import UserTable

PAGES = [
    ("https://www.moneycontrol.com/x", "aggregator"), ("https://finance.yahoo.com/q", "aggregator"), ("https://www.bseindia.com/", "exchange"), ("https://m.sgx.com", "exchange"),
    ("https://notdfm.ae/ir", None), ("https://www.wsj.com/a", None), ("https://careers.acme.com/ir", "section"), ("https://ir.acme.com", None),
    ("https://acme.com/a.PDF", "file"), ("https://acme.com/a.pdf?x=1", None), ("https://acme.com", None),
]
EXCHANGES = [("Bombay Stock Exchange", "XBOM"), ("NATIONAL STOCK EXCHANGE OF INDIA", "XNSE"), ("nasdaq nms", "XNAS"), ("Saudi Exchange", "XSAU"), ("B3 S.A.", "BVMF"), ("nowhere", "")]
COUNTRIES = [("RU", ["MOEX"]), ("GB/ZA", ["LSE", "JSE"]), ("US/IN", ["SEC", "BSE", "NSE"]), ("XX", []), ("BR/NL", ["B3", "Euronext Amsterdam"])]


@pytest.mark.parametrize(("rows", "rule"), [
    (PAGES, lambda: markets.page_fault(F.col("x"))), (EXCHANGES, lambda: markets.exchange_market(F.col("x"))), (COUNTRIES, lambda: markets.exchanges(F.col("x"))),
])
def test_rules(spark, rows, rule):
    got = spark.createDataFrame([(x,) for x, _ in rows], "x string").select("x", rule().alias("y")).collect()
    assert [(r["x"], r["y"]) for r in got] == rows


def test_pages_and_countries_of_companies(spark):
    rows = [("Eskom Holdings SOC", 2023, "https://a.com", "https://www.eskom.co.za/IR2023/"), ("Acme", 2023, "https://a.com", "https://a.com"), ("Acme", 2023, "https://www.scribd.com", ""), ("Acme", 2023, None, "")]
    df = spark.createDataFrame(rows, "name string, year int, url string, want string")
    assert all(r[0] == r[1] for r in df.select(markets.investor_page(F.col("name"), F.col("year"), F.col("url")), "want").collect())
    rows = [("mtn", "LN", "", "ZA"), ("A", "IB", "", "IN"), ("A", "??", "TR", "TR"), (None, None, None, "")]
    df = spark.createDataFrame(rows, "ticker string, code string, guess string, want string")
    assert all(r[0] == r[1] for r in df.select(markets.country(F.col("ticker"), F.col("code"), F.col("guess")), "want").collect())


def test_sinks_return_ids_and_append(spark, tmp_path):
    items = spark.createDataFrame([(1, 5, None, None, None, None, None), (2, 6, "IN", "web", "high", "it", 0.5)], "user_id long, request_id long, country string, source string, confidence string, sector string, score double")
    ids = {r["request_id"]: r["item_id"] for r in tables.append_library(items, f"{tmp_path}/library").collect()}
    assert {r["request_id"]: r["item_id"] for r in UserTable(spark, f"{tmp_path}/library").read().collect()} == ids and len(set(ids.values())) == 2
    notes = spark.createDataFrame([(1, "short"), (2, "x" * 501), (3, None)], "feedback_id int, user_note string")
    for _ in range(2):
        tables.append_feedback(notes, f"{tmp_path}/feedback")
    kept = spark.read.parquet(f"{tmp_path}/feedback").collect()
    assert sorted(r["feedback_id"] for r in kept) == [1, 1, 3, 3] and all(r["created_at"] and r["status"] == "pending" for r in kept)
