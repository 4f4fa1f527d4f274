"""Routes to exchanges, row by row."""

import pytest

from docsieve.plans import routes

SCHEMA = "request_id int, exchange_mic string, country string, company_name string, normalized_name string"


def asked(spark, mic, country, name, normalized=""):
    rows = routes.steps(spark.createDataFrame([(1, mic, country, name, normalized)], SCHEMA)).orderBy("step").collect()
    return [r["source"] for r in rows]


@pytest.mark.parametrize("mic,country,name,want", [
    ("XNYS", "IN", "Acme", "SEC EDGAR"), ("", "us", "Acme", "SEC EDGAR"), ("ns", "", "Acme", "BSE India|NSE India"), ("", "IN", "Acme Limited", "BSE India|NSE India"),
    ("TK", "", "Acme", "KAP Turkey"), (None, None, "Acme A.Ş.", "KAP Turkey"), ("", "JP", "Acme", "JPX / EDINET"), ("", "PT", "Acme", "Euronext"), ("ID", "ID", "Acme", "Euronext"), ("IL", "", "Acme", "LSE"),
    ("", "SA", "Acme", "Tadawul"), ("DU", "", "Acme", "DFM|ADX|UAE Web Search"), ("", "AE", "Aldar", "ADX|DFM|UAE Web Search"), ("", "MY", "Acme", "Bursa Malaysia"), ("SP", "", "Acme", "SGX"), ("", "TH", "Acme", "SET Thailand"),
    ("JO", "", "Acme", "JSE"), ("LA", "", "Acme", "NGX"), ("", "JM", "Acme", "Caribbean Exchange"), ("", "", "Acme", ""), ("", "", "Acme Industries", "BSE India|NSE India"), ("", "", "Emaar Ltd", "DFM|ADX|UAE Web Search"),
    ("", "GB", "Acme Ltd", "LSE|BSE India|NSE India"), ("", "US", "Dubai Limited", "SEC EDGAR|DFM|ADX|UAE Web Search"), ("", None, None, ""),
])
def test_steps(spark, mic, country, name, want):
    assert "|".join(asked(spark, mic, country, name)) == want


def test_normalized_name_goes_first(spark):
    assert asked(spark, "", "", "Acme Limited", "Acme") == [] and asked(spark, "", "AE", "Acme", "ADNOC Works")[0] == "ADX"


def test_next_source_and_name(spark):
    rows = [(1, "", "IN", "A", ""), (2, "", "IN", "B", ""), (3, "", "GB", "C Ltd", ""), (4, "", "GB", "D Ltd", None), (5, "", "GB", "E", ""), (6, "", "ZZ", "Dubai F", "")]
    found = [(1, "NSE India", 1, "n1"), (1, "BSE India", 2, "b2"), (1, "BSE India", 1, None), (2, "BSE India", 1, ""), (2, "NSE India", 1, "n2"), (3, "LSE", 1, "l3"), (3, "BSE India", 1, "b3"), (4, "NSE India", 1, "n4"), (5, "BSE India", 1, "b5"), (6, "ADX", 9, "a6")]
    entities, hits = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(found, "request_id int, source string, pos int, url string")
    want = {(1, "india", "BSE India", False, "b2"), (2, "india", "NSE India", False, "n2"), (3, "uk", "LSE", False, "l3"), (4, "india", "NSE India", True, "n4"), (6, "uae", "ADX", True, "a6")}
    assert {tuple(r) for r in routes.answered(entities, hits).collect()} == want
