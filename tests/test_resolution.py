"""Entity resolution on hand-made answers of the sources."""

import pytest

from docsieve.operators import resolution


def frames(spark, requests, listings=(), matches=(), profiles=(), sites=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return (
        make(requests, "request_id int, name string, year int"), make(listings, "request_id int, code string, ticker string, isin string, listed_name string"), make(matches, "request_id int, exchange string, symbol string, description string"),
        make(profiles, "ticker string, profile_country string, website string"), make(sites, "request_id int, found_by string, url string"),
    )


def resolved(spark, *tables, **more):
    rows = resolution.resolve(*frames(spark, *tables, **more)).collect()
    assert len({r["request_id"] for r in rows}) == len(rows)
    return {r["request_id"]: r for r in rows}


def test_first_known_by_field(spark):
    one = spark.createDataFrame([(1, "a", ""), (2, " ", None), (1, "b", None)], "request_id int, x string, y string")
    two = spark.createDataFrame([(1, "c", "d"), (3, None, "e")], "request_id int, x string, y string")
    got = {tuple(r) for r in resolution.first_known([("one", one), ("two", two)], ["x", "y"]).collect()}
    assert got == {(1, "a", "one", "d", "two"), (2, None, None, None, None), (3, None, None, "e", "two")}


def test_sources_in_order(spark):
    got = resolved(
        spark, [(1, "Acme Works", 2023), (2, "Acme Limited", 2023), (3, "Plain", 2023), (4, None, None), (5, "Scrip", 2020), (6, "Sym", 2020), (7, "Late", 2020)],
        listings=[(1, "LN", "ACME", "GB1", ""), (2, "", "OWN", "", "Listed Name"), (5, "IB", "500325", "", ""), (6, "NS", "RELI", "", "R"), (7, "JP", "MTN", "", "")],
        matches=[(1, "NYSE", "WRONG", "wrong"), (2, "Bombay Exchange", "SYM", "found"), (3, "unheard of", "PL.X", "Plain plc")],
        profiles=[("ACME", "US", "http://acme.com"), ("PL.X", "", ""), ("MTN", "NG", "")],
    )
    assert (got[1]["exchange_mic"], got[1]["mic_source"], got[1]["country"], got[1]["country_source"], got[1]["normalized_name"], got[1]["ir_url"], got[1]["ir_source"]) == ("LN", "register", "US", "profile", "Acme Works", "http://acme.com", "profile")
    assert (got[2]["exchange_mic"], got[2]["mic_source"], got[2]["ticker"], got[2]["normalized_name"], got[2]["country"], got[2]["country_source"]) == ("XBOM", "search", "OWN", "Listed Name", "IN", "name")
    assert (got[3]["ticker"], got[3]["normalized_name"], got[3]["exchange_mic"], got[3]["country"]) == ("PL.X", "Plain plc", "", "")
    assert set(got[4]) == {4, ""}
    assert (got[5]["bse_scripcode"], got[5]["nse_symbol"]) == ("500325", "") and (got[6]["bse_scripcode"], got[6]["nse_symbol"]) == ("", "RELI")
    assert (got[7]["country"], got[7]["country_source"]) == ("ZA", "override")


@pytest.mark.parametrize("website,sites,ticker,want", [
    ("http://a.com", [("ticker", "http://t.com")], "T", "http://a.com"), ("", [("ticker", "http://t.com"), ("name", "http://n.com")], "T", "http://t.com"), ("", [("ticker", "http://t.com"), ("name", "http://n.com")], "123", "http://n.com"),
    ("", [("country", "http://c.com")], "T", "http://c.com"), ("http://a.com/x.pdf", [("name", "http://n.com")], "T", "http://n.com"), ("http://www.bseindia.com", [("ticker", "http://t.com/y.zip"), ("name", "http://n.com")], "T", "http://n.com"),
    ("http://www.bseindia.com", [("country", "http://c.com")], "T", ""), ("http://a.com/x.pdf", [], "T", ""),
])
def test_pages(spark, website, sites, ticker, want):
    got = resolved(spark, [(1, "Acme", 2023)], listings=[(1, "LN", ticker, "", "")], profiles=[(ticker, "", website)], sites=[(1, *s) for s in sites])
    assert got[1]["ir_url"] == want
