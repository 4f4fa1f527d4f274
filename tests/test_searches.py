"""Searches compiled to clauses and evaluated as joins, on hand-made hits."""

from docsieve.operators import searches

HITS = [
    (1, "https://ir.acme.com/files/annual-report-2023.pdf", "Acme Steel annual report"), (2, "https://acme.com/report.html?x=1.pdf", "Report annual 2023"), (3, "https://www.sec.gov/acme-10k-2022.PDF?d=1", "ACME Steel 10-K"),
    (4, "https://notacme.com/annual/report/2023.pdf", "Steel: Acme"), (5, "https://bseindia.com/y", "Été 2022-23 rapport annuel"), (6, "https://x.org/FY-24.pdf", None),
]


def found(spark, *texts):
    """Hits of the first text that has any, and how many free words each has."""
    plans = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)] + [(8, 0, "nothing here"), (9, 0, "")], "request_id int, ord int, query string")
    hits = spark.createDataFrame([(7, *h) for h in HITS] + [(9, 1, "http://a.b/", "")], "request_id int, pos int, url string, link_text string")
    rows = [tuple(r) for r in searches.answers(plans, hits).collect()]
    assert all(r[0] == 7 for r in rows) and len(rows) == len(set(rows))
    return sorted(r[1:] for r in rows)


def test_clauses(spark):
    assert found(spark, 'site:acme.com "annual report" 2023 filetype:pdf') == [(0, 1, 0)]
    assert found(spark, "site:acme.com 2023 annual report") == [(0, 1, 2), (0, 2, 2)]
    assert found(spark, "SITE:com filetype:PDF") == [(0, 1, 0), (0, 4, 0)]
    assert found(spark, "site:sec.gov OR site:bseindia.com OR site:sedar.com steel") == [(0, 3, 1), (0, 5, 0)]
    assert found(spark, '"acme steel" OR "2022-23"') == [(0, 1, 0), (0, 3, 0), (0, 5, 0)]
    assert found(spark, "2022-23") == [(0, 5, 0)] == found(spark, '"été 2022"')
    assert found(spark, 'site:x.org "FY-24"') == [(0, 6, 0)] and found(spark, "site:x.org FY24") == []


def test_strictest_first(spark):
    assert found(spark, '"no such phrase"', "site:acme.com 2022", "acme steel") == [(2, 1, 2), (2, 2, 1), (2, 3, 2), (2, 4, 2)]
    assert found(spark, "rapport", "acme") == [(0, 5, 1)]
    assert found(spark, "", '""', "site: -", "filetype:") == []


def test_plans(spark):
    rows = [(1, "Acme PJSC", "AE", 2023, "annual_report", None, "https://ir.acme.ae/x"), (2, "Tata Works", "", 2010, "quarterly_report", "Annual Report", ""), (3, "Plain", "GB", 2000, "other", "rapport annuel", None), (4, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "request_id int, name string, country string, year int, doc_type string, native_term string, ir_url string")
    plan = {(r["request_id"], r["ord"]): r["query"] for r in searches.plan(df).collect()}
    assert sorted(o for k, o in plan if k == 1) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12] == sorted(o for k, o in plan if k == 2) and sorted(o for k, o in plan if k == 3) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert plan[2, 11] == '"Tata Works" 2009-10 annual report filetype:pdf' and plan[2, 1] == '"Tata Works" quarterly report 2010 filetype:pdf' and plan[3, 4] == "Plain annual report 1999-00 filetype:pdf"
    site = {(r["request_id"], r["ord"]): r["query"] for r in searches.site_plan(df).collect()}
    assert sorted(site) == [(1, o) for o in range(1, 7)] and site[1, 3] == 'site:ir.acme.ae "FY-23" filetype:pdf' and site[1, 4] == "site:ir.acme.ae FY24 filetype:pdf"
