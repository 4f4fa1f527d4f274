"""The crawl on a small site with circles, files, errors and foreign hosts."""

from docsieve.operators import crawl


def site(spark):
    link = lambda *to: "".join(f'<a href="{t}">Investors</a>' for t in to)
    rows = [
        (1, "http://a.com/start", link("/two", "http://b.com/annual", "/missing", "/start"), 200), (2, "http://a.com/two", link("/start", "/three", "two"), 200),
        (3, "http://a.com/three", '<a href="x.pdf">Annual report</a>' + link("/four"), 200), (4, "http://a.com/four", link("/start"), 200), (5, "http://a.com/reports", link("/broken", "/three"), 200),
        (6, "http://a.com/broken", link("/four"), 500), (7, "http://b.com/annual", "", 200), (8, "http://a.com/file.PDF", "", 200), (9, "http://c.com/empty", None, 200), (9, "http://c.com/empty", None, 200),
    ]
    return spark.createDataFrame(rows, "page_id int, url string, html string, status int")


def found(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_pages_in_reach(spark):
    pages = site(spark)
    starts = spark.createDataFrame([("s", "http://a.com/start"), ("s", "http://a.com/start"), ("t", "http://a.com/three"), ("b", "http://a.com/broken"), ("f", "http://a.com/file.PDF"), ("c", "http://c.com/empty"), ("n", None)], "root string, url string")
    a = "http://a.com/"
    want = {("s", a + "start", 0), ("s", a + "two", 1), ("s", a + "reports", 1), ("s", a + "three", 2), ("t", a + "three", 0), ("c", "http://c.com/empty", 0)}
    got = crawl.in_reach(starts, pages, depth=5)
    assert found(got, "root", "url", "depth") == want  # three has a document, so four is not reached
    assert found(crawl.in_reach(starts, pages, depth=1), "root", "url", "depth") == {w for w in want if w[2] < 2}
    assert found(crawl.documents_in_reach(got, pages), "root", "depth", "link") == {("s", 2, a + "x.pdf"), ("t", 0, a + "x.pdf")}


def test_hops_are_at_most_twelve(spark):
    many = "".join(f'<a href="/investors/{i}">x</a>' for i in range(20)) + '<a href="/reports">x</a>'
    pages = spark.createDataFrame([(1, "https://a.com/", many), (2, "https://a.com/archive", "")], "page_id int, url string, html string")
    hops = found(crawl.hops(pages), "src", "dst")
    first = {t for s, t in hops if s == "https://a.com/"}
    assert len(first) == 12 and {f"https://a.com/investors/{i}" for i in range(5)} < first and "https://a.com/archive" not in {t for s, t in hops if s == "https://a.com/archive"}
    assert len([1 for s, _ in hops if s == "https://a.com/archive"]) == 9


def test_nothing_to_crawl(spark):
    pages = site(spark)
    assert crawl.in_reach(spark.createDataFrame([], "root string, url string"), pages).count() == 0
    assert crawl.in_reach(spark.createDataFrame([("s", "http://a.com/start")], "root string, url string"), pages.where("false")).count() == 0


def test_packed_hops_are_those_of_rows(spark):
    """Taken for all pages at once, hops reach the same pages and documents; the standard paths count only where they are pages."""
    pages = site(spark)
    starts = pages.selectExpr("url as root", "url").unionByName(spark.createDataFrame([("s", "http://a.com/start"), ("s", "http://a.com/reports"), ("n", None), ("m", "http://a.com/missing")], "root string, url string"))
    rows = crawl.in_reach(starts, pages, depth=3)
    want = found(rows, "root", "url", "depth")
    assert found(crawl.in_reach(starts, pages, depth=3, packed=3), "root", "url", "depth") == want and ("s", "http://a.com/three", 1) in want
    documents = found(crawl.documents_in_reach(rows, pages), "root", "depth", "link", "text")
    assert found(crawl.documents_within(starts, pages, depth=3), "root", "depth", "link", "text") == documents and ("http://a.com/start", 2, "http://a.com/x.pdf", "Annual report") in documents
