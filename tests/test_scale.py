"""Cases that small tables don't show: many rows of one key, ties, rows out of order, and how many rows joins make."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docsieve.functions import rules, scoring
from docsieve.functions.text import branches, shortest
from docsieve.operators import markets, matching, searches
from docsieve.plans import waterfall
from docsieve.sources import providers
from docsieve.streaming import sessions


def rows_made(df):
    """The rows that each operator of the executed plan gave, by its name."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append((name, metric.get().value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_name_of_many_companies_meets_a_request_once(spark):
    n = 300
    companies = spark.range(n).selectExpr("id as company_id", "concat('T', id) as ticker", "if(id % 2 = 0, 'Acme', 'ACME') as name")
    asked = spark.range(n).selectExpr("id as request_id", "if(id = 7, 't9', ' acme ') as asked")
    df = matching.exact(asked, companies, text="asked")
    got = {r["request_id"]: (r["company_id"], r["by"]) for r in df.collect()}
    assert got == {i: (9, "ticker") if i == 7 else (1, "name") for i in range(n)}
    assert max(v for k, v in rows_made(df) if "Join" in k) <= n


def test_disclosures_at_the_same_place(spark):
    companies = spark.createDataFrame([(1, 2000)], "company_id int, year int")
    notices = spark.createDataFrame([(1, 30, 5, "2000/1", "Annual"), (1, 20, 5, "2000/2", "Annual"), (1, 40, 5, "2000/3", "Faaliyet")], "company_id int, notice_id int, pos int, period string, kind string")
    files = spark.createDataFrame([(30, 0, "a.pdf"), (20, 0, "z.PDF"), (40, 0, "b.pdf")], "notice_id int, pos int, url string")
    for part in (notices, notices.orderBy("notice_id"), notices.orderBy("pos", "kind")):
        assert [tuple(r) for r in providers.disclosures(companies, part.coalesce(1), files).collect()] == [(1, "z.PDF")]


def test_a_session_in_several_parts_and_out_of_order(spark, tmp_path):
    start = datetime(2024, 5, 1)
    rows = [(1, i, "done" if i in (40, 70) else "status", start + timedelta(seconds=i // 2)) for i in range(100)] + [(2, i, "status", start) for i in range(30)]
    schema = "session_id long, seq long, kind string, ts timestamp"
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a session comes in many parts
    try:
        found = sessions.until_closed_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sorted(tuple(r)[:2] for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, i) for i in range(41)] + [(2, i) for i in range(30)]


def test_words_of_searches_are_no_rows(spark):
    n = 150
    plans = spark.createDataFrame([(1, i, f'site:acme.com "annual report" {2020 + i} filetype:pdf some more words') for i in range(4)], "request_id int, ord int, query string")
    hits = spark.range(n).selectExpr("1 as request_id", "cast(id as int) as pos", "concat('https://ir.acme.com/annual-report-', 2021 + id % 5, '-of-many-words-and-more.pdf') as url", "'some text of a link' as link_text")
    df = searches.answers(plans, hits)
    assert {tuple(r) for r in df.collect()} == {(1, 1, i, 3) for i in range(0, n, 5)}
    assert max(v for _, v in rows_made(df)) <= 4 * n


def test_a_waterfall_over_one_table_reads_it_once(spark, tmp_path):
    rows = [(r, f"u{i}", ("web", "exchange", "ir_crawl")[(r + i) % 3], 0.5 + (r * 7 + i * 11) % 10 / 10, (r + i) % 4 > 0, i % 3, i % 2) for r in range(30) for i in range(r % 6)]
    spark.createDataFrame(rows, "request_id int, url string, source string, score double, alive boolean, source_tier int, phase int").write.parquet(f"{tmp_path}/pool")
    pool, requests = spark.read.parquet(f"{tmp_path}/pool"), spark.range(28).selectExpr("cast(id as int) as request_id")
    df = waterfall.waterfall_of(pool, requests, [("direct", F.col("source") != "web"), ("web", F.col("source") == "web")])
    stage = lambda where: lambda open_: pool.where(where).join(open_.select("request_id"), "request_id", "left_semi")
    want = waterfall.waterfall(requests, [("direct", stage("source <> 'web'")), ("web", stage("source = 'web'"))])
    columns = ["request_id", "url", "score", "stage"]
    assert {tuple(r) for r in df.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}
    assert {r["stage"] for r in df.collect()} == {"direct", "web"}
    assert sum("Scan parquet" in k for k, _ in rows_made(df)) == 1


def test_no_rule_on_the_type_is_evaluated_twice(spark):
    row = ("https://a.com/report-x2022-23.pdf", "Acme", 2023, "annual_report", "https://a.com", 200, "application/pdf")
    df = scoring.scored(spark.createDataFrame([row, ("https://a.com/report-2022-23.pdf", *row[1:])], "url string, name string, year int, doc_type string, ir_url string, head_status int, content_type string"))
    plan = df.select("reject")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(branches(shortest(rules.REJECT_PATH))) == 1
    assert [r["year_points"] for r in df.collect()] == [50, 50]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_scored_once_before_a_filter(spark):
    links = spark.createDataFrame([("https://a.com/ar-2020.pdf", 2020), ("https://a.com/x-2021.pdf", 2020), (None, 2020), ("https://a.com/2019-20/x", None)], "url string, year int")
    points = scoring.prepared(links).withColumn("points", scoring.year_points(F.col("year")))
    assert [r["points"] for r in points.collect()] == [50, -1, 0, -1]
    kept = points.where("points >= 0").select("url", "points")
    assert plan_of(kept).count("points_of_years") == 1
    assert kept.count() == 2


def test_forms_of_a_year_are_no_list_for_each_row(spark):
    links = spark.createDataFrame([("https://a.com/fy20.pdf", "x", 2020, False), ("https://a.com/2019-20.pdf", "x", 2020, False), ("https://a.com/2018.pdf", "2020", 2020, True), ("https://a.com/1.pdf", None, None, False)], "url string, t string, year int, prior boolean")
    found = links.withColumn("found", scoring.prior_year(F.col("url"), F.col("t"), F.col("year")))
    assert "exists(" not in plan_of(found)
    assert [r["found"] for r in found.collect()][:3] == [r["prior"] for r in links.collect()][:3]


def test_the_host_is_cut_out_once_for_a_list_of_sites(spark):
    sites = spark.createDataFrame([("https://www.bseindia.com/x",), ("https://notbseindia.com",), ("https://www.a.com/b.pdf",)], "url string").withColumn("fault", markets.page_fault(F.col("url")))
    assert plan_of(sites).count("regexp_extract") <= 4
    assert [r["fault"] for r in sites.collect()] == ["exchange", None, "file"]


def test_links_ruled_out_are_left_out_before_points(spark):
    """``only_kept`` gives the rows that are not ruled out, scores unchanged, and the rule of years runs behind a filter."""
    from docsieve.functions import scoring

    rows = [
        ("https://a.com/annual-report-2023.pdf", 200), ("https://www.careratings.com/annual-report-2023.pdf", 200), ("https://a.com/agm/annual-2023.pdf", 200), ("https://a.com/annual-report-2019.pdf", 200),
        ("https://a.com/annual-report.html", 200), ("https://a.com/annual-2023.pdf", 404), ("https://a.com/report.pdf", None), (None, None),
    ]
    links = spark.createDataFrame(rows, "url string, head_status int").selectExpr("url", "head_status", "'A' as name", "2023 as year", "'annual_report' as doc_type", "'https://a.com' as ir_url", "'application/pdf' as content_type")
    every, kept = scoring.scored(links), scoring.scored(links, only_kept=True)
    want = sorted(map(str, every.where("reject is null").select("url", "score", "year_points").collect()))
    assert sorted(map(str, kept.select("url", "score", "year_points").collect())) == want and len(want) == 4  # a page that answers as a PDF counts as one
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 2
