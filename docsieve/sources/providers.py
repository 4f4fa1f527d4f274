"""Provider answers and filing feeds: JSON texts to rows, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators.ranking import top_n

ORGANIC = "organic array<struct<link:string,title:string,snippet:string>>"
RESULTS = "results array<struct<url:string,title:string,content:string>>"
FEED = "form array<string>, filingDate array<string>, reportDate array<string>, accessionNumber array<string>, primaryDocument array<string>"
LISTING = "Table array<struct<PDFLINK:string,HEADLINE:string,NEWSSUB:string,year:string>>"
HIT = "array<struct<url:string,title:string,snippet:string>>"


def hit_arrays(answers: DataFrame, *, key: str = "query_id", payload: str = "payload", provider: str = "provider") -> DataFrame:
    """``key, provider, hits``: both providers' answers in one shape. An exhausted provider (null) stays null, no hits are an empty array."""
    one = F.transform(F.from_json(payload, ORGANIC)["organic"], lambda h: F.struct(h["link"].alias("url"), h["title"].alias("title"), h["snippet"].alias("snippet")))
    two = F.transform(F.from_json(payload, RESULTS)["results"], lambda h: F.struct(h["url"].alias("url"), h["title"].alias("title"), h["content"].alias("snippet")))
    empty = F.expr(f"cast(array() as {HIT})")
    return answers.select(key, provider, F.when(F.col(payload).isNotNull(), F.coalesce(F.when(F.col(provider) == "first", one).otherwise(two), empty)).alias("hits"))


def with_fallback(arrays: DataFrame, *, key: str = "query_id", provider: str = "provider") -> DataFrame:
    """``key, used, pos, url, title, snippet``: the first provider's hits unless it gave null, else the second's; links with ``pdf`` only."""
    side = lambda name: F.any_value(F.when(F.col(provider) == name, F.col("hits")), ignoreNulls=True)
    both = arrays.groupBy(key).agg(side("first").alias("a"), side("second").alias("b"))
    rows = both.select(key, F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("used"), F.posexplode(F.coalesce("a", "b")).alias("pos", "h"))
    return rows.select(key, "used", "pos", "h.url", "h.title", "h.snippet").where(F.contains(F.lower("url"), F.lit("pdf")))


def filings(feeds: DataFrame, *, key: str = "company_id", payload: str = "payload") -> DataFrame:
    """Parallel arrays of a feed as rows in feed order; shorter arrays give nulls."""
    feed = F.from_json(payload, FEED)
    zipped = F.arrays_zip(*[feed[c].alias(c) for c in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")])
    rows = feeds.select(key, F.posexplode(zipped).alias("pos", "f"))
    return rows.select(
        key, "pos", F.col("f.form").alias("form"), F.to_date("f.filingDate").alias("filed"), F.to_date(F.nullif(F.col("f.reportDate"), F.lit(""))).alias("reported"),
        F.col("f.accessionNumber").alias("accession"), F.col("f.primaryDocument").alias("document"))


def filed_for_year(rows: DataFrame, *, form: str = "10-K", year: str = "year") -> DataFrame:
    """Filings of the form from the start of the year to the end of June after it."""
    window = F.col("filed").between(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.make_date(F.col(year) + 1, F.lit(6), F.lit(30)))
    return rows.where((F.col("form") == form) & window)


def fiscal_year(rows: DataFrame, *, form: str = "10-K", year: int | None = None) -> DataFrame:
    """Filings of the form or its amendment with their fiscal year, of one year where given."""
    out = rows.where(F.col("form").isin(form, f"{form}/A")).withColumn("fiscal_year", F.year(F.coalesce("reported", "filed")))
    return out if year is None else out.where(F.col("fiscal_year") == year)


def archive_links(rows: DataFrame, *, cik: str = "cik", most: int = 5) -> DataFrame:
    """The first filings of each company with their archive address: number without zeros, accession without dashes."""
    parts = [F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.translate("accession", "-", ""), F.lit("/"), F.col("document")]
    return top_n(rows.withColumn("url", F.concat(*parts)), [cik], [F.asc("pos")], most, "place")


def index_documents(filings_: DataFrame, index: DataFrame, *, strict: bool = False) -> DataFrame:
    """For ``.htm`` filings the first PDF of their index page; without one the page itself, or nothing if ``strict``.

    ``index (url, pos, href)`` lists the links of index pages.
    """
    pdf = index.where(F.lower("href").endswith(".pdf")).groupBy("url").agg(F.min_by("href", "pos").alias("pdf"))
    joined = filings_.join(pdf, "url", "left")
    page = F.lower("url").rlike(r"\.html?$")
    resolved = joined.withColumn("resolved", F.when(page, F.coalesce("pdf", F.lit(None).cast("string") if strict else F.col("url"))).otherwise(F.col("url")))
    return resolved.where("resolved is not null").drop("pdf")


def listings(answers: DataFrame, *, key: str = "company_id", payload: str = "payload") -> DataFrame:
    """Rows of an exchange's annual-report table with one text of all their fields."""
    rows = answers.select(key, F.posexplode(F.from_json(payload, LISTING)["Table"]).alias("pos", "r"))
    return rows.select(key, "pos", F.col("r.PDFLINK").alias("url"), F.concat_ws(" ", "r.HEADLINE", "r.NEWSSUB", "r.year", "r.PDFLINK").alias("text")).where("url is not null and url <> ''")


def disclosures(companies: DataFrame, notices: DataFrame, files: DataFrame, *, year: str = "year") -> DataFrame:
    """``company_id, url``: a company's first annual notice of the year with a PDF, over three tables; of equal places the smallest notice.

    ``notices (company_id, notice_id, pos, period, kind)``; ``files (notice_id, pos, url)``.
    """
    annual = F.contains(F.lower("kind"), F.lit("annual")) | F.contains(F.lower("kind"), F.lit("faaliyet"))
    found = companies.join(notices.where(annual).withColumnRenamed("pos", "notice_pos"), "company_id").where(F.contains("period", F.col(year).cast("string")))
    pdfs = files.where(F.contains(F.lower("url"), F.lit(".pdf")))
    return found.join(pdfs, "notice_id").groupBy("company_id").agg(F.min_by("url", F.struct("notice_pos", "pos", "notice_id")).alias("url"))
