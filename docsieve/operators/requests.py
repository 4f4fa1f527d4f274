"""Jobs over a table of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions import requests as rq


def parsed(requests: DataFrame, *, as_of_year: int, text: str = "raw_query") -> DataFrame:
    """Adds ``company_name, doc_type, asked_year, sector`` as a request's text gives them; null texts count as empty."""
    q = F.coalesce(text, F.lit(""))
    df = requests.withColumns({"company_name": rq.company_name(q), "doc_type": rq.document_type(q), "asked_year": rq.request_year(q, as_of_year)})
    return with_sector(df, F.concat_ws(" ", q, F.col("company_name")))


def with_sector(df: DataFrame, text) -> DataFrame:
    """Adds ``sector`` and ``sector_hits``: the sector with most keywords in the text, the earlier one at a tie, else ''."""
    hits = df.withColumn("sector hits", rq.sector_hits(text))
    # Strictly more hits replace the best so far, so ties stay with the earlier sector.
    best = F.aggregate("sector hits", F.struct(F.lit("").alias("sector"), F.lit(0).alias("hits")), lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a))
    return hits.withColumn("best sector", best).withColumns({"sector": F.col("best sector.sector"), "sector_hits": F.col("best sector.hits")}).drop("sector hits", "best sector")


def filing_request(requests: DataFrame, master: DataFrame, *, text: str = "raw_query") -> DataFrame:
    """Adds ``quarter, kind, form, found_ticker, found_name`` by the second dialect's rules.

    The quarter's words are taken out before the kind is looked for. ``master (ticker, name)`` must not repeat tickers.
    """
    q = F.coalesce(text, F.lit(""))
    kind = rq.filing(rq.without_quarter(q))
    df = requests.withColumns({"quarter": rq.quarter(q), "kind": kind["kind"], "form": kind["form"], "asked ticker": rq.ticker(q)})
    known = master.select(F.col("ticker").alias("found_ticker"), F.col("name").alias("found_name"))
    return df.join(known, F.col("asked ticker") == F.col("found_ticker"), "left").drop("asked ticker")


def subdomain_variants(entities: DataFrame, *, url: str = "ir_url", names: tuple[str, ...] = ("ir", "investors", "investor", "static", "cdn", "assets", "media", "www")) -> DataFrame:
    """Rows of ``variant``: the site's base domain under each name, without the host itself."""
    from docsieve.functions.text import host

    parts = F.split(host(F.col(url)), r"\.")
    base = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    df = entities.withColumn("base domain", base).withColumn("sub", F.explode(F.array(*[F.lit(n) for n in names])))
    return df.withColumn("variant", F.concat_ws("", F.lit("https://"), "sub", F.lit("."), "base domain")).where(F.concat("sub", F.lit("."), "base domain") != host(F.col(url))).drop("sub", "base domain")


def titled(df: DataFrame) -> DataFrame:
    """Adds ``title`` and a safe ``file`` name of at most 100 characters."""
    title = F.concat(F.col("name"), F.lit(" - "), F.initcap(F.translate("doc_type", "_", " ")), F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    safe = F.left(F.lower(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9]+", "_"), "_+", "_")), F.lit(100))
    return df.withColumns({"title": title, "file": safe})


def confidence(score):
    """Badge of a score."""
    return F.when(score >= 1.80, "high").when(score >= 1.20, "medium").otherwise("low")
