"""Entity resolution as one job: partial answers of many sources, the first known one of each field, and where it came from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import dimensions as dim
from docsieve.operators import markets
from docsieve.operators.entities import country_of


def known(value: Column) -> Column:
    """The value, with '' and blanks as null."""
    return F.nullif(F.trim(value), F.lit(""))


def first_known(partials: Sequence[tuple[str, DataFrame]], fields: Sequence[str], *, key: str = "request_id") -> DataFrame:
    """``key`` and, for each field, ``field, field_source``: the value of the first source, in order, that has one.

    Each source gives rows with the key and some of the fields; '' counts as unknown, and of a source's several values the smallest is taken. All
    fields are chosen in one aggregation, which combines rows before the shuffle.
    """
    rows = None
    for rank, (source, df) in enumerate(partials):
        values = [known(F.col(f)).alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
        part = df.select(key, F.lit(rank).alias("rank of source"), F.lit(source).alias("source"), *values)
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(key).agg(*[F.min(F.when(F.col(f).isNotNull(), F.struct("rank of source", f, "source"))).alias(f) for f in fields])
    return best.select(key, *[c for f in fields for c in (F.col(f)[f].alias(f), F.col(f)["source"].alias(f"{f}_source"))])


def usable_page(url: Column) -> Column:
    """The address unless it is a file, an aggregator's or an exchange's."""
    fault = markets.page_fault(url)
    return F.when(fault.isNull() | (fault == "section"), url)


def resolve(requests: DataFrame, listings: DataFrame, matches: DataFrame, profiles: DataFrame, sites: DataFrame, *, key: str = "request_id") -> DataFrame:
    """One entity per request: name, country, exchange, ticker, Indian codes and investor page, the last three rules' sources beside them.

    ``requests (key, name, year)``; ``listings (key, code, ticker, isin, listed_name)`` from an instrument register; ``matches (key, exchange,
    symbol, description)`` from a symbol search, used where the register knows no exchange; ``profiles (ticker, profile_country,
    website)``, a row a ticker; ``sites (key, found_by, url)`` with ``found_by`` in ticker, name, country. Of several rows of a source
    the smallest value of each field counts.

    * exchange: the register's code, else the market of the search's exchange, else the country's usual one;
    * country: the ticker's own, else the profile's, else the code's, else that of the name;
    * page: a known company's; else the profile's website, else the site found by ticker (not for figures), name, or name and
      country. A page that is a file or lies on an aggregator or an exchange gives way to the first good one found by ticker or name.

    Unknown fields are ''. A request has one row, whatever the sources have.
    """
    asked = requests.select(key, "name", "year")
    register = listings.select(key, F.col("code").alias("exchange_mic"), "ticker", "isin", F.col("listed_name").alias("normalized_name"))
    listed = first_known([("register", register)], ["exchange_mic", "ticker", "isin", "normalized_name"], key=key)
    unlisted = asked.select(key).join(listed.where("exchange_mic is not null").select(key), key, "left_anti")
    found = matches.join(unlisted, key, "left_semi").select(
        key, markets.exchange_market(F.coalesce("exchange", F.lit(""))).alias("exchange_mic"), F.col("symbol").alias("ticker"), F.col("description").alias("normalized_name"))
    # a listed company without a name goes by the request's, before the search is looked at
    own = asked.join(listed.select(key), key, "left_semi").select(key, F.col("name").alias("normalized_name"))
    both = first_known([("register", register), ("request", own), ("search", found)], ["exchange_mic", "ticker", "isin", "normalized_name"], key=key)
    base = asked.join(both, key, "left").join(listed.select(key, F.col("exchange_mic").alias("code"), F.col("ticker").alias("listed_ticker")), key, "left")
    about = first_known([("profile", profiles.withColumnRenamed("profile_country", "of_profile"))], ["of_profile", "website"], key="ticker").select("ticker", "of_profile", "website")
    base = base.join(about, "ticker", "left")

    ticker = F.coalesce("ticker", F.lit(""))
    rules = (("override", markets.looked_up(dim.TICKER_COUNTRY, F.upper(ticker))), ("profile", F.col("of_profile")), ("exchange code", markets.looked_up(dim.CODE_COUNTRY, F.coalesce("code", F.lit("")))), ("name", known(country_of(F.coalesce("name", F.lit(""))))))
    base = base.withColumns({"country": F.coalesce(*[c for _, c in rules]), "country_source": reduce(lambda c, r: c.when(r[1].isNotNull(), r[0]), rules, F.when(F.lit(False), ""))})
    usual = markets.looked_up(dim.COUNTRY_MARKET, F.coalesce("country", F.lit("")))
    base = base.withColumns({"mic_source": F.coalesce("exchange_mic_source", F.when(usual.isNotNull(), "country")), "exchange_mic": F.coalesce("exchange_mic", usual)})

    url = known(F.col("url"))
    order = F.when(F.col("found_by") == "ticker", 0).when(F.col("found_by") == "name", 1).when(F.col("found_by") == "country", 2)
    pages = sites.select(key, order.alias("order"), url.alias("url"), "found_by").where("order is not null and url is not null").withColumn("good", usable_page(F.col("url")).isNotNull())
    pick = lambda good: F.min(F.when(good, F.struct("order", "url", F.concat(F.lit("found by "), "found_by").alias("how"))))
    by = lambda n: F.col("order") == n
    good = F.col("good")
    some = pages.groupBy(key).agg(pick(by(0)).alias("by_ticker"), pick(by(1)).alias("by_name"), pick(by(2)).alias("by_country"), pick(by(0) & good).alias("good_ticker"), pick(by(1) & good).alias("good_name"))
    base = base.join(some, key, "left").withColumn("known_page", known(markets.known_page(F.coalesce("name", F.lit("")), F.col("year"))))
    words = (ticker != "") & ~ticker.rlike(r"^\d+$")
    page = lambda value, how: F.when(value.isNotNull(), F.struct(value.alias("url"), F.lit(how).alias("how")))
    site = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["url"].alias("url"), F.col(c)["how"].alias("how")))
    first = F.coalesce(page(F.col("website"), "profile"), F.when(words, site("by_ticker")), site("by_name"), F.when(F.col("country").isNotNull(), site("by_country")))
    certain = page(F.col("known_page"), "known")
    chosen = F.coalesce(certain, first)
    base = base.withColumn("page", chosen)
    again = F.coalesce(F.when(words, site("good_ticker")), site("good_name"))
    base = base.withColumn("page", F.when(F.col("page").isNull() | usable_page(F.col("page.url")).isNotNull(), F.col("page")).otherwise(again))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = F.coalesce(F.col("listed_ticker").rlike(r"^\d+$"), F.lit(False))
    return base.select(
        key, text(F.col("normalized_name")).alias("normalized_name"), text(F.col("country")).alias("country"), text(F.col("country_source")).alias("country_source"), text(F.col("exchange_mic")).alias("exchange_mic"),
        text(F.col("mic_source")).alias("mic_source"), ticker.alias("ticker"), text(F.col("isin")).alias("isin"), text(F.col("page.url")).alias("ir_url"), text(F.col("page.how")).alias("ir_source"),
        text(F.when((F.col("code") == "IB") & number, F.col("listed_ticker"))).alias("bse_scripcode"), text(F.when(F.col("code").isin("IN", "NS") & ~number, F.col("listed_ticker"))).alias("nse_symbol"))
