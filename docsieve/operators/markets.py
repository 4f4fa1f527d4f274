"""Exchanges, countries and investor pages by the fixed rule tables.

Every rule is one expression over the row, so nothing is shuffled or joined.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import dimensions as dim
from docsieve.functions.text import any_of, host


def chosen(rows: tuple[tuple[str, str], ...], test) -> Column:
    """The value of the first row whose key passes the test; '' if none does."""
    return reduce(lambda c, r: c.when(test(r[0]), r[1]), rows, F.when(F.lit(False), "")).otherwise("")


def within(rows: tuple[tuple[str, str], ...], text: Column) -> Column:
    """The value of the first row whose key lies within the text; '' if none does. Keys are tried one by one only where one of them occurs."""
    return F.when(any_of(text, [k for k, _ in rows]), chosen(rows, lambda key: F.contains(text, F.lit(key)))).otherwise("")


def exchange_market(exchange: Column) -> Column:
    """Market code of an exchange's name."""
    return within(dim.EXCHANGE_NAMES, F.upper(exchange))


def looked_up(rows: tuple[tuple[str, str], ...], key: Column) -> Column:
    """The value of a key by equality; null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for r in rows for x in r]), key)


def country(ticker: Column, code: Column, guess: Column) -> Column:
    """A ticker's own country, else its exchange code's, else the guess from the name."""
    return F.coalesce(looked_up(dim.TICKER_COUNTRY, F.upper(ticker)), looked_up(dim.CODE_COUNTRY, code), guess, F.lit(""))


def market(exchange: Column, country_: Column) -> Column:
    """Market code of the exchange's name, else the country's usual one."""
    named = exchange_market(F.coalesce(exchange, F.lit("")))
    return F.when(named != "", named).otherwise(F.coalesce(looked_up(dim.COUNTRY_MARKET, country_), F.lit("")))


def own_ending(url: Column, country_: Column) -> Column:
    """Whether the site ends as those of the country do; null where no ending is known."""
    endings = F.split(looked_up(dim.COUNTRY_DOMAINS, country_), ",")
    return F.exists(endings, lambda e: F.endswith(host(url), e))


def exchanges(countries: Column) -> Column:
    """Exchanges of a country, or of several joined by ``/``: the list for exactly these, else each one's in turn."""
    known = looked_up(dim.SHARED_LISTINGS, countries)
    own = F.create_map(*[F.lit(x) for c, e, _ in dim.COUNTRY_EXCHANGES for x in (c, e)])
    each = F.filter(F.transform(F.split(countries, "/"), lambda c: F.try_element_at(own, c)), lambda e: e.isNotNull())
    return F.array_distinct(F.flatten(F.transform(F.when(known.isNotNull(), F.array(known)).otherwise(each), lambda e: F.split(e, ","))))


def known_page(name: Column, year: Column) -> Column:
    """Address of a known company's investor page: of the first key within the lower-case name; '' if none is."""
    page = within(dim.KNOWN_PAGES, F.lower(F.trim(name)))
    return F.replace(page, F.lit("{year}"), year.cast("string"))


def either(words) -> str:
    return "|".join(re.escape(w) for w in words)


def page_fault(url: Column) -> Column:
    """Why an address is no investor page: 'file', 'aggregator', 'exchange' or 'section' (another part of the site); else null.

    Leading signs ``w`` and ``.`` of the host are left out before it is held against the lists of sites.
    """
    site = host(url)
    bare = F.regexp_replace(site, "^[w.]+", "")
    file = F.lower(url).rlike(r"\.(pdf|doc|docx|xls|xlsx|zip|rar)$")
    # One pattern for a list, so that the host is cut out once for it and not for each of its words.
    return (
        F.when(file, "file").when(any_of(bare, dim.AGGREGATORS), "aggregator")
        .when(bare.rlike(rf"(?:^|\.)(?:{either(dim.EXCHANGE_SITES)})\z"), "exchange").when(site.rlike(f"^(?:{either(dim.REJECTED_BEGINNINGS)})"), "section")
    )


def page_preferred(url: Column) -> Column:
    """Whether the host's beginning speaks of investors."""
    return host(url).rlike(f"^(?:{either(dim.PREFERRED_BEGINNINGS)})")


def investor_page(name: Column, year: Column, resolved: Column) -> Column:
    """The page to use: a known company's, else the resolved one if it is no file, aggregator or exchange; else ''."""
    known = known_page(name, year)
    fault = page_fault(resolved)
    kept = F.when(fault.isNull() | (fault == "section"), resolved)
    return F.when(known != "", known).otherwise(F.coalesce(kept, F.lit("")))
