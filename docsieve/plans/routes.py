"""Routes to exchanges: which sources a company is looked up in, one after the other, and what comes of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import any_of
from docsieve.operators.entities import uae_order
from docsieve.operators.ranking import top_n

# Route, exchange codes, countries, words of the name, sources in order. The first row that fits decides.
ROUTES = (
    ("us", ("XNYS", "XNAS", "ARCX", "US", "UN", "UW", "UA", "UR"), ("US",), (), ("SEC EDGAR",)),
    ("india", ("XBOM", "XNSE", "IB", "IN", "NS", "IS"), ("IN",), (), ("BSE India", "NSE India")),
    ("turkey", ("XIST", "TK", "TI"), ("TR",), ("a.ş",), ("KAP Turkey",)),
    ("japan", ("XTKS", "XOSE", "XNGO", "XSAP", "XFKA", "JP", "JT"), ("JP",), (), ("JPX / EDINET",)),
    ("euronext", ("XPAR", "XAMS", "XBRU", "XLIS", "XDUB", "PA", "AM", "BB", "LB", "ID"), ("FR", "NL", "BE", "PT", "IE"), (), ("Euronext",)),
    ("uk", ("XLON", "LN", "IL"), ("GB",), (), ("LSE",)),
    ("saudi", ("XSAU", "AB", "SR"), ("SA",), (), ("Tadawul",)),
    ("uae", ("XDFM", "XADS", "DU", "AD", "DF"), ("AE",), (), ("DFM", "ADX", "UAE Web Search")),
    ("malaysia", ("XKLS", "MK", "KL"), ("MY",), (), ("Bursa Malaysia",)),
    ("singapore", ("XSES", "SP", "SG"), ("SG",), (), ("SGX",)),
    ("thailand", ("XBKK", "TB", "BK"), ("TH",), (), ("SET Thailand",)),
    ("south africa", ("XJSE", "SJ", "JO"), ("ZA",), (), ("JSE",)),
    ("nigeria", ("XNSA", "LA", "NL"), ("NG",), (), ("NGX",)),
    ("caribbean", (), ("TT", "JM"), (), ("Caribbean Exchange",)),
)
# Where nothing came of the route, the words of a name that call for another one, in order.
NAME_ROUTES = (
    ("uae", ("pjsc", "p.j.s.c", "dfm", "dubai", "abu dhabi", "emaar", "adnoc", "emirates nbd")),
    ("india", (" limited", " ltd", " industries", " enterprises", " corporation")),
)
SOURCES = {route: sources for route, *_, sources in ROUTES}


def route(mic: Column, country: Column, name: Column) -> Column:
    """The route of an exchange code, else a country, else words of the name; null if none fits."""
    code, land, low = F.upper(mic), F.upper(country), F.lower(name)
    out = F.when(F.lit(False), "")
    for label, codes, countries, words, _ in ROUTES:
        fits = F.coalesce(land.isin(*countries), F.lit(False))
        fits = fits | F.coalesce(code.isin(*codes), F.lit(False)) if codes else fits
        fits = fits | F.coalesce(any_of(low, words), F.lit(False)) if words else fits
        out = out.when(fits, label)
    return out


def name_route(name: Column) -> Column:
    """The route that a name alone calls for, or null."""
    return reduce(lambda c, r: c.when(any_of(F.lower(name), r[1]), r[0]), NAME_ROUTES, F.when(F.lit(False), ""))


def sources_of(route_: Column, name: Column) -> Column:
    """A route's sources in order; in the Emirates the company's own exchange goes first. Empty without a route."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for label, sources in SOURCES.items():
        own = F.concat(uae_order(name), F.array(F.lit("UAE Web Search"))) if label == "uae" else F.array(*[F.lit(s) for s in sources])
        out = out.when(route_ == label, own)
    return F.coalesce(out, F.array().cast("array<string>"))


def steps(entities: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, step, route, source, by_name``: the sources to ask for each company until one answers.

    Needs ``exchange_mic, country, company_name, normalized_name``; '' and null are unknown. After the sources of
    the route come those that the name calls for; a source is asked once.
    """
    name = F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), F.col("company_name"), F.lit(""))
    first, second = route(F.col("exchange_mic"), F.col("country"), name), name_route(name)
    tagged = lambda r, by_name: F.transform(sources_of(r, name), lambda s: F.struct(r.alias("route"), s.alias("source"), F.lit(by_name).alias("by_name")))
    rows = entities.select(key, F.posexplode(F.concat(tagged(first, False), tagged(second, True))).alias("step", "s")).select(key, "step", "s.*")
    return top_n(rows, [key, "source"], [F.asc("step")])


def answered(entities: DataFrame, found: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, route, source, by_name, url``: the first answer along each company's steps.

    ``found (key, source, pos, url)`` is what the sources have; a null or empty url is no answer. One equi-join on company and source, so no
    source is read for companies that do not ask it; the answers of later steps are dropped before the shuffle of the ranking.
    """
    usable = found.where("url <> ''").select(key, "source", "pos", "url")
    return top_n(steps(entities, key=key).join(usable, [key, "source"]), [key], [F.asc("step"), F.asc("pos"), F.asc("url")]).select(key, "route", "source", "by_name", "url")
