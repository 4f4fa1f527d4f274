"""Entity resolution: which company a request means, where it lists, which site is its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import requests as rq
from docsieve.functions.text import any_of, bare_host, host
from docsieve.operators.containment import containing
from docsieve.operators.markets import page_fault
from docsieve.operators.ranking import top_n

# Words that tell a company's country, in order.
COUNTRY_WORDS = (
    ("AE", ("pjsc", "p.j.s.c", "dubai", "abu dhabi", "emaar", "adnoc", "emirates nbd", "dib", "dfm", "etisalat", "du telecom")),
    ("TR", ("a.ş.", "a.s.", "anonim şirket", "botas", "botaş")),
    ("IN", (" limited", " ltd.", " ltd,", " industries", " enterprises", " pharmaceuticals", " infosys", " wipro", " tata ", "reliance ")),
)
# Words of Indian companies' names.
INDIAN_NAMES = (
    "LIMITED", "LTD", "INDIA", "INDIAN", "BHARAT", "HINDUSTAN", "TATA", "RELIANCE", "ADANI", "BAJAJ", "MAHINDRA", "BIRLA", "INFOSYS", "WIPRO", "HCL", "SBI", "ICICI", "HDFC", "KOTAK", "AXIS",
)
# Words of companies of Abu Dhabi.
ABU_DHABI = ("abu dhabi", "adnoc", "aldar", "etihad", "mubadala", "ipic", "taqa", "adcb", "adib", "first abu dhabi", "fab bank", "masdar")
# Legal suffixes.
SUFFIXES = (" limited", " ltd", " inc", " plc", " corp")
# Words that tell nothing about a domain.
DOMAIN_IGNORED = (
    "limited", "ltd", "inc", "corp", "corporation", "group", "plc", "llc", "africa", "african", "bank", "national", "global", "international", "america", "american", "europe", "european",
    "the", "and", "for",
)
# Words without a place in an acronym.
ACRONYM_IGNORED = ("limited", "ltd", "inc", "corp", "corporation", "group", "plc", "llc", "the", "and", "for")
# Sites that are no company's, in a search by ticker.
SKIPPED_SITES = ("wikipedia.org", "linkedin.com", "facebook.com", "twitter.com", "x.com", "bloomberg.com", "reuters.com", "google.com")
# Words of a finance page, in a search by ticker.
FINANCE_WORDS = ("investor", "annual", "ir", "report")
# The same in a search by name.
NAME_SKIPPED_SITES = (
    "wikipedia.org", "linkedin.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "bloomberg.com", "reuters.com", "google.com", "crunchbase.com", "zaubacorp.com", "tofler.in", "ambitionbox.com", "glassdoor.com",
    "indeed.com", "moneycontrol.com", "economictimes.com", "livemint.com",
)
NAME_FINANCE_WORDS = ("investor", "annual", "report", "financial")
# Sites where documents are shared.
SHARING_SITES = ("scribd.com", "coursehero.", "studylib.", "academia.edu")
# Words that are no key word.
KEY_WORD_STOPS = ("the", "for", "and", "group", "bank", "holding", "properties", "company")


def country_of(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda c, w: c.when(any_of(low, w[1]), w[0]), COUNTRY_WORDS, F.when(F.lit(False), "")).otherwise("")


def likely_indian(name: Column, listed: Column) -> Column:
    return any_of(F.upper(name), INDIAN_NAMES) | listed


def leading_name(text: Column) -> Column:
    """The company that a text starts with: capitalised or not, words joined by blanks, 'and' or '&'; else its first longer word."""
    words = r"(?i)^([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*(?:\s+(?:And|&)\s+[A-Z][a-zA-Z]+)*(?:\s+(?:Co|Inc|Corp|Corporation|Ltd|LLC|Company|Group|Holdings))?)"
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.trim(F.regexp_extract(squeezed, words, 1))
    common = found.isin("The", "For", "Year", "Report", "Annual", "Quarterly")
    first = F.get(F.filter(F.split(F.trim(F.regexp_replace(squeezed, r"[^\w\s]", "")), r"\s+"), lambda w: F.length(w) > 1), F.lit(0))
    fallback = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1_000_000))
    return F.coalesce(F.when((found != "") & ~common, found), fallback, F.lit(""))


def key_word(name: Column) -> Column:
    """The first word of more than three letters that is not a common one, else the first word."""
    words = F.split(F.trim(F.lower(name)), r"\s+")
    stops = F.array(*[F.lit(w) for w in KEY_WORD_STOPS])
    return F.coalesce(F.get(F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(stops, w)), F.lit(0)), F.get(words, F.lit(0)))


def domain_matches(site: Column, name: Column) -> Column:
    """A word of the name, or its initials, in the host without dots and hyphens."""
    words = F.split(F.trim(F.lower(name)), r"\s+")
    ignored, short = F.array(*[F.lit(w) for w in DOMAIN_IGNORED]), F.array(*[F.lit(w) for w in ACRONYM_IGNORED])
    initials = F.array_join(F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(short, w)), lambda w: F.substring(w, 1, 1)), "")

    def matched(flat: Column) -> Column:
        named = F.exists(words, lambda w: (F.length(w) > 3) & ~F.array_contains(ignored, w) & F.contains(flat, w))
        return named | ((F.length(initials) >= 3) & F.contains(flat, initials))

    # As the element of an array the host is made once for all words.
    return F.get(F.transform(F.array(F.translate(F.lower(site), "-.", "")), matched), F.lit(0))


def plain_name(name: Column) -> Column:
    """The lower-case name without legal suffixes, wherever they stand."""
    out = F.trim(F.lower(name))
    for suffix in SUFFIXES:
        out = F.trim(F.replace(out, F.lit(suffix), F.lit("")))
    return out


def known_addresses(requests: DataFrame, patterns: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, ord, url``: the address patterns of the plain name, filled in for the year.

    ``patterns (known_name, ord, pattern)`` is joined by equality on the name.
    """
    y = lambda d: (F.col("year") + d).cast("string")
    values = {"{year}": y(0), "{nyear}": y(1), "{pyear}": y(-1), "{yy}": F.substring(y(0), 3, 2), "{nyy}": F.substring(y(1), 3, 2), "{pyy}": F.substring(y(-1), 3, 2)}
    joined = requests.withColumn("known_name", plain_name(F.col("name"))).join(patterns, "known_name")
    return joined.select(key, "ord", reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), values.items(), F.col("pattern")).alias("url"))


def description_match(requests: DataFrame, rows: DataFrame, *, key: str = "request_id") -> DataFrame:
    """A provider's first row whose description contains the name or lies within it, else its first row."""
    both = requests.select(key, F.lower("name").alias("asked")).join(rows, key)
    said = F.lower(F.coalesce("description", F.lit("")))
    good = (said != "") & (F.contains(said, F.col("asked")) | F.contains(F.col("asked"), said))
    return top_n(both.withColumn("matched", good), [key], [F.desc(good.cast("int")), F.asc("pos")]).drop("asked")


def by_alias(requests: DataFrame, sites: DataFrame, *, text: str, key: str = "request_id") -> DataFrame:
    """``key, site_id, step``: a site by an alias equal to the text (0), else contained either way (1), else by shared words (2).

    ``sites (site_id, aliases)``. A word of the text with more than two letters is shared if it contains a word of the alias
    or lies within one; two must be shared, or the only one. Ties go to the smallest site. Different texts, aliases and
    words are compared once, through an index of n-grams; shared words are looked up as pairs of an alias's words, of which the first site is
    known beforehand, so frequent words are not expanded. Empty texts and aliases match nothing.
    """
    keys = sites.select("site_id", F.explode("aliases").alias("alias")).groupBy(F.upper("alias").alias("alias")).agg(F.min("site_id").alias("site_id")).where("alias <> ''")
    rows = requests.select(key, F.upper(F.trim(text)).alias("text")).where("text <> ''")
    asked = rows.select("text").distinct()
    step = lambda hits, n: hits.select("text", "site_id", F.lit(n).alias("step"))
    equal = step(asked.join(keys, F.col("text") == F.col("alias")), 0)
    within = containing(keys.select(F.col("alias").alias("pattern")), asked).select("text", F.col("pattern").alias("alias"))
    around = containing(asked.select(F.col("text").alias("pattern")), keys.select(F.col("alias").alias("text"))).select(F.col("pattern").alias("text"), F.col("text").alias("alias"))
    part = step(within.unionByName(around).join(keys, "alias"), 1)
    words = asked.select("text", F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 2).alias("ws"))
    placed = words.select("text", F.size("ws").alias("m"), F.posexplode("ws").alias("at", "w"))
    own = keys.select("site_id", F.array_remove(F.array_distinct(F.split("alias", r"\s+")), "").alias("own"))
    names = lambda df, c, to: df.select(F.col(c).alias(to)).distinct()
    parts, ours = own.select(F.explode("own").alias("a")), placed.select("w")
    alike = containing(names(parts, "a", "pattern"), names(ours, "w", "text")).toDF("a", "w").unionByName(containing(names(ours, "w", "pattern"), names(parts, "a", "text")).toDF("w", "a")).distinct()
    matched = placed.join(alike, "w").select("text", "m", "at", "a")
    single = own.select("site_id", F.explode("own").alias("a")).groupBy("a").agg(F.min("site_id").alias("site_id"))
    only = matched.where("m = 1").join(single, "a").select("text", "site_id")
    # both words of a pair may be shared with the same word of the alias
    twice = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = own.select("site_id", F.explode(twice).alias("p")).groupBy("p.a", "p.b").agg(F.min("site_id").alias("site_id"))
    first, second = matched.toDF("text", "m", "i", "x"), matched.toDF("text", "m2", "j", "y")
    both = first.join(second, "text").where("i < j").select("text", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    shared = step(only.unionByName(both.join(pairs, ["a", "b"]).select("text", "site_id")), 2)
    best = equal.unionByName(part).unionByName(shared).groupBy("text").agg(F.min(F.struct("step", "site_id")).alias("b"))
    return rows.join(best, "text").select(key, "b.site_id", "b.step")


def own_site(requests: DataFrame, hits: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, ir_url``: from search hits in order, the first finance page's site, else the first matching site.

    Hits on news and social sites or on other companies' sites do not count. Document links give a site only as
    a fallback. ``hits (key, query_ord, pos, url, title)``.
    """
    both = hits.join(requests.select(key, "name"), key)
    site = bare_host(F.col("url"))
    usable = ~any_of(site, SKIPPED_SITES) & domain_matches(site, F.col("name"))
    file = F.lower("url").endswith(".pdf")
    finance = any_of(F.lower(F.concat_ws(" ", "url", "title")), FINANCE_WORDS)
    base = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    rank = F.when(~file & finance, 0).otherwise(1)
    return both.where(usable & (file | finance)).withColumn("class", rank).groupBy(key).agg(F.min_by(base, F.struct("class", "query_ord", "pos")).alias("ir_url"))


def named_site(requests: DataFrame, hits: DataFrame, *, key: str = "request_id") -> DataFrame:
    """``key, ir_url``: from search hits in order, the first finance page of the company's own site, else the first site with a hit.

    Aggregators, unwanted parts of a site, portals and other companies' sites do not count; a file only names its site. A page that is
    more than its site's start stands as it is. Without any hit, a company with a word of India or Turkey in its name has that
    country's filing site. ``hits (key, query_ord, pos, url, title, snippet)``.
    """
    both = hits.join(requests.select(key, "name"), key)
    site, low = bare_host(F.col("url")), F.lower("url")
    fault = page_fault(F.regexp_replace("url", r"(?i)\.(pdf|doc|docx|xls|xlsx|zip|rar)$", ""))
    usable = ~F.coalesce(fault.isin("aggregator", "section"), F.lit(False)) & ~any_of(site, NAME_SKIPPED_SITES) & domain_matches(site, F.col("name"))
    file = low.rlike(r"\.(pdf|doc|docx|xls|xlsx|zip)$")
    finance = ~file & any_of(F.lower(F.concat_ws(" ", "url", "title", "snippet")), NAME_FINANCE_WORDS)
    base = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)
    deep = F.trim(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*/*([^?#]*)", 1)) != ""
    picked = both.where(usable).withColumn("class", F.when(finance, 0).otherwise(1)).groupBy(key).agg(F.min_by(F.when(finance & deep, F.col("url")).otherwise(base), F.struct("class", "query_ord", "pos")).alias("found"))
    name = F.lower("name")
    usual = F.when(any_of(name, ("limited", " ltd", " ltd.")), "https://www.bseindia.com").when(any_of(name, ("a.ş.", "a.s.", "anonim")), "https://www.kap.org.tr")
    return requests.select(key, "name").join(picked, key, "left").select(key, F.coalesce("found", usual).alias("ir_url")).where("ir_url is not null")


def replaced_subsidiaries(entities: DataFrame, hits: DataFrame, tlds: DataFrame, *, key: str = "request_id") -> DataFrame:
    """Adds ``suspect`` and corrects ``ir_url``: a site under another country's domain gives way to a better hit.

    A .com site, one that speaks of investors, or one with the company's name or ticker in it is never suspect.
    ``tlds (country, tlds)``; ``hits (key, pos, url)`` are only read for suspects.
    """
    site = host(F.col("ir_url"))
    flat = F.translate(site, "-.", "")
    tick = F.lower(F.coalesce("ticker", F.lit("")))
    good = site.endswith(".com") | any_of(site, ("investor", "ir.", "relations")) | domain_matches(site, F.col("name")) | ((F.length(tick) >= 3) & F.contains(flat, tick))
    known = entities.join(tlds, "country", "left")
    wrong = F.col("tlds").isNotNull() & ~F.exists("tlds", lambda t: F.endswith(site, t))
    marked = known.withColumn("suspect", F.coalesce((F.col("ir_url") != "") & wrong & ~good, F.lit(False))).drop("tlds")
    asked = hits.join(marked.where("suspect").select(key, "name"), key).where(domain_matches(host(F.col("url")), F.col("name")))
    better = asked.groupBy(key).agg(F.min_by(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1), "pos").alias("better"))
    return marked.join(better, key, "left").withColumn("ir_url", F.coalesce("better", "ir_url")).drop("better")


def official_hits(hits: DataFrame, domains: DataFrame, *, name: str = "name") -> DataFrame:
    """PDF hits outside document-sharing sites, with ``official`` and ``confidence``.

    ``domains (company, domains)``: a company's own domains, by its name or a part of it in upper case. A company
    without known domains has every site as official. Different names are looked up once, in an index of n-grams.
    """
    site = F.replace(host(F.col("url")), F.lit("www."), F.lit(""))
    pdf = hits.where(F.lower("url").endswith(".pdf") & ~any_of(site, SHARING_SITES))
    found = containing(domains.select(F.col("company").alias("pattern")), pdf.select(F.upper(name).alias("text")))
    known = found.join(domains, F.col("pattern") == F.col("company")).groupBy("text").agg(F.flatten(F.collect_set("domains")).alias("own"))
    joined = pdf.withColumn("text", F.upper(name)).join(known, "text", "left").drop("text")
    official = F.col("own").isNull() | F.exists("own", lambda o: F.contains(site, o))
    return joined.withColumn("official", F.coalesce(official, F.lit(True))).withColumn("confidence", F.when(F.col("official"), 0.95).otherwise(0.70)).drop("own")


def uae_order(name: Column) -> Column:
    """The exchanges of the Emirates in the order to try them."""
    return F.when(any_of(F.lower(name), ABU_DHABI), F.array(F.lit("ADX"), F.lit("DFM"))).otherwise(F.array(F.lit("DFM"), F.lit("ADX")))


def listing_pick(links: DataFrame, *, key: str = "page_id", year: str = "year") -> DataFrame:
    """The first PDF or download link of a page that names the year, else the first PDF."""
    low = F.lower("href")
    pdf = F.contains(low, F.lit(".pdf"))
    named = (pdf | F.contains(low, F.lit("download"))) & (F.contains("href", F.col(year).cast("string")) | F.contains("text", F.col(year).cast("string")))
    rank = F.when(named, 0).when(pdf, 1)
    return top_n(links.withColumn("pass", rank).where("pass is not null"), [key], [F.asc("pass"), F.asc("pos")])


def resolved(requests: DataFrame, rows: DataFrame, exchanges: list[tuple[str, str]], countries: DataFrame, overrides: DataFrame, *, key: str = "request_id") -> DataFrame:
    """One entity per request: provider row, exchange code, country, and the ids of the company's listing.

    ``rows (key, pos, description, symbol, exchange)``. The country is the ticker's override, else the exchange's, else the
    name's; a numeric symbol on exchange IB is a scrip code, one on IN or NS an exchange symbol. '' means unknown.
    """
    best = description_match(requests, rows, key=key)
    mic = reduce(lambda c, e: c.when(F.contains(F.lower("exchange"), F.lit(e[0])), e[1]), exchanges, F.when(F.lit(False), "")).otherwise("")
    symbol, market = F.substring_index("symbol", ".", 1), F.when(F.contains("symbol", F.lit(".")), F.substring_index("symbol", ".", -1)).otherwise("")
    base = requests.select(key, "name").join(best.drop("name"), key, "left").withColumns({"exchange_mic": F.coalesce(mic, F.lit("")), "ticker": F.coalesce(symbol, F.lit("")), "market": F.coalesce(market, F.lit(""))})
    joined = base.join(countries, "exchange_mic", "left").join(overrides, "ticker", "left")
    country = F.coalesce("override", "mic_country", country_of(F.col("name")))
    return joined.select(
        key, "name", F.initcap(F.coalesce("description", F.lit(""))).alias("normalized_name"), country.alias("country"), "exchange_mic", "ticker",
        F.when((F.col("market") == "BO") & F.col("ticker").rlike(r"^\d+$"), F.col("ticker")).otherwise("").alias("scrip_code"), F.when(F.col("market").isin("IN", "NS"), F.col("ticker")).otherwise("").alias("exchange_symbol"),
        rq.acronym(F.col("name")).alias("acronym"))
