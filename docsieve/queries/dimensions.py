"""Registered queries of the rule tables of exchanges, countries and investor pages.

The tables name no exchange, so each company gets one entry of a rule table by its number; what is tested is that every
entry leads where it should.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import dimensions as dim
from docsieve.operators import markets, resolution
from docsieve.operators.entities import NAME_FINANCE_WORDS, NAME_SKIPPED_SITES, known_addresses, named_site
from docsieve.queries.core import HOST_SQL, m, query
from docsieve.queries.entities import COUNTRY_SQL, domain_sql
from docsieve.queries.fixtures import fixture

HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def case(rows, test: str, default: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(k=k)} THEN '{v}'" for k, v in rows) + f" ELSE {default} END"


def one_of(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


NAMED = [f"{part.title()} main board" for part, _ in dim.EXCHANGE_NAMES] + ["Unlisted"]
CODES = [c for c, _ in dim.CODE_COUNTRY] + ["QQ"]
TICKERS = [t for t, _ in dim.TICKER_COUNTRY] + ["ZZZ"] * 21


@query("r08_exchange_market", ("fx_company",), f"""
n AS (SELECT company_id, country, {texts(NAMED)}[company_id % {len(NAMED)} + 1] AS exchange FROM fx_company),
x AS (SELECT *, {case(dim.EXCHANGE_NAMES, "contains(upper(exchange), '{k}')")} AS named FROM n)
SELECT company_id, exchange, CASE WHEN named <> '' THEN named ELSE {case(dim.COUNTRY_MARKET, "country = '{k}'")} END AS market FROM x""")
def r08_market(spark, d):
    rows = fixture(spark, d, "fx_company").withColumn("exchange", one_of(NAMED, F.col("company_id")))
    return rows.select("company_id", "exchange", markets.market(F.col("exchange"), F.col("country")).alias("market"))


@query("r09_listing_country", ("fx_company",), f"""
n AS (SELECT company_id, country, {texts(CODES)}[company_id % {len(CODES)} + 1] AS code, {texts(TICKERS)}[company_id % {len(TICKERS)} + 1] AS symbol FROM fx_company)
SELECT company_id, CASE WHEN own <> '' THEN own WHEN listed <> '' THEN listed ELSE country END AS listing_country
FROM (SELECT *, {case(dim.TICKER_COUNTRY, "symbol = '{k}'")} AS own, {case(dim.CODE_COUNTRY, "code = '{k}'")} AS listed FROM n)""")
def r09_listing(spark, d):
    key = F.col("company_id")
    rows = fixture(spark, d, "fx_company")
    return rows.select(key, markets.country(one_of(TICKERS, key), one_of(CODES, key), F.col("country")).alias("listing_country"))


KEYS = [c for c, _, _ in dim.COUNTRY_EXCHANGES] + [k for k, _ in dim.SHARED_LISTINGS] + ["US/IN", "US/XX", "XX"]


@query("r12_country_exchanges", ("fx_company",), f"""
k AS (SELECT company_id, {texts(KEYS)}[company_id % {len(KEYS)} + 1] AS countries FROM fx_company),
s AS (SELECT company_id, countries, {case(dim.SHARED_LISTINGS, "countries = '{k}'", "NULL")} AS shared FROM k),
e AS (SELECT company_id, countries, unnest(string_split(shared, ',')) AS exchange FROM s WHERE shared IS NOT NULL
  UNION ALL SELECT company_id, countries, unnest(string_split(x, ',')) FROM (SELECT company_id, countries, {case([(c, e) for c, e, _ in dim.COUNTRY_EXCHANGES], "c = '{k}'", "NULL")} AS x FROM (SELECT company_id, countries, unnest(string_split(countries, '/')) AS c FROM s WHERE shared IS NULL)) WHERE x IS NOT NULL)
SELECT DISTINCT company_id, countries, exchange FROM e""")
def r12_exchanges(spark, d):
    rows = fixture(spark, d, "fx_company").withColumn("countries", one_of(KEYS, F.col("company_id")))
    return rows.select("company_id", "countries", F.explode(markets.exchanges(F.col("countries"))).alias("exchange"))


#: Hosts of every list, alone and behind www, with some that only look like them.
SITES = [
    *[f"{p}{s}" for p in ("www.", "") for s in (*dim.AGGREGATORS, *dim.EXCHANGE_SITES)], *[f"m.{s}" for s in dim.EXCHANGE_SITES], *[f"not{s}" for s in dim.EXCHANGE_SITES],
    *[f"{b}acme.com" for b in (*dim.REJECTED_BEGINNINGS, *dim.PREFERRED_BEGINNINGS)], "acme.com",
]
PATHS = ["/ir", "/a.PDF", "/b.docx", "/c.rar", "", "/d.pdf?x=1"]
FAULT = f"""CASE WHEN regexp_matches(lower(url), '\\.(pdf|doc|docx|xls|xlsx|zip|rar)$') THEN 'file'
  WHEN len(list_filter({texts(dim.AGGREGATORS)}, lambda a: contains(bare, a))) > 0 THEN 'aggregator'
  WHEN len(list_filter({texts(dim.EXCHANGE_SITES)}, lambda e: bare = e OR suffix(bare, '.' || e))) > 0 THEN 'exchange'
  WHEN len(list_filter({texts(dim.REJECTED_BEGINNINGS)}, lambda b: starts_with(site, b))) > 0 THEN 'section' END"""
ADDRESS = f"'https://' || {texts(SITES)}[request_id % {len(SITES)} + 1] || {texts(PATHS)}[request_id // 7 % {len(PATHS)} + 1]"


def address(key: Column) -> Column:
    return F.concat(F.lit("https://"), one_of(SITES, key), one_of(PATHS, F.floor(key / 7)))


@query("f10_investor_page_gate", ("fx_request",), f"""
u AS (SELECT request_id, {ADDRESS} AS url FROM fx_request), h AS (SELECT *, {HOST.format(u='url')} AS site, regexp_replace({HOST.format(u='url')}, '^[w.]+', '') AS bare FROM u)
SELECT request_id, url, {FAULT} AS fault, len(list_filter({texts(dim.PREFERRED_BEGINNINGS)}, lambda b: starts_with(site, b))) > 0 AS preferred FROM h""")
def f10_gate(spark, d):
    rows = fixture(spark, d, "fx_request").select("request_id", address(F.col("request_id")).alias("url"))
    return rows.select("request_id", "url", markets.page_fault(F.col("url")).alias("fault"), markets.page_preferred(F.col("url")).alias("preferred"))


COMPANIES = [f" {k.title()} Group" for k, _ in dim.KNOWN_PAGES] + ["Unknown works"] * 9


@query("r11_investor_page", ("fx_request",), f"""
u AS (SELECT request_id, year, {texts(COMPANIES)}[request_id % {len(COMPANIES)} + 1] AS company, {ADDRESS} AS url FROM fx_request),
h AS (SELECT *, {HOST.format(u='url')} AS site, regexp_replace({HOST.format(u='url')}, '^[w.]+', '') AS bare, replace({case(dim.KNOWN_PAGES, "contains(lower(trim(company)), '{k}')")}, '{{year}}', year::VARCHAR) AS known FROM u)
SELECT request_id, company, CASE WHEN known <> '' THEN known WHEN coalesce({FAULT}, 'section') = 'section' THEN url ELSE '' END AS page FROM h""")
def r11(spark, d):
    key = F.col("request_id")
    rows = fixture(spark, d, "fx_request").select(key, "year", one_of(COMPANIES, key).alias("company"), address(key).alias("url"))
    return rows.select("request_id", "company", markets.investor_page(F.col("company"), F.col("year"), F.col("url")).alias("page"))


@query("s08_market_dimension", ("fx_company",), f"""
k AS (SELECT company_id, country FROM fx_company), s AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{e}', '{s}')" for c, e, s in dim.COUNTRY_EXCHANGES)}) AS t(country, exchanges, sites))
SELECT company_id, country, string_split(exchanges, ',')[i] AS exchange, string_split(sites, ',')[i] AS site FROM k JOIN s USING (country), unnest(range(1, len(string_split(sites, ',')) + 1)) AS u(i)""")
def s08_markets(spark, d):
    """The rule table of a country's exchanges and their sites, joined to the companies."""
    table = spark.createDataFrame(dim.COUNTRY_EXCHANGES, "country string, exchanges string, sites string")
    pairs = F.explode(F.arrays_zip(F.split("exchanges", ",").alias("exchange"), F.split("sites", ",").alias("site"))).alias("p")
    single = table.select("country", pairs).select("country", "p.exchange", "p.site")
    return fixture(spark, d, "fx_company").select("company_id", "country").join(F.broadcast(single), "country").select("company_id", "country", "exchange", "site")


#: Partial answers of a register, a symbol search, profiles and site searches, by the number of the request or company.
REGISTERED = f"""
reg AS (SELECT request_id, {texts([*CODES, ''])}[request_id % {len(CODES) + 1} + 1] AS code, CASE WHEN request_id % 4 = 0 THEN (500000 + company_id)::VARCHAR WHEN request_id % 9 = 0 THEN 'SABIC' ELSE ticker END AS ticker, 'X' || request_id AS isin, CASE WHEN request_id % 5 = 0 THEN '' ELSE upper(name) END AS listed_name FROM fx_request WHERE request_id % 3 <> 0),
mat AS (SELECT request_id, {texts(NAMED)}[request_id % {len(NAMED)} + 1] AS exchange, ticker AS symbol, name || ' found' AS description FROM fx_request WHERE request_id % 2 = 0),
pro AS (SELECT ticker, CASE WHEN company_id % 5 = 0 THEN '' ELSE country END AS profile_country, CASE WHEN company_id % 4 = 0 THEN '' ELSE {ADDRESS.replace('request_id', 'company_id')} END AS website FROM fx_company WHERE company_id % 3 = 1),
st AS (SELECT request_id, {ADDRESS.replace('request_id', '(request_id + 1)')} AS url FROM fx_request WHERE request_id % 5 < 2), sn AS (SELECT request_id, {ADDRESS.replace('request_id', '(request_id + 2)')} AS url FROM fx_request WHERE request_id % 7 < 3), sc AS (SELECT request_id, 'https://country.example' AS url FROM fx_request WHERE request_id % 2 = 0)"""


def bad_sql(url: str) -> str:
    fault = FAULT.replace("suffix(bare", "suffix(\x01").replace("contains(bare", "contains(\x01").replace("bare = e", "\x01 = e").replace("(site,", "(\x02,")
    return "coalesce(" + fault.replace("(url)", f"({url})").replace("\x01", f"regexp_replace({HOST.format(u=url)}, '^[w.]+', '')").replace("\x02", HOST.format(u=url)) + ", 'section') <> 'section'"


@query("r10_resolved_entities", ("fx_request",), REGISTERED + f""",
a AS (SELECT q.request_id, q.name, q.year, nullif(reg.code, '') AS code, reg.ticker AS listed_ticker, reg.isin, CASE WHEN reg.request_id IS NOT NULL THEN trim(coalesce(nullif(reg.listed_name, ''), q.name)) END AS listed_name, mat.exchange, mat.symbol, mat.description, mat.request_id IS NOT NULL AND nullif(reg.code, '') IS NULL AS searched
  FROM (SELECT request_id, {texts(COMPANIES)}[request_id % {len(COMPANIES) * 2} + 1] AS known_name, coalesce(known_name, name) AS name, year FROM fx_request) q LEFT JOIN reg USING (request_id) LEFT JOIN mat USING (request_id)),
b AS (SELECT *, coalesce(listed_ticker, CASE WHEN searched THEN symbol END) AS ticker, coalesce(listed_name, CASE WHEN searched THEN description END) AS normalized, CASE WHEN searched THEN {case(dim.EXCHANGE_NAMES, "contains(upper(exchange), '{k}')")} END AS found_mic FROM a),
c AS (SELECT b.*, pro.website, {case(dim.TICKER_COUNTRY, "upper(b.ticker) = '{k}'", "NULL")} AS c0, nullif(profile_country, '') AS c1, {case(dim.CODE_COUNTRY, "code = '{k}'", "NULL")} AS c2, nullif({COUNTRY_SQL}, '') AS c3 FROM b LEFT JOIN pro USING (ticker)),
d AS (SELECT *, coalesce(c0, c1, c2, c3) AS land, CASE WHEN c0 IS NOT NULL THEN 'override' WHEN c1 IS NOT NULL THEN 'profile' WHEN c2 IS NOT NULL THEN 'exchange code' WHEN c3 IS NOT NULL THEN 'name' ELSE '' END AS country_source FROM c),
e AS (SELECT *, coalesce({case(dim.COUNTRY_MARKET, "land = '{k}'")}, '') AS usual, replace({case(dim.KNOWN_PAGES, "contains(lower(trim(name)), '{k}')")}, '{{year}}', year::VARCHAR) AS known, ticker IS NOT NULL AND NOT regexp_matches(ticker, '^[0-9]+$') AS words FROM d),
f AS (SELECT e.*, st.url AS u0, sn.url AS u1, sc.url AS u2, CASE WHEN known <> '' THEN 'known' WHEN website <> '' THEN 'profile' WHEN words AND st.url IS NOT NULL THEN 'found by ticker' WHEN sn.url IS NOT NULL THEN 'found by name' WHEN land IS NOT NULL AND sc.url IS NOT NULL THEN 'found by country' ELSE '' END AS how
  FROM e LEFT JOIN st USING (request_id) LEFT JOIN sn USING (request_id) LEFT JOIN sc USING (request_id)),
g AS (SELECT *, CASE how WHEN 'known' THEN known WHEN 'profile' THEN website WHEN 'found by ticker' THEN u0 WHEN 'found by name' THEN u1 WHEN 'found by country' THEN u2 ELSE '' END AS page FROM f),
h AS (SELECT *, page <> '' AND {bad_sql('page')} AS bad, words AND u0 IS NOT NULL AND NOT {bad_sql('u0')} AS good0, u1 IS NOT NULL AND NOT {bad_sql('u1')} AS good1 FROM g)
SELECT request_id, coalesce(normalized, '') AS normalized_name, coalesce(land, '') AS country, country_source, coalesce(code, nullif(found_mic, ''), usual) AS exchange_mic, CASE WHEN code IS NOT NULL THEN 'register' WHEN found_mic <> '' THEN 'search' WHEN usual <> '' THEN 'country' ELSE '' END AS mic_source,
  coalesce(ticker, '') AS ticker, coalesce(isin, '') AS isin, CASE WHEN NOT bad THEN page WHEN good0 THEN u0 WHEN good1 THEN u1 ELSE '' END AS ir_url, CASE WHEN NOT bad THEN how WHEN good0 THEN 'found by ticker' WHEN good1 THEN 'found by name' ELSE '' END AS ir_source,
  CASE WHEN code = 'IB' AND regexp_matches(listed_ticker, '^[0-9]+$') THEN listed_ticker ELSE '' END AS bse_scripcode, CASE WHEN code IN ('IN', 'NS') AND NOT regexp_matches(listed_ticker, '^[0-9]+$') THEN listed_ticker ELSE '' END AS nse_symbol FROM h""")
def r10_resolved(spark, d):
    """Every request resolved from all sources at once, by the whole rule tables."""
    k, asked = F.col("request_id"), fixture(spark, d, "fx_request")
    company = F.col("company_id")
    names = F.try_element_at(F.array(*[F.lit(c) for c in COMPANIES]), (k % (len(COMPANIES) * 2) + 1).cast("int"))
    requests = asked.select(k, F.coalesce(names, "name").alias("name"), "year")
    ticker = F.when(k % 4 == 0, (500000 + company).cast("string")).when(k % 9 == 0, "SABIC").otherwise(F.col("ticker"))
    listings = asked.where(k % 3 != 0).select(k, one_of([*CODES, ""], k).alias("code"), ticker.alias("ticker"), F.concat(F.lit("X"), k.cast("string")).alias("isin"), F.when(k % 5 == 0, "").otherwise(F.upper("name")).alias("listed_name"))
    # a name that the register lacks is the request's own
    matches = asked.where(k % 2 == 0).select(k, one_of(NAMED, k).alias("exchange"), F.col("ticker").alias("symbol"), F.concat("name", F.lit(" found")).alias("description"))
    profiles = fixture(spark, d, "fx_company").where(company % 3 == 1).select("ticker", F.when(company % 5 == 0, "").otherwise(F.col("country")).alias("profile_country"), F.when(company % 4 == 0, "").otherwise(address(company)).alias("website"))
    site = lambda rows, how, url: rows.select(k, F.lit(how).alias("found_by"), url.alias("url"))
    sites = site(asked.where(k % 5 < 2), "ticker", address(k + 1)).unionByName(site(asked.where(k % 7 < 3), "name", address(k + 2))).unionByName(site(asked.where(k % 2 == 0), "country", F.lit("https://country.example")))
    return resolution.resolve(requests, listings, matches, profiles, sites)


LANDS = [c for c, _ in dim.COUNTRY_LANGUAGES] + ["XX"]


@query("r12_languages", ("fx_company",), f"""
k AS (SELECT company_id, {texts(LANDS)}[company_id % {len(LANDS)} + 1] AS land FROM fx_company), l AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, x in dim.COUNTRY_LANGUAGES)}) AS t(land, languages))
SELECT company_id, land, unnest(string_split(languages, ',')) AS language FROM k JOIN l USING (land)""")
def r12_languages(spark, d):
    """The languages of every company's country, by the whole rule table."""
    k = F.col("company_id")
    rows = fixture(spark, d, "fx_company").select(k, one_of(LANDS, k).alias("land"))
    return rows.select(k, "land", F.explode(F.split(markets.looked_up(dim.COUNTRY_LANGUAGES, F.col("land")), ",")).alias("language"))


TLD_LANDS = [c for c, _ in dim.COUNTRY_DOMAINS] + ["XX"]
ENDINGS = ["com", *[t[1:] for _, ts in dim.COUNTRY_DOMAINS for t in ts.split(",")]]


@query("s08_country_domains", ("fx_request",), f"""
k AS (SELECT request_id, {texts(TLD_LANDS)}[request_id % {len(TLD_LANDS)} + 1] AS land, 'https://x.' || {texts(ENDINGS)}[request_id % {len(ENDINGS)} + 1] || '/a' AS url FROM fx_request),
d AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, x in dim.COUNTRY_DOMAINS)}) AS t(land, endings))
SELECT request_id, land, url, CASE WHEN endings IS NULL THEN NULL ELSE len(list_filter(string_split(endings, ','), lambda e: suffix(regexp_extract(url, '^https://([^/]*)', 1), e))) > 0 END AS own FROM k LEFT JOIN d USING (land)""")
def s08_domains(spark, d):
    """Whether a site ends as those of the company's country do; null where no ending is known."""
    k = F.col("request_id")
    rows = fixture(spark, d, "fx_request").select(k, one_of(TLD_LANDS, k).alias("land"), F.concat(F.lit("https://x."), one_of(ENDINGS, k), F.lit("/a")).alias("url"))
    return rows.withColumn("own", markets.own_ending(F.col("url"), F.col("land")))


_DOCUMENTS = ", ".join(f"('{n}', {o}, '{p}')" for n, o, p in dim.KNOWN_DOCUMENTS)
KNOWN_NAMES = [f"{n.title()}{s}" for n in dict.fromkeys(n for n, *_ in dim.KNOWN_DOCUMENTS) for s in ("", " Limited", " Ltd Inc")] + ["Infosys Works"]


@query("p13_known_documents", ("fx_request",), f"""
n AS (SELECT request_id, year, {texts(KNOWN_NAMES)}[request_id % {len(KNOWN_NAMES)} + 1] AS name FROM fx_request),
plain AS (SELECT request_id, year, trim(replace(trim(replace(trim(replace(trim(replace(trim(replace(lower(name), ' limited', '')), ' ltd', '')), ' inc', '')), ' plc', '')), ' corp', '')) AS known FROM n),
patterns AS (SELECT * FROM (VALUES {_DOCUMENTS}) AS t(known, ord, pattern))
SELECT request_id, ord, replace(replace(replace(pattern, '{{year}}', year::VARCHAR), '{{pyear}}', (year - 1)::VARCHAR), '{{yy}}', substr(year::VARCHAR, 3, 2)) AS url FROM plain JOIN patterns USING (known)""")
def p13_documents(spark, d):
    """The addresses of known companies' reports, by the whole rule table."""
    k = F.col("request_id")
    rows = fixture(spark, d, "fx_request").select(k, "year", one_of(KNOWN_NAMES, k).alias("name"))
    return known_addresses(rows, spark.createDataFrame(dim.KNOWN_DOCUMENTS, "known_name string, ord int, pattern string"))


@query("f11_named_site", ("fx_candidate",), f"""
h AS (SELECT request_id, pos, name, CASE pos % 7 WHEN 0 THEN 'https://www.' || {texts(NAME_SKIPPED_SITES)}[request_id % {len(NAME_SKIPPED_SITES)} + 1] || '/investor' WHEN 1 THEN 'https://shop.' || replace(lower(name), ' ', '') || '.com/annual' WHEN 2 THEN 'https://' || replace(lower(name), ' ', '') || '.org' ELSE url END AS url, link_text AS title FROM fx_candidate),
s AS (SELECT *, {HOST.format(u='url')} AS site, regexp_replace({HOST.format(u='url')}, '^[w.]+', '') AS bare, {HOST_SQL.format(u='url')} AS plain FROM h),
u AS (SELECT *, regexp_matches(lower(url), '\\.(pdf|doc|docx|xls|xlsx|zip)$') AS file, CASE WHEN len{FAULT.split("WHEN len", 1)[1]} AS fault FROM s),
g AS (SELECT *, NOT file AND {m("lower(url || ' ' || title)", NAME_FINANCE_WORDS)} AS finance, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS base FROM u WHERE coalesce(fault, 'exchange') = 'exchange' AND NOT {m('plain', NAME_SKIPPED_SITES)} AND {domain_sql('plain')}),
p AS (SELECT request_id, CASE WHEN finance AND length(replace(substr(url, length(base) + 1), '/', '')) > 0 THEN url ELSE base END AS found FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY NOT finance, pos) = 1)
SELECT request_id, coalesce(found, CASE WHEN {m('lower(name)', ('limited', ' ltd', ' ltd.'))} THEN 'https://www.bseindia.com' WHEN {m('lower(name)', ('a.ş.', 'a.s.', 'anonim'))} THEN 'https://www.kap.org.tr' END) AS ir_url FROM (SELECT DISTINCT request_id, name FROM fx_candidate) LEFT JOIN p USING (request_id) WHERE ir_url IS NOT NULL""")
def f11_named(spark, d):
    hits = fixture(spark, d, "fx_candidate")
    k, pos, flat = F.col("request_id"), F.col("pos"), F.replace(F.lower("name"), F.lit(" "), F.lit(""))
    url = F.when(pos % 7 == 0, F.concat(F.lit("https://www."), one_of(NAME_SKIPPED_SITES, k), F.lit("/investor"))).when(pos % 7 == 1, F.concat(F.lit("https://shop."), flat, F.lit(".com/annual"))).when(pos % 7 == 2, F.concat(F.lit("https://"), flat, F.lit(".org"))).otherwise(F.col("url"))
    rows = hits.select(k, F.lit(0).alias("query_ord"), pos, url.alias("url"), F.col("link_text").alias("title"), F.lit(None).cast("string").alias("snippet"))
    return named_site(hits.select(k, "name").distinct(), rows)
