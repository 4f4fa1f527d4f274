"""Registered queries of entity resolution and the remaining gates, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import rules, scoring
from docsieve.functions.text import any_of, bare_host
from docsieve.operators import entities as ent
from docsieve.operators import links, ranking
from docsieve.queries.core import ANCHORS, HOST_SQL, LINK, PREPARED, RANKED, m, query, ranked, says_year_sql
from docsieve.queries.fixtures import fixture


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


COUNTRY_SQL = "CASE " + " ".join(f"WHEN {m('lower(name)', w)} THEN '{c}'" for c, w in ent.COUNTRY_WORDS) + " ELSE '' END"


@query("p06_leading_name", ("fx_request",), """
q AS (SELECT request_id, trim(regexp_replace(raw_query, '\\s+', ' ', 'g')) AS t FROM fx_request),
f AS (SELECT *, trim(regexp_extract(t, '^([a-zA-Z][a-zA-Z]+(?:\\s+[a-zA-Z][a-zA-Z]+)*(?:\\s+(?:[aA][nN][dD]|&)\\s+[a-zA-Z][a-zA-Z]+)*)', 1)) AS found, list_filter(string_split(trim(regexp_replace(t, '[^\\w\\s]', '', 'g')), ' '), lambda w: length(w) > 1)[1] AS one FROM q)
SELECT request_id, CASE WHEN found <> '' AND found NOT IN ('The', 'For', 'Year', 'Report', 'Annual', 'Quarterly') THEN found ELSE coalesce(upper(one[1]) || one[2:], '') END AS company FROM f""")
def p06(spark, d):
    return fixture(spark, d, "fx_request").select("request_id", ent.leading_name(F.col("raw_query")).alias("company"))


@query("p09_country_of_name", ("fx_company",), f"SELECT company_id, {COUNTRY_SQL} AS guess FROM fx_company")
def p09(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", ent.country_of(F.col("name")).alias("guess"))


@query("p13_known_addresses", ("fx_request",), """
plain AS (SELECT request_id, year, trim(replace(replace(replace(replace(replace(lower(name), ' limited', ''), ' ltd', ''), ' inc', ''), ' plc', ''), ' corp', '')) AS known FROM fx_request),
patterns AS (SELECT DISTINCT p_name AS known, 1 AS ord, 'https://a.com/' || replace(p_name, ' ', '-') || '-{year}-{nyy}.pdf' AS pattern FROM part UNION SELECT DISTINCT p_name, 2, 'https://a.com/{pyear}/{pyy}-{yy}-{nyear}.pdf' FROM part)
SELECT request_id, ord, replace(replace(replace(replace(replace(replace(pattern, '{year}', year::VARCHAR), '{nyear}', (year + 1)::VARCHAR), '{pyear}', (year - 1)::VARCHAR), '{yy}', substr(year::VARCHAR, 3, 2)), '{nyy}', substr((year + 1)::VARCHAR, 3, 2)), '{pyy}', substr((year - 1)::VARCHAR, 3, 2)) AS url
FROM plain JOIN patterns USING (known)""")
def p13(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("known_name")).distinct()
    one = names.select("known_name", F.lit(1).alias("ord"), F.concat(F.lit("https://a.com/"), F.replace("known_name", F.lit(" "), F.lit("-")), F.lit("-{year}-{nyy}.pdf")).alias("pattern"))
    two = names.select("known_name", F.lit(2).alias("ord"), F.lit("https://a.com/{pyear}/{pyy}-{yy}-{nyear}.pdf").alias("pattern"))
    return ent.known_addresses(fixture(spark, d, "fx_request"), one.unionByName(two))


@query("r03_description_match", ("fx_candidate",), """
r AS (SELECT c.request_id, pos, q.name AS asked, CASE WHEN pos % 3 = 0 THEN upper(q.name) || ' HOLDING' WHEN pos % 3 = 1 THEN '' ELSE source END AS description FROM fx_candidate c JOIN fx_request q USING (request_id)),
g AS (SELECT *, description <> '' AND (contains(lower(description), lower(asked)) OR contains(lower(asked), lower(description))) AS matched FROM r)
SELECT request_id, pos, matched FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY matched DESC, pos) = 1""")
def r03(spark, d):
    rows = fixture(spark, d, "fx_candidate")
    rows = rows.select("request_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat(F.upper("name"), F.lit(" HOLDING"))).when(F.col("pos") % 3 == 1, "").otherwise(F.col("source")).alias("description"))
    return ent.description_match(fixture(spark, d, "fx_request"), rows).select("request_id", "pos", "matched")


@query("r05_alias_match", ("fx_request",), """
asked AS (SELECT DISTINCT name AS q FROM fx_request), a AS (SELECT q, upper(trim(q)) AS t, list_filter(string_split(upper(trim(q)), ' '), lambda w: length(w) > 2) AS w FROM asked),
k AS (SELECT site_id, upper(alias) AS alias, row_number() OVER (PARTITION BY site_id) AS alias_pos FROM (SELECT min(p_partkey) AS site_id, unnest([p_name, split_part(p_name, ' ', 1) || ' group works']) AS alias FROM part GROUP BY p_name)),
h AS (SELECT q, site_id, CASE WHEN t = alias THEN 0 WHEN contains(t, alias) OR contains(alias, t) THEN 1 ELSE
  CASE WHEN s >= 2 OR (s >= 1 AND len(w) = 1) THEN 2 END END AS step FROM (SELECT *, len(list_filter(w, lambda x: len(list_filter(string_split(alias, ' '), lambda b: contains(x, b) OR contains(b, x))) > 0)) AS s FROM a CROSS JOIN k))
SELECT q, site_id, step FROM h WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY step, site_id) = 1""")
def r05(spark, d):
    sites = spark.read.parquet(f"{d}/part.parquet").groupBy("p_name").agg(F.min("p_partkey").alias("site_id"))
    sites = sites.select("site_id", F.array(F.col("p_name"), F.concat(F.substring_index("p_name", " ", 1), F.lit(" group works"))).alias("aliases"))
    return ent.by_alias(fixture(spark, d, "fx_request").select(F.col("name").alias("q")).distinct(), sites, text="q", key="q")


@query("r06_likely_indian", ("fx_company",), f"SELECT company_id, {m('upper(name)', ent.INDIAN_NAMES)} OR country = 'IN' AS indian FROM fx_company")
def r06(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", ent.likely_indian(F.col("name"), F.col("country") == "IN").alias("indian"))


EXCHANGES = [("national", "XNSE"), ("bombay", "XBOM"), ("new york", "XNYS")]
MARKETS = "CASE company_id % 4 WHEN 0 THEN 'National Exchange' WHEN 1 THEN 'Bombay Exchange' WHEN 2 THEN 'New York' ELSE 'Unlisted' END"
SYMBOLS = "CASE company_id % 4 WHEN 0 THEN ticker || '.NS' WHEN 1 THEN (500000 + company_id)::VARCHAR || '.BO' WHEN 2 THEN ticker ELSE '' END"


@query("r10_r11_entities", ("fx_company",), f"""
c AS (SELECT *, {MARKETS} AS exchange, {SYMBOLS} AS symbol FROM fx_company),
e AS (SELECT *, CASE WHEN contains(lower(exchange), 'national') THEN 'XNSE' WHEN contains(lower(exchange), 'bombay') THEN 'XBOM' WHEN contains(lower(exchange), 'new york') THEN 'XNYS' ELSE '' END AS mic, split_part(symbol, '.', 1) AS tick, CASE WHEN contains(symbol, '.') THEN split_part(symbol, '.', 2) ELSE '' END AS market FROM c)
SELECT company_id, mic AS exchange_mic, tick AS ticker, CASE WHEN tick = 'CC' THEN 'ZZ' WHEN mic IN ('XNSE', 'XBOM') THEN 'IN' WHEN mic = 'XNYS' THEN 'US' ELSE {COUNTRY_SQL} END AS country,
  CASE WHEN market = 'BO' THEN tick ELSE '' END AS scrip_code, CASE WHEN market = 'NS' THEN tick ELSE '' END AS exchange_symbol FROM e""")
def r10(spark, d):
    k = F.col("company_id")
    companies = fixture(spark, d, "fx_company")
    exchange = F.when(k % 4 == 0, "National Exchange").when(k % 4 == 1, "Bombay Exchange").when(k % 4 == 2, "New York").otherwise("Unlisted")
    symbol = F.when(k % 4 == 0, F.concat("ticker", F.lit(".NS"))).when(k % 4 == 1, F.concat((500000 + k).cast("string"), F.lit(".BO"))).when(k % 4 == 2, F.col("ticker")).otherwise("")
    rows = companies.select(k, F.lit(0).alias("pos"), F.col("name").alias("description"), symbol.alias("symbol"), exchange.alias("exchange"))
    countries = spark.createDataFrame([("XNSE", "IN"), ("XBOM", "IN"), ("XNYS", "US")], "exchange_mic string, mic_country string")
    overrides = spark.createDataFrame([("CC", "ZZ")], "ticker string, override string")
    return ent.resolved(companies, rows, EXCHANGES, countries, overrides, key="company_id").select("company_id", "exchange_mic", "ticker", "country", "scrip_code", "exchange_symbol")


DOMAIN_SQL = """(len(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 AND NOT list_contains({ignored}, w) AND contains({flat}, w))) > 0 OR
  (length({initials}) >= 3 AND contains({flat}, {initials})))"""
INITIALS = f"array_to_string(list_transform(list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 4 AND NOT list_contains({listed(ent.ACRONYM_IGNORED)}, w)), lambda w: substr(w, 1, 1)), '')"


def domain_sql(site: str) -> str:
    return DOMAIN_SQL.format(ignored=listed(ent.DOMAIN_IGNORED), flat=f"replace(replace({site}, '.', ''), '-', '')", initials=INITIALS)


@query("r18_f11_own_site", ("fx_candidate",), f"""
h AS (SELECT request_id, pos, name, CASE WHEN pos % 5 = 0 THEN 'https://www.linkedin.com/investor' ELSE url END AS url, link_text AS title FROM fx_candidate),
u AS (SELECT *, {HOST_SQL.format(u='url')} AS site, suffix(lower(url), '.pdf') AS file, {m("lower(url || ' ' || title)", ent.FINANCE_WORDS)} AS finance FROM h)
SELECT request_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS ir_url FROM u WHERE NOT {m('site', ent.SKIPPED_SITES)} AND {domain_sql('site')} AND (file OR finance)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY file OR NOT finance, pos) = 1""")
def r18(spark, d):
    hits = fixture(spark, d, "fx_candidate").select("request_id", F.lit(0).alias("query_ord"), "pos", F.when(F.col("pos") % 5 == 0, "https://www.linkedin.com/investor").otherwise(F.col("url")).alias("url"), F.col("link_text").alias("title"))
    return ent.own_site(fixture(spark, d, "fx_request"), hits)


@query("r19_subsidiaries", ("fx_request",), f"""
e AS (SELECT request_id, name, ticker, country, CASE request_id % 3 WHEN 0 THEN 'https://www.' || host WHEN 1 THEN 'https://other.de/ir' ELSE 'https://any.in' END AS ir_url FROM fx_request),
t AS (SELECT * FROM (VALUES ('IN', ['.in', '.co.in']), ('GB', ['.uk'])) AS t(country, tlds)),
s AS (SELECT request_id, name, e.ir_url, lower(regexp_extract(e.ir_url, '^[a-z]+://([^/]*)', 1)) AS site, ticker, tlds FROM e LEFT JOIN t USING (country)),
x AS (SELECT *, tlds IS NOT NULL AND len(list_filter(tlds, lambda y: suffix(site, y))) = 0 AND NOT (suffix(site, '.com') OR {m('site', ('investor', 'ir.', 'relations'))} OR {domain_sql('site')} OR (length(ticker) >= 3 AND contains(replace(site, '.', ''), lower(ticker)))) AS suspect FROM s)
SELECT request_id, suspect, CASE WHEN suspect AND {domain_sql("'good' || replace(lower(name), ' ', '') || 'in'")} THEN 'https://good.' || replace(lower(name), ' ', '') || '.in' ELSE ir_url END AS ir_url FROM x""")
def r19(spark, d):
    k = F.col("request_id")
    asked = fixture(spark, d, "fx_request")
    sites = asked.select(k, "name", "ticker", "country", F.when(k % 3 == 0, F.concat(F.lit("https://www."), "host")).when(k % 3 == 1, "https://other.de/ir").otherwise("https://any.in").alias("ir_url"))
    tlds = spark.createDataFrame([("IN", [".in", ".co.in"]), ("GB", [".uk"])], "country string, tlds array<string>")
    hits = asked.select(k, F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("https://else.org/").alias("url")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit("https://good."), F.replace(F.lower("name"), F.lit(" "), F.lit("")), F.lit(".in/x")).alias("url")))).alias("h")).select(k, "h.pos", "h.url")
    return ent.replaced_subsidiaries(sites, hits, tlds).select("request_id", "suspect", "ir_url")


@query("r21_f13_official_hits", ("fx_candidate",), """
n AS (SELECT DISTINCT name FROM fx_candidate), d AS (SELECT * FROM (VALUES ('RING', ['ring', 'ir.']), ('BANK', ['bank']), ('WIDGET PLC', ['nowhere.com'])) AS t(company, domains)),
k AS (SELECT name, flatten(list(domains)) AS own FROM n JOIN d ON contains(upper(name), company) GROUP BY name)
SELECT request_id, pos, own IS NULL OR len(list_filter(own, lambda o: contains(replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), 'www.', ''), o))) > 0 AS official FROM fx_candidate LEFT JOIN k USING (name) WHERE suffix(lower(url), '.pdf')""")
def r21(spark, d):
    domains = spark.createDataFrame([("RING", ["ring", "ir."]), ("BANK", ["bank"]), ("WIDGET PLC", ["nowhere.com"])], "company string, domains array<string>")
    return ent.official_hits(fixture(spark, d, "fx_candidate"), domains).select("request_id", "pos", "official")


@query("r15_uae_order", ("fx_company",), f"SELECT company_id, CASE WHEN {m('lower(n)', ent.ABU_DHABI)} THEN 'ADX,DFM' ELSE 'DFM,ADX' END AS tried FROM (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN 'Etihad ' ELSE '' END || name AS n FROM fx_company)")
def r15(spark, d):
    name = F.concat(F.when(F.col("company_id") % 3 == 0, "Etihad ").otherwise(""), "name")
    return fixture(spark, d, "fx_company").select("company_id", F.array_join(ent.uae_order(name), ",").alias("tried"))


@query("f23_required_word", ("fx_candidate",), f"""
k AS (SELECT *, coalesce(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 AND NOT list_contains({listed(ent.KEY_WORD_STOPS)}, w))[1], split_part(lower(name), ' ', 1)) AS word FROM fx_candidate)
SELECT request_id, pos, word FROM k WHERE contains(lower(url || ' ' || link_text), word)""")
def f23(spark, d):
    df = fixture(spark, d, "fx_candidate").withColumn("word", ent.key_word(F.col("name")))
    return df.where(F.contains(F.lower(F.concat_ws(" ", "url", "link_text")), F.col("word"))).select("request_id", "pos", "word")


@query("f12_third_party", ("fx_candidate",), f"""
u AS (SELECT request_id, pos, CASE pos % 4 WHEN 0 THEN 'https://www.msci.com/esg/x.pdf' WHEN 1 THEN 'https://shareaction.org/a' WHEN 2 THEN 'https://www.msci.com/a' ELSE url END AS url FROM fx_candidate)
SELECT request_id, pos, {m('lower(url)', rules.THIRD_PARTY_HOSTS)} OR regexp_matches(lower(url), '(msci\\.com|spglobal\\.com)/esg') AS third_party FROM u""")
def f12(spark, d):
    p = F.col("pos") % 4
    url = F.when(p == 0, "https://www.msci.com/esg/x.pdf").when(p == 1, "https://shareaction.org/a").when(p == 2, "https://www.msci.com/a").otherwise(F.col("url"))
    low, site = F.lower(url), bare_host(url)
    by_path = [(site.endswith(h)) & F.regexp_extract(low, r"^[a-z]+://[^/]*(/.*)?$", 1).startswith(p_) for h, p_ in rules.THIRD_PARTY_PATHS]
    return fixture(spark, d, "fx_candidate").select("request_id", "pos", (any_of(site, rules.THIRD_PARTY_HOSTS) | by_path[0] | by_path[1]).alias("third_party"))


@query("f20_opaque_winner", ("fx_candidate", "fx_status"), RANKED + f""",
best AS (SELECT * FROM ranked WHERE source = 'web' AND score >= 0.65 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) = 1)
SELECT request_id, url FROM best WHERE name_points > 0 OR {m('l', rules.ANNUAL)} OR source_points > 0""")
def f20(spark, d):
    best = ranking.top_n(ranked(spark, d).where("source = 'web' and score >= 0.65"), ["request_id"], [F.desc("score"), F.asc("pos")])
    # The gate comes after the choice: a request whose winner says nothing has no result.
    return best.where((F.col("name_points") > 0) | any_of(F.lower("url"), rules.ANNUAL) | (F.col("source_points") > 0)).select("request_id", "url")


@query("l06_listing_pick", (), ANCHORS + """,
y AS (SELECT page_id, pos, href, text, CASE WHEN contains(lower(href || '.pdf'), '.pdf') AND (contains(href, 'a') OR contains(text, 'a')) THEN 0 ELSE 1 END AS pass FROM c)
SELECT page_id, pos, pass FROM y QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pass, pos) = 1""")
def l06(spark, d):
    found = links.anchors(spark.read.parquet(f"{d}/pages.parquet")).withColumns({"href": F.concat("href", F.lit(".pdf")), "year": F.lit("a")})
    # The marker of the target year is a letter here, as these pages have no years.
    return ent.listing_pick(found).select("page_id", "pos", "pass")


@query("k02_k03_k04_components", ("fx_candidate",), PREPARED.format(source="fx_candidate") + f"""
SELECT request_id, pos, {says_year_sql('f')} AS in_file, {says_year_sql('l')} AS in_url, CASE WHEN contains({HOST_SQL.format(u='url')}, {HOST_SQL.format(u='ir_url')}) THEN 40 WHEN {m('l', rules.TRUSTED_HOSTS)} THEN 20 ELSE 0 END AS source_points,
  CASE WHEN {m('l', rules.ENGLISH_URL)} THEN 15 WHEN {m('l', rules.FOREIGN_URL)} THEN 0 ELSE 5 END AS language_points FROM v""")
def k02(spark, d):
    df = scoring.prepared(fixture(spark, d, "fx_candidate"))
    low, y = F.col("url_l"), F.col("year")
    return df.select("request_id", "pos", scoring.says_year(F.col("file_l"), y).alias("in_file"), scoring.says_year(low, y).alias("in_url"), scoring.source_points(low, F.col("url"), F.col("ir_url")).alias("source_points"),
                     scoring.language_points(low).alias("language_points"))


@query("a03_w08_distinct_hits", ("fx_candidate",), LINK + f""",
o AS (SELECT request_id, url, pos, CASE WHEN {m('l', rules.FOREIGN_URL)} AND NOT {m('l', rules.ENGLISH_URL)} THEN 1 ELSE 0 END AS other FROM v QUALIFY row_number() OVER (PARTITION BY request_id, url ORDER BY pos) = 1)
SELECT request_id, url, CAST(row_number() OVER (PARTITION BY request_id ORDER BY other, pos) AS INT) AS place FROM o""")
def a03(spark, d):
    one = ranking.first_by(fixture(spark, d, "fx_candidate"), ["request_id", "url"], [F.asc("pos")])
    low = F.lower("url")
    other = (any_of(low, rules.FOREIGN_URL) & ~any_of(low, rules.ENGLISH_URL)).cast("int")
    return ranking.numbered(one.withColumn("other", other), ["request_id"], [F.asc("other"), F.asc("pos")]).select("request_id", "url", "place")


@query("r23_w04_site_scoped", ("fx_candidate",), f"""
s AS (SELECT request_id, pos, url, CASE WHEN own AND contains(lower(url), 'annual') AND contains(url, year::VARCHAR) THEN 0 WHEN own AND contains(lower(url), 'annual') THEN 1 WHEN own THEN 2 END AS level
  FROM (SELECT *, contains({HOST_SQL.format(u='url')}, {HOST_SQL.format(u='ir_url')}) AS own FROM fx_candidate WHERE suffix(lower(url), '.pdf')))
SELECT request_id, pos, level FROM s WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY request_id)""")
def r23(spark, d):
    df = fixture(spark, d, "fx_candidate").where(F.lower("url").endswith(".pdf"))
    own, annual, year = F.contains(bare_host(F.col("url")), bare_host(F.col("ir_url"))), F.contains(F.lower("url"), F.lit("annual")), F.contains("url", F.col("year").cast("string"))
    level = F.when(own & annual & year, 0).when(own & annual, 1).when(own, 2)
    return ranking.first_level(df.withColumn("level", level).where("level is not null"), ["request_id"], "level").select("request_id", "pos", "level")


@query("k07_combined_score", ("fx_candidate", "fx_status"), RANKED.rstrip() + f""",
q AS (SELECT request_id, pos, score, CASE WHEN contains(l, 'report') THEN 0.1 ELSE 0.0 END AS quick FROM ranked)
SELECT request_id, pos, round(CASE WHEN score <= 0 THEN 0 ELSE score + quick END, 6) AS combined FROM q WHERE CASE WHEN score <= 0 THEN 0 ELSE score + quick END > 0.3""")
def k07(spark, d):
    quick = F.when(F.contains(F.lower("url"), F.lit("report")), 0.1).otherwise(0.0)
    combined = F.when(F.col("score") <= 0, 0.0).otherwise(F.col("score") + quick)
    return ranked(spark, d).withColumn("combined", combined).where("combined > 0.3").select("request_id", "pos", F.round("combined", 6).alias("combined"))
