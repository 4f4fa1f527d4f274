"""Registered queries of the discovery and ranking operators, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import requests as rq
from docsieve.functions import rules, scoring
from docsieve.functions.text import alternation, bare_host, file_name, host, path
from docsieve.operators import links, matching, ranking, reports
from docsieve.operators import requests as req
from docsieve.queries.fixtures import fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = 2024


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Registers a query under its name, with the SQL that follows its views."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (with_views(views) + ", " if views else "WITH ") + sql.strip().removeprefix(",") if not sql.strip().upper().startswith("SELECT") else ((with_views(views) + "\n") if views else "") + sql
        return f

    return register


def rx(words) -> str:
    return alternation(words)


# --- requests ---------------------------------------------------------------------------------------------------

YEAR_SQL = f"coalesce(try_cast(nullif(regexp_extract(raw_query, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INTEGER), {AS_OF - 1})"
TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw_query), '{rx(w)}') THEN '{k}'" for k, w in rules.REQUEST_TYPES.items()) + " ELSE 'annual_report' END"


def name_sql() -> str:
    out = "regexp_replace(raw_query, '\\b(?:19|20)\\d{2}\\b', '', 'g')"
    for w in rq.removal_order():
        out = f"regexp_replace({out}, '{w.replace('-', chr(92) + '-')}', '', 'gi')"
    out = f"regexp_replace({out}, '[^\\w\\s&.''-]', ' ', 'g')"
    return f"regexp_replace(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '^[-•·|/\\\\—– ]+|[-•·|/\\\\—– ]+$', '', 'g')"


def sector_sql(text: str) -> tuple[str, str]:
    """Columns of hits by sector, and the first sector with the most."""
    hits = ["(" + " + ".join(f"(contains({text}, '{w}'))::INT" for w in words) + ")" for words in rules.SECTORS.values()]
    return "[" + ", ".join(hits) + "]", "[" + ", ".join(f"'{s}'" for s in rules.SECTORS) + "]"


@query("p01_request_year", ("fx_request",), f"SELECT request_id, {YEAR_SQL} AS asked_year FROM fx_request")
def p01(spark, d):
    return fixture(spark, d, "fx_request").select("request_id", rq.request_year(F.col("raw_query"), AS_OF).alias("asked_year"))


@query("p02_document_type", ("fx_request",), f"SELECT request_id, {TYPE_SQL} AS doc_type FROM fx_request")
def p02(spark, d):
    return fixture(spark, d, "fx_request").select("request_id", rq.document_type(F.col("raw_query")).alias("doc_type"))


QUARTER_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw_query), '{p}') THEN {n}" for p, n in rq.QUARTERS) + " ELSE NULL END"
REST_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw_query), '{p}') THEN regexp_replace(lower(raw_query), '{p}', '', 'g')" for p, _ in rq.QUARTERS) + " ELSE lower(raw_query) END"
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(rest, '{p}') THEN '{k}'" for p, k, _ in rq.FILING_PATTERNS) + " ELSE 'annual' END"
FORM_SQL = "CASE " + " ".join(f"WHEN regexp_matches(rest, '{p}') THEN '{f}'" for p, _, f in rq.FILING_PATTERNS) + " ELSE '10-K' END"


@query("p03_p04_p07_filing_request", ("fx_request",), f"""
asked AS (SELECT request_id, {QUARTER_SQL} AS quarter, {REST_SQL} AS rest, nullif(regexp_extract(raw_query, '\\b([A-Z]{{1,5}})\\b', 1), '') AS t FROM fx_request),
master AS (SELECT ticker, name FROM fx_company)
SELECT request_id, quarter, {KIND_SQL} AS kind, {FORM_SQL} AS form, ticker AS found_ticker, name AS found_name FROM asked LEFT JOIN master ON t = ticker""")
def p03(spark, d):
    found = req.filing_request(fixture(spark, d, "fx_request"), fixture(spark, d, "fx_company"))
    return found.select("request_id", "quarter", "kind", "form", "found_ticker", "found_name")


@query("p05_company_name", ("fx_request",), f"SELECT request_id, {name_sql()} AS company_name FROM fx_request")
def p05(spark, d):
    return fixture(spark, d, "fx_request").select("request_id", rq.company_name(F.col("raw_query")).alias("company_name"))


_HITS, _SECTORS = sector_sql("lower(concat_ws(' ', raw_query, name))")


@query("p08_a01_sector", ("fx_request",), f"""
hits AS (SELECT request_id, {_HITS} AS h FROM fx_request)
SELECT request_id, CASE WHEN list_max(h) > 0 THEN ({_SECTORS})[list_position(h, list_max(h))] ELSE '' END AS sector, list_max(h) AS sector_hits FROM hits""")
def p08(spark, d):
    return req.with_sector(fixture(spark, d, "fx_request"), F.concat_ws(" ", "raw_query", "name")).select("request_id", "sector", "sector_hits")


REGION_SQL = "CASE " + " ".join(
    f"WHEN country = '{c}' OR regexp_matches(lower(name), '{rx(rules.REGION_WORDS[r])}') THEN '{r}'" for r, c in (("uae", "AE"), ("india", "IN"), ("turkey", "TR"))
) + " WHEN country = 'GB' THEN 'uk' WHEN country = 'US' THEN 'us' ELSE 'global' END"


@query("p10_region", ("fx_company",), f"SELECT company_id, {REGION_SQL} AS region FROM fx_company")
def p10(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", rq.region(F.col("name"), F.col("country")).alias("region"))


def forms_sql(year: str, forms=rq.YEAR_FORMS) -> list[str]:
    parts = {"y": f"({year})::VARCHAR", "p": f"({year} - 1)::VARCHAR", "n": f"({year} + 1)::VARCHAR", "yy": f"substr(({year})::VARCHAR, 3, 2)", "nn": f"substr(({year} + 1)::VARCHAR, 3, 2)"}
    out = []
    for form in forms:
        text = "'" + form + "'"
        for k, v in parts.items():
            text = text.replace("{" + k + "}", f"' || {v} || '")
        out.append(f"({text})")
    return out


@query("p11_year_forms", ("fx_request",), f"""
years AS (SELECT DISTINCT year FROM fx_request),
forms AS (SELECT year, 'report' AS style, unnest([{', '.join(forms_sql('year'))}]) AS form, unnest(range({len(rq.YEAR_FORMS)})) AS ord FROM years
  UNION ALL SELECT year, 'india', unnest([{', '.join(forms_sql('year', rq.INDIAN_YEAR_FORMS))}]), unnest(range({len(rq.INDIAN_YEAR_FORMS)})) FROM years)
SELECT year, style, CAST(ord AS INTEGER) AS ord, form FROM forms""")
def p11(spark, d):
    years = fixture(spark, d, "fx_request").select("year").distinct()
    style = lambda name, forms: years.select("year", F.lit(name).alias("style"), F.posexplode(rq.year_forms(F.col("year"), forms)).alias("ord", "form"))
    return style("report", rq.YEAR_FORMS).unionByName(style("india", rq.INDIAN_YEAR_FORMS))


@query("p14_subdomain_variants", ("fx_company",), """
names AS (SELECT unnest(['ir', 'investors', 'investor', 'static', 'cdn', 'assets', 'media', 'www']) AS sub)
SELECT company_id, 'https://' || sub || '.' || host AS variant FROM fx_company, names WHERE sub <> 'www'""")
def p14(spark, d):
    sites = fixture(spark, d, "fx_company").withColumn("ir_url", F.concat(F.lit("https://www."), "host", F.lit("/ir")))
    return req.subdomain_variants(sites).select("company_id", "variant")


_DROP = "[" + ", ".join(f"'{w}'" for w in (*rules.LEGAL_SUFFIXES, *rules.COMMON_WORDS)) + "]"
_SUFFIX = "[" + ", ".join(f"'{w}'" for w in rules.LEGAL_SUFFIXES) + "]"
TOKENS_SQL = f"list_filter(string_split(lower(name), ' '), lambda w: NOT list_contains({_DROP}, w) AND length(w) > 2)"
ACRONYM_SQL = f"array_to_string(list_transform(list_filter(string_split(lower(name), ' '), lambda w: NOT list_contains({_SUFFIX}, w) AND length(w) >= 4), lambda w: substr(w, 1, 1)), '')"


@query("p15_name_tokens", ("fx_company",), f"SELECT company_id, array_to_string({TOKENS_SQL}, '|') AS tokens, {ACRONYM_SQL} AS acronym FROM fx_company")
def p15(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", F.array_join(rq.core_tokens(F.col("name")), "|").alias("tokens"), rq.acronym(F.col("name")).alias("acronym"))


@query("p17_titles", ("fx_request",), """
t AS (SELECT request_id, name || ' - Annual Report (' || year::VARCHAR || ')' AS title FROM fx_request)
SELECT request_id, title, left(lower(regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '_+', '_', 'g')), 100) AS file FROM t""")
def p17(spark, d):
    return req.titled(fixture(spark, d, "fx_request").withColumn("doc_type", F.lit("annual_report"))).select("request_id", "title", "file")


# --- candidates: gates and scores ---------------------------------------------------------------------------------

def m(text: str, words) -> str:
    return f"regexp_matches({text}, '{rx(words)}')"


PREPARED = """
u AS (SELECT *, lower(url) AS l, regexp_extract(lower(url), '([^/]*)$', 1) AS f FROM {source}),
v AS (SELECT *, replace(translate(l, '-_', '  '), '%20', ' ') AS s, replace(translate(f, '-_', '  '), '%20', ' ') AS fs FROM u)"""
NON_ANNUAL = f"CASE WHEN {m('l', rules.REJECT_PATH)} THEN 'path' WHEN {m('l', rules.REJECT_URL)} OR {m('s', rules.REJECT_URL)} THEN 'url' WHEN {m('f', rules.REJECT_FILE)} OR {m('fs', rules.REJECT_FILE)} THEN 'file' END"


def says_year_sql(t: str) -> str:
    forms = forms_sql("year")
    ranges = ("{p}-{yy}", "{p}-{y}", "{y}-{nn}", "{y}-{n}")
    loose = [f"contains({t}, {sql})" for form, sql in zip(rq.YEAR_FORMS, forms, strict=True) if form not in ranges]
    tight = [f"regexp_matches({t}, '(^|[^0-9])' || {sql} || '([^0-9]|$)')" for form, sql in zip(rq.YEAR_FORMS, forms, strict=True) if form in ranges]
    return "(" + " OR ".join(loose + tight) + ")"


OLDER = " OR ".join(f"contains(f, {x})" for x in ("'fy' || substr((year - 1)::VARCHAR, 3, 2)", "'fy-' || substr((year - 1)::VARCHAR, 3, 2)", "'fy_' || substr((year - 1)::VARCHAR, 3, 2)", "'fy' || (year - 1)::VARCHAR",
                                                 "'fy-' || (year - 1)::VARCHAR", "'fy' || substr((year - 2)::VARCHAR, 3, 2)", "'fy-' || substr((year - 2)::VARCHAR, 3, 2)"))
YEAR_POINTS = f"""CASE WHEN {says_year_sql('f')} THEN 50 WHEN {OLDER} OR coalesce(list_min(regexp_extract_all(f, '((?:19|20)\\d{{2}})'))::INT < year, FALSE) THEN -1
  WHEN coalesce(list_min(regexp_extract_all(l, '((?:19|20)\\d{{2}})'))::INT > year, FALSE) THEN -1 WHEN {says_year_sql('l')} THEN 50 WHEN len(regexp_extract_all(l, '((?:19|20)\\d{{2}})')) > 0 THEN -1 ELSE 0 END"""
HOST_SQL = "regexp_replace(lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
PRESS = m("l", rules.PRESS_RELEASE)
SCORED = PREPARED.format(source="(SELECT c.*, head_status, content_type FROM fx_candidate c LEFT JOIN fx_status USING (url))") + f""",
points AS (SELECT *, greatest(CASE WHEN {m('l', rules.ANNUAL)} THEN 80 ELSE 30 END - CASE WHEN {PRESS} THEN 20 ELSE 0 END, 0) AS type_points, {YEAR_POINTS} AS year_points,
  CASE WHEN contains({HOST_SQL.format(u='url')}, {HOST_SQL.format(u='ir_url')}) THEN 40 WHEN {m('l', rules.TRUSTED_HOSTS)} THEN 20 ELSE 0 END AS source_points,
  CASE WHEN {m('l', rules.ENGLISH_URL)} THEN 15 WHEN {m('l', rules.FOREIGN_URL)} THEN 0 ELSE 5 END AS language_points,
  CASE WHEN head_status < 400 THEN 15 ELSE 5 END AS file_points,
  CASE WHEN len(list_filter(string_split(lower(name), ' '), lambda w: length(w) > 3 AND contains(l, w))) > 0 THEN 5 ELSE 0 END AS name_points, {NON_ANNUAL} AS why FROM v),
gated AS (SELECT *, CASE WHEN {m('l', rules.RATING_HOSTS)} THEN 'rating agency' WHEN contains(l, 'press_release') AND NOT {m('l', ('annual', 'report'))} THEN 'press release'
  WHEN why IS NOT NULL THEN 'type: ' || why WHEN head_status >= 400 AND head_status NOT IN (403, 405) THEN 'status'
  WHEN NOT ((head_status < 400 AND contains(content_type, 'pdf')) OR suffix(l, '.pdf') OR {m('l', rules.TRUSTED_HOSTS)}) THEN 'no pdf' WHEN year_points < 0 THEN 'year' END AS reject FROM points),
scored AS (SELECT *, CASE WHEN reject IS NOT NULL THEN 0.0::DOUBLE ELSE (type_points + year_points + source_points + language_points + file_points + name_points) / 100.0::DOUBLE END AS score FROM gated)
"""


def candidates(spark, d) -> DataFrame:
    status = fixture(spark, d, "fx_status")
    return fixture(spark, d, "fx_candidate").join(status, "url", "left")


@query("f01_f03_f05_gates", ("fx_candidate",), PREPARED.format(source="fx_candidate") + f"""
SELECT request_id, pos, {NON_ANNUAL} AS non_annual, {m('l', rules.RATING_HOSTS)} AS rating, {PRESS} AS press FROM v""")
def f01(spark, d):
    low = F.col("url_l")
    from docsieve.functions.text import any_of

    df = scoring.prepared(fixture(spark, d, "fx_candidate"))
    return df.select("request_id", "pos", scoring.non_annual().alias("non_annual"), any_of(low, rules.RATING_HOSTS).alias("rating"), any_of(low, rules.PRESS_RELEASE).alias("press"))


LINK = PREPARED.format(source="(SELECT *, lower(link_text) AS t FROM fx_candidate)")
LINK_REJECTED = f"({m('l', rules.REJECT_PATH)} OR {m(chr(40) + chr(39) + chr(39) + ' || l || ' + chr(39) + ' ' + chr(39) + ' || s || ' + chr(39) + ' ' + chr(39) + ' || t)', rules.LINK_REJECT)})"
BOTH = "(l || ' ' || t)"


@query("f02_link_filter", ("fx_candidate",), LINK + f""",
k AS (SELECT request_id, pos, NOT {LINK_REJECTED} AND {m(BOTH, rules.LINK_ACCEPT)} AS keep FROM v)
SELECT request_id, pos FROM k QUALIFY keep OR NOT max(keep) OVER (PARTITION BY request_id)""")
def f02(spark, d):
    df = fixture(spark, d, "fx_candidate")
    low, text = F.lower("url"), F.lower("link_text")
    return ranking.kept_or_all(df, ["request_id"], ~scoring.link_rejected(low, text) & scoring.link_accepted(low, text)).select("request_id", "pos")


def any_sql(t: str, forms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {x})" for x in forms) + ")"


EARLIER = lambda t: any_sql(t, [f"(year - {i})::VARCHAR" for i in range(1, 6)])
PRIOR = f"CASE WHEN {any_sql('f', forms_sql('year'))} THEN FALSE WHEN {EARLIER('f')} THEN TRUE WHEN {any_sql(BOTH, forms_sql('year'))} THEN FALSE ELSE {EARLIER(BOTH)} END"


@query("f08_k06_link_score", ("fx_candidate",), LINK + f"""
SELECT request_id, pos, {PRIOR} AS prior, CASE WHEN {PRIOR} THEN 0 ELSE CASE WHEN {any_sql(BOTH, forms_sql('year'))} THEN 30 ELSE -10 END + CASE WHEN {m('l', rules.LINK_TYPES['annual_report'])} THEN 20 ELSE 0 END
  + CASE WHEN contains(l, 'report') THEN 10 ELSE 0 END + CASE WHEN {m(BOTH, rules.ENGLISH_LINK)} THEN 15 WHEN {m(BOTH, rules.FOREIGN_LINK)} THEN -10 ELSE 0 END END AS points FROM v""")
def f08(spark, d):
    low, text, year = F.lower("url"), F.lower("link_text"), F.col("year")
    return fixture(spark, d, "fx_candidate").select("request_id", "pos", scoring.prior_year(low, text, year).alias("prior"), scoring.link_points(low, text, year, F.col("doc_type")).alias("points"))


@query("f09_likely_quarterly", ("fx_candidate",), f"""
SELECT request_id, pos, NOT {m("lower(url || ' ' || link_text)", rules.ANNUAL_HIT)} AND {m("lower(url || ' ' || link_text)", rules.QUARTERLY_HIT)} AS quarterly FROM fx_candidate""")
def f09(spark, d):
    return fixture(spark, d, "fx_candidate").select("request_id", "pos", scoring.likely_quarterly(F.col("url"), F.col("link_text")).alias("quarterly"))


@query("k01_candidate_score", ("fx_candidate", "fx_status"), SCORED + "SELECT request_id, pos, type_points, year_points, source_points, language_points, file_points, name_points, reject, score FROM scored")
def k01(spark, d):
    parts = [f"{p}_points" for p in ("type", "year", "source", "language", "file", "name")]
    return scoring.scored(candidates(spark, d)).select("request_id", "pos", *parts, "reject", "score")


@query("k05_tier", ("fx_candidate",), PREPARED.format(source="fx_candidate") + f"""
SELECT request_id, pos, CASE WHEN {m('l', rules.REJECT_PATH)} OR {m('l', rules.REJECT_URL)} OR {m("translate(l, '-_', '  ')", rules.REJECT_URL)} OR {m('f', rules.REJECT_FILE)} OR {m("translate(f, '-_', '  ')", rules.REJECT_FILE)} THEN 3
  WHEN {m('l', rules.ANNUAL)} THEN 1 ELSE 2 END AS tier FROM v""")
def k05(spark, d):
    return scoring.prepared(fixture(spark, d, "fx_candidate")).select("request_id", "pos", scoring.tier(F.col("doc_type")).alias("tier"))


@query("l07_url_parts", ("fx_candidate",), """
SELECT request_id, pos, lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') AS bare_host,
  regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS path, regexp_extract(url, '([^/]*)$', 1) AS file FROM fx_candidate""")
def l07(spark, d):
    u = F.col("url")
    return fixture(spark, d, "fx_candidate").select("request_id", "pos", host(u).alias("host"), bare_host(u).alias("bare_host"), path(u).alias("path"), file_name(u).alias("file"))


TOKENS_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/]*)', 1))"


@query("r16_identity", ("fx_candidate",), f"""
n AS (SELECT request_id, pos, {TOKENS_SQL} AS tok, {ACRONYM_SQL} AS acr, {TOKENS_HOST} AS h, lower(link_text) AS t, lower(source) AS s FROM fx_candidate),
w AS (SELECT *, CASE WHEN len(tok) = 0 THEN CASE WHEN length(acr) >= 3 THEN acr ELSE '' END ELSE '' END AS tick, replace(replace(split_part(h, '.', 1), '-', ''), '_', '') AS root, coalesce(tok[1], chr(1)) AS one,
  len(list_filter(tok, lambda x: contains(h, x))) AS hosted, len(list_filter(tok, lambda x: contains(t, x))) AS titled, len(list_filter(tok, lambda x: contains(s, x))) AS snipped FROM n)
SELECT request_id, pos, CASE WHEN len(tok) = 0 AND tick = '' THEN 100 WHEN length(tick) >= 3 AND contains(replace(replace(h, '-', ''), '.', ''), tick) THEN 100
  WHEN len(tok) = 1 AND (root = one OR (prefix(root, one) AND length(root) - length(one) <= 4) OR (suffix(root, one) AND length(root) - length(one) <= 7)) THEN 100
  WHEN len(tok) > 1 AND hosted >= CASE WHEN len(tok) <= 2 THEN len(tok) ELSE len(tok) - 1 END THEN 100
  WHEN length(tick) >= 3 AND contains(t, tick) THEN 50 WHEN len(tok) = 1 AND list_contains(string_split(t, ' '), one) THEN 50 WHEN len(tok) > 1 AND titled > 0 THEN 50
  WHEN length(tick) >= 3 AND contains(s, tick) THEN 20 WHEN snipped > 0 THEN 20 ELSE 0 END AS points FROM w""")
def r16(spark, d):
    df = fixture(spark, d, "fx_candidate").withColumns({"tok": rq.core_tokens(F.col("name")), "acr": rq.acronym(F.col("name"))})
    return df.select("request_id", "pos", scoring.identity_points(F.col("url"), F.col("link_text"), F.col("source"), F.col("tok"), F.col("acr"), F.lit("")).alias("points"))


# --- ranking ------------------------------------------------------------------------------------------------------

def with_ranks(df: DataFrame) -> DataFrame:
    low = F.lower("url")
    tier = F.when(F.col("source") == "ir_crawl", 0).when(scoring.trusted(low), 1).otherwise(2)
    phase = F.when(F.col("source") == "exchange", 0).when(F.col("source") == "ir_crawl", 1).otherwise(3)
    return df.withColumns({"source_tier": tier, "phase": phase})


def ranked(spark, d) -> DataFrame:
    status = fixture(spark, d, "fx_status")
    scored = with_ranks(scoring.scored(fixture(spark, d, "fx_candidate").join(status, "url", "left")))
    return scored.withColumn("alive", living())


def living():
    return ranking.alive(F.col("url"), F.col("head_status"), F.col("content_type"), F.col("get_status"), F.col("magic"), scoring.trusted(F.lower("url")))


def ranked_living(spark, d) -> DataFrame:
    """The rows of ``ranked`` that can be chosen where a result must pass and live: what is dead or ruled out is left out before it is scored."""
    looked_up = fixture(spark, d, "fx_candidate").join(fixture(spark, d, "fx_status"), "url", "left").withColumn("alive", living())
    return with_ranks(scoring.scored(looked_up.where("alive or source = 'pattern'"), only_kept=True))


RANKED = SCORED.replace("head_status, content_type FROM", "head_status, content_type, get_status, magic FROM") + f""",
ranked AS (SELECT *, CASE WHEN source = 'ir_crawl' THEN 0 WHEN {m('l', rules.TRUSTED_HOSTS)} THEN 1 ELSE 2 END AS source_tier, CASE source WHEN 'exchange' THEN 0 WHEN 'ir_crawl' THEN 1 ELSE 3 END AS phase,
  coalesce(CASE WHEN {m('l', rules.TRUSTED_HOSTS)} OR suffix(l, '.htm') OR suffix(l, '.html') THEN head_status IN (200, 403) WHEN head_status IN (200, 403) AND NOT contains(content_type, 'html') THEN TRUE
    WHEN head_status = 405 OR (head_status IN (200, 403) AND contains(content_type, 'html')) THEN get_status = 200 AND magic = '%PDF-' ELSE FALSE END, FALSE) AS alive FROM scored)
"""
PASSING = "score >= CASE WHEN source = 'web' THEN 0.65 ELSE 0.80 END AND alive"


@query("w01_f18_f21_best_alive", ("fx_candidate", "fx_status"), RANKED + f"""
SELECT request_id, url, source, score FROM ranked WHERE {PASSING} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source_tier, phase, url) = 1""")
def w01(spark, d):
    return ranking.best_alive(ranked_living(spark, d)).select("request_id", "url", "source", "score")


@query("w02_k08_top_links", ("fx_candidate",), LINK + f""",
keys AS (SELECT request_id, url, CASE WHEN {m('l', rules.REJECT_PATH)} OR {m(BOTH, rules.LINK_REJECT)} THEN 3 WHEN {m(BOTH, rules.LINK_ACCEPT)} THEN 1 ELSE 2 END AS tier, CASE WHEN {any_sql(BOTH, forms_sql('year'))} THEN 0 ELSE 1 END AS no_year,
  CASE WHEN {m(BOTH, rules.ENGLISH_LINK)} THEN 0 WHEN {m(BOTH, rules.FOREIGN_LINK)} THEN 2 ELSE 1 END AS lang, pos FROM v)
SELECT request_id, url, tier, no_year, lang, CAST(row_number() OVER (PARTITION BY request_id ORDER BY tier, no_year, lang, url, pos) AS INT) AS place FROM keys QUALIFY place <= 5""")
def w02(spark, d):
    tier, no_year, lang = scoring.link_order(F.lower("url"), F.lower("link_text"), F.col("year"), F.col("doc_type"))
    df = fixture(spark, d, "fx_candidate").select("request_id", "pos", "url", tier.alias("tier"), no_year.alias("no_year"), lang.alias("lang"))
    return ranking.top_n(df, ["request_id"], [F.asc(c) for c in ("tier", "no_year", "lang", "url", "pos")], 5, "place").drop("pos")


@query("w03_tier_first", ("fx_candidate", "fx_status"), RANKED + f""",
tiered AS (SELECT request_id, url, pos, score, CASE WHEN {m('l', rules.REJECT_PATH)} OR {m('l', rules.REJECT_URL)} OR {m("translate(l, '-_', '  ')", rules.REJECT_URL)} OR {m('f', rules.REJECT_FILE)} OR {m("translate(f, '-_', '  ')", rules.REJECT_FILE)} THEN 3
  WHEN {m('l', rules.ANNUAL)} THEN 1 ELSE 2 END AS tier FROM ranked WHERE source = 'web' AND score > 0)
SELECT request_id, url, tier, score FROM tiered QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY tier, score DESC, pos) = 1""")
def w03(spark, d):
    df = ranked(spark, d).where("source = 'web' and score > 0").withColumn("tier", scoring.tier(F.col("doc_type")))
    return ranking.top_n(df, ["request_id"], [F.asc("tier"), F.desc("score"), F.asc("pos")]).select("request_id", "url", "tier", "score")


@query("w04_first_level", ("fx_candidate",), "SELECT request_id, pos, source FROM fx_candidate QUALIFY CASE source WHEN 'exchange' THEN 2 WHEN 'web' THEN 1 ELSE 0 END = min(CASE source WHEN 'exchange' THEN 2 WHEN 'web' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id)")
def w04(spark, d):
    level = F.when(F.col("source") == "exchange", 2).when(F.col("source") == "web", 1).otherwise(0)
    return ranking.first_level(fixture(spark, d, "fx_candidate").withColumn("level", level), ["request_id"], "level").select("request_id", "pos", "source")


@query("w05_pdf_first", ("fx_candidate",), "SELECT request_id, pos, url FROM fx_candidate QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY NOT contains(lower(url), '.pdf'), pos) = 1")
def w05(spark, d):
    return matching.best_hits(fixture(spark, d, "fx_candidate")).select("request_id", "pos", "url")


@query("w07_autocomplete", ("fx_company",), """
prefixes AS (SELECT s_suppkey AS prefix_id, CASE WHEN s_suppkey % 3 = 0 THEN substr('RED WIDGET', 1, CAST(1 + s_suppkey % 6 AS INT)) WHEN s_suppkey % 3 = 1 THEN substr('BCA', 1, CAST(1 + s_suppkey % 3 AS INT)) ELSE '  ' END AS prefix FROM supplier),
hits AS (SELECT prefix_id, ticker, name, CASE WHEN ticker = p THEN 100 WHEN n = p THEN 95 WHEN prefix(ticker, p) THEN 80 WHEN prefix(n, p) THEN 75 WHEN contains(ticker, p) THEN 50 ELSE 40 END AS score
  FROM (SELECT prefix_id, upper(trim(prefix)) AS p FROM prefixes WHERE trim(prefix) <> '') JOIN (SELECT ticker, name, upper(name) AS n FROM fx_company) ON contains(n, p) OR contains(ticker, p))
SELECT prefix_id, ticker, score, CAST(row_number() OVER (PARTITION BY prefix_id ORDER BY score DESC, name, ticker) AS INT) AS place FROM hits QUALIFY place <= 10""")
def w07(spark, d):
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.substr(F.lit("RED WIDGET"), F.lit(1), (1 + key % 6).cast("int"))).when(key % 3 == 1, F.substr(F.lit("BCA"), F.lit(1), (1 + key % 3).cast("int"))).otherwise("  ")
    prefixes = spark.read.parquet(f"{d}/supplier.parquet").select(key.alias("prefix_id"), text.alias("prefix"))
    return ranking.autocomplete(prefixes, fixture(spark, d, "fx_company")).select("prefix_id", "ticker", "score", "place")


@query("w09_latest_searches", ("fx_history",), "SELECT user_id, search_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY fetched_at DESC, search_id DESC) AS INT) AS place FROM fx_history QUALIFY place <= 50")
def w09(spark, d):
    return reports.latest_per_user(fixture(spark, d, "fx_history")).select("user_id", "search_id", "place")


@query("w11_progress", ("fx_session",), """
n AS (SELECT *, sum(CASE WHEN kind = 'status' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM fx_session),
p AS (SELECT *, CASE kind WHEN 'status' THEN ([15, 30, 48, 62, 75, 85])[CAST(least(k, 6) AS BIGINT)] WHEN 'result' THEN 95 ELSE 100 END AS percent FROM n)
SELECT session_id, seq, CAST(k AS INT) AS n_status, percent, CAST(least(floor(percent / 100.0 * 6), 5) AS INT) AS message FROM p""")
def w11(spark, d):
    return ranking.progress(fixture(spark, d, "fx_session")).select("session_id", "seq", "n_status", "percent", "message")


@query("w12_early_exit", ("fx_candidate", "fx_status"), RANKED + f"""
SELECT request_id, url, score, score >= 0.90 AND (alive OR source = 'pattern') AS early FROM ranked WHERE (score >= 0.90 AND alive) OR ({PASSING})
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY early DESC, CASE WHEN early THEN pos END NULLS LAST, score DESC, source_tier, phase, url) = 1""")
def w12(spark, d):
    return ranking.early_or_best(ranked_living(spark, d).withColumn("completed_at", F.col("pos"))).select("request_id", "url", "score", "early")


# --- matching -----------------------------------------------------------------------------------------------------

@query("r01_exact_lookup", ("fx_request",), """
asked AS (SELECT request_id, upper(CASE WHEN request_id % 2 = 0 THEN name ELSE ticker END) AS k FROM fx_request),
keys AS (SELECT upper(ticker) AS k, 0 AS prio, company_id, name FROM fx_company UNION ALL SELECT upper(name), 1, company_id, name FROM fx_company)
SELECT request_id, company_id, CASE prio WHEN 0 THEN 'ticker' ELSE 'name' END AS by FROM asked JOIN keys USING (k) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY prio, name, company_id) = 1""")
def r01(spark, d):
    asked = fixture(spark, d, "fx_request").select("request_id", F.when(F.col("request_id") % 2 == 0, F.col("name")).otherwise(F.col("ticker")).alias("asked"))
    return matching.exact(asked, fixture(spark, d, "fx_company"), text="asked")


ENTRIES = """
entries AS (SELECT k, min(o) AS place, max(company_id) AS found FROM (SELECT upper(ticker) AS k, company_id * 2 AS o, company_id FROM fx_company UNION ALL SELECT upper(name), company_id * 2 + 1, company_id FROM fx_company) GROUP BY k),
e AS (SELECT *, string_split_regex(k, '\\s+') AS kw FROM entries),
asked AS (SELECT DISTINCT text, list_filter(string_split_regex(upper(text), '\\s+'), lambda w: length(w) > 2) AS w FROM r),
hits AS (SELECT text, found, place FROM asked JOIN e ON kw[1] = w[1] WHERE len(list_filter(w, lambda x: list_contains(kw, x))) >= least(2, len(w))),
best AS (SELECT text, found FROM hits QUALIFY row_number() OVER (PARTITION BY text ORDER BY place) = 1)"""


@query("r02_fuzzy_lookup", ("fx_request",), f"""
r AS (SELECT request_id, name AS text FROM fx_request), {ENTRIES}
SELECT request_id, found AS company_id FROM r JOIN best USING (text)""")
def r02(spark, d):
    return matching.fuzzy(fixture(spark, d, "fx_request"), fixture(spark, d, "fx_company"), text="name")


@query("r02_fuzzy_lookup_whole", ("fx_request",), f"""
r AS (SELECT request_id, CASE WHEN request_id % 3 = 0 THEN ticker ELSE '?' END AS tick, CASE WHEN request_id % 3 = 2 THEN 'my ' || name || ' works' ELSE name END AS text FROM fx_request), {ENTRIES}
SELECT request_id, coalesce(t.found, n.found, best.found) AS company_id, CASE WHEN t.found IS NOT NULL THEN 0 WHEN n.found IS NOT NULL THEN 1 ELSE 2 END AS step
FROM r LEFT JOIN entries t ON t.k = upper(tick) LEFT JOIN entries n ON n.k = upper(text) LEFT JOIN best USING (text) WHERE coalesce(t.found, n.found, best.found) IS NOT NULL""")
def r02_whole(spark, d):
    """The whole chain of ticker, name and similar name, over all requests and companies."""
    k = F.col("request_id")
    asked = fixture(spark, d, "fx_request").select(k, F.when(k % 3 == 0, F.col("ticker")).otherwise("?").alias("tick"), F.when(k % 3 == 2, F.concat(F.lit("my "), "name", F.lit(" works"))).otherwise(F.col("name")).alias("text"))
    return matching.lookup(asked, fixture(spark, d, "fx_company"), ticker="tick", text="text")


@query("r04_contained_name", ("fx_request",), """
asked AS (SELECT DISTINCT name AS asked FROM fx_request), known AS (SELECT min(p_partkey) AS company_id, p_name AS name FROM part GROUP BY p_name)
SELECT asked, company_id, CASE WHEN lower(asked) = lower(name) THEN 0 WHEN contains(lower(asked), lower(name)) THEN 1 ELSE 2 END AS step FROM asked JOIN known ON contains(lower(asked), lower(name)) OR contains(lower(name), lower(asked))
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY step, company_id) = 1""")
def r04(spark, d):
    asked = fixture(spark, d, "fx_request").select(F.col("name").alias("asked")).distinct()
    known = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("company_id"))
    return matching.contained(asked, known, text="asked", key="asked")


OVERLAP = """
asked AS (SELECT DISTINCT raw_query AS asked FROM fx_request), w AS (SELECT asked, unnest(list_distinct(string_split(lower(trim(asked)), ' '))) AS w FROM asked),
named AS (SELECT lower(name) AS name, min(company_id) AS company_id FROM fx_company GROUP BY ALL), k AS (SELECT company_id, unnest(list_distinct(string_split(name, ' '))) AS w FROM named),
s AS (SELECT asked, company_id, count(*) AS score FROM w JOIN k USING (w) WHERE w <> '' GROUP BY ALL UNION ALL SELECT asked, company_id, 999 FROM w JOIN fx_company ON w = lower(ticker)),
best AS (SELECT asked, company_id, score FROM s QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, company_id) = 1)"""


@query("r07_most_overlap", ("fx_request",), OVERLAP + " SELECT asked, company_id, score FROM best")
def r07(spark, d):
    asked = fixture(spark, d, "fx_request").select(F.col("raw_query").alias("asked")).distinct()
    return matching.most_overlap(asked, fixture(spark, d, "fx_company"), text="asked", key="asked")


@query("r07_most_overlap_whole", ("fx_request",), OVERLAP + " SELECT request_id, b.company_id, score FROM fx_request JOIN best b ON raw_query = asked")
def r07_whole(spark, d):
    """The answer of every request; each different text is resolved once."""
    return fixture(spark, d, "fx_request").select("request_id", F.col("raw_query").alias("asked")).join(r07(spark, d), "asked").select("request_id", "company_id", "score")


#: Names of exchanges and the codes they stand for, in order.
EXCHANGES = (("ring", "XRNG"), ("wid", "XWID"), ("ed ", "XRED"), ("a", "XAAA"))


@query("r08_exchange_code", ("fx_company",), "SELECT company_id, CASE " + " ".join(f"WHEN contains(lower(name), '{a}') THEN '{b}'" for a, b in EXCHANGES) + " END AS mic FROM fx_company")
def r08(spark, d):
    dim = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(EXCHANGES)], "fragment string, value string, ord int")
    return matching.first_fragment(fixture(spark, d, "fx_company"), dim, text="name", result="mic").select("company_id", "mic")


ROUTES = ((None, "IN", "bombay", 0), ("XRNG", None, "ring", 1), (None, "AE", "dubai", 2), (None, "US", "sec", 3), ("XAAA", None, "abu", 4))
_ROUTES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in ROUTES)


@query("r14_routing", ("fx_company",), "mics AS (SELECT company_id, country, CASE " + " ".join(f"WHEN contains(lower(name), '{a}') THEN '{b}'" for a, b in EXCHANGES) + f""" END AS mic FROM fx_company),
routes AS (SELECT * FROM (VALUES {_ROUTES}) AS r(mic, country, route, ord))
SELECT company_id, route FROM mics c JOIN routes r ON r.mic = c.mic OR r.country = c.country QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ord) = 1""")
def r14(spark, d):
    routes = spark.createDataFrame(ROUTES, "mic string, country string, route string, ord int")
    return matching.routed(r08(spark, d).join(fixture(spark, d, "fx_company").select("company_id", "country"), "company_id"), routes, key="company_id")


# --- pages --------------------------------------------------------------------------------------------------------

_ANCHOR = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
ANCHORS = f"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS raw, unnest(range(len(regexp_extract_all(html, '{_ANCHOR}', 1)))) AS pos FROM pages),
b AS (SELECT page_id, CAST(pos AS INT) AS pos, trim(href) AS href, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_replace(url, '[?#].*$', '') AS plain FROM a WHERE trim(href) <> ''),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN prefix(href, '//') THEN 'http:' || href WHEN prefix(href, '/') THEN origin || href WHEN prefix(href, '?') THEN plain || href
  WHEN prefix(href, '#') THEN regexp_replace(url, '#.*$', '') || href WHEN plain = origin THEN origin || '/' || href ELSE regexp_replace(plain, '[^/]*$', '') || href END AS link FROM b)
"""


@query("l01_document_links", (), ANCHORS + """
SELECT page_id, pos, text, link FROM c WHERE contains(lower(href), 'pdf') OR regexp_matches(lower(href), 'the|ou') OR regexp_matches(lower(text), 'er|aux') OR (contains(lower(text), 'report') AND contains(lower(href), 'download'))
QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1""")
def l01(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return links.document_links(pages, words=("the", "ou"), phrases=("er", "aux")).select("page_id", "pos", "text", "link")


@query("l03_subpages", (), ANCHORS + """,
one AS (SELECT page_id, pos, link FROM c WHERE regexp_extract(link, '^[a-z]+://([^/?#:]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AND link <> url AND regexp_matches(lower(link || ' ' || text), 'and|the|un') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS place FROM one QUALIFY place <= 5""")
def l03(spark, d):
    return links.subpages(spark.read.parquet(f"{d}/pages.parquet"), words=("and", "the", "un")).select("page_id", "link", "place")


# --- reports ------------------------------------------------------------------------------------------------------

@query("a02_bulk_summary", ("fx_candidate", "fx_status"), RANKED + f""",
best AS (SELECT request_id, url FROM ranked WHERE {PASSING} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source_tier, phase, url) = 1)
SELECT request_id // 50 AS submission_id, count(*) AS total, count(url) AS found, count(*) - count(url) AS failed FROM fx_request LEFT JOIN best USING (request_id) GROUP BY ALL""")
def a02(spark, d):
    best = ranking.best_alive(ranked_living(spark, d)).select("request_id", "url")
    asked = fixture(spark, d, "fx_request").select("request_id", F.floor(F.col("request_id") / 50).alias("submission_id"))
    return reports.bulk_summary(asked.join(best, "request_id", "left"))


@query("a04_quality", ("fx_candidate", "fx_status"), SCORED + f"""
SELECT source, count(*) AS n, count(*) FILTER (source_points = 40) AS n_official, count(*) FILTER (contains(url, year::VARCHAR)) AS n_year, count(*) FILTER (score < 0.80) AS n_low, round(avg(score), 6) AS mean_score FROM scored GROUP BY source""")
def a04(spark, d):
    df = scoring.scored(candidates(spark, d)).withColumns({"official": F.col("source_points") == 40, "year_in_url": F.contains("url", F.col("year").cast("string"))})
    return reports.quality(df)


LABELS = (("wrong_company", "Wrong company"), ("wrong_year", "Wrong year"), ("broken_link", "Broken link"))


@query("a05_feedback", ("fx_feedback",), f"""
labels AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LABELS)}) AS t(issue_type, label))
SELECT issue_type, count(*) AS n, max(ts) AS newest, coalesce(any_value(label), issue_type) AS label FROM fx_feedback LEFT JOIN labels USING (issue_type) GROUP BY issue_type""")
def a05(spark, d):
    return reports.feedback_counts(fixture(spark, d, "fx_feedback"), spark.createDataFrame(LABELS, "issue_type string, label string"))


@query("a05_newest_feedback", ("fx_feedback",), "SELECT feedback_id, user_id, issue_type FROM fx_feedback ORDER BY ts DESC, feedback_id DESC LIMIT 200")
def a05b(spark, d):
    return reports.newest(fixture(spark, d, "fx_feedback")).select("feedback_id", "user_id", "issue_type")


@query("a06_dimension_checks", ("fx_company",), "SELECT count(*) AS n, count(*) FILTER (name IS NULL OR trim(name) = '') AS no_name, count(*) FILTER (NOT regexp_matches(ticker, '^[A-Z.]+$')) AS odd_ticker, count(ticker) - count(DISTINCT ticker) AS repeated_ticker FROM fx_company")
def a06(spark, d):
    return reports.dimension_checks(fixture(spark, d, "fx_company"))


@query("a07_rejects", ("fx_candidate", "fx_status"), SCORED + """
SELECT request_id, coalesce(reject, CASE WHEN score < CASE WHEN source = 'web' THEN 0.65 ELSE 0.80 END THEN 'below threshold' END) AS reason, count(*) AS n FROM scored WHERE reason IS NOT NULL GROUP BY ALL""")
def a07(spark, d):
    return reports.rejects(scoring.scored(candidates(spark, d)))
