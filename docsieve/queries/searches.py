"""Registered queries of search plans and of their evaluation, with DuckDB SQL for each."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docsieve.functions import searches as sr
from docsieve.operators import searches
from docsieve.queries.core import REGION_SQL, query
from docsieve.queries.fixtures import fixture

NATIVE = "CASE country WHEN 'TR' THEN 'yıllık rapor' WHEN 'JP' THEN '年報' WHEN 'US' THEN 'Annual Report' ELSE '' END"
LABEL = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sr.DOCUMENT_LABELS) + " ELSE 'annual report' END"
KIND = "CASE request_id % 4 WHEN 0 THEN 'quarterly_report' WHEN 1 THEN 'investor_presentation' WHEN 2 THEN 'other' ELSE 'annual_report' END"
HOST = "regexp_extract(lower({}), '^[a-z]+://([^/?#:]*)', 1)"
VALUES = {
    "{name}": "name", "{doc}": LABEL, "{year}": "year::VARCHAR", "{fy}": "(year - 1)::VARCHAR || '-' || substr(year::VARCHAR, 3, 2)", "{yy}": "substr(year::VARCHAR, 3, 2)", "{nyy}": "substr((year + 1)::VARCHAR, 3, 2)",
    "{native}": "native_term", "{site}": "site",
}


def text_sql(template: str) -> str:
    """A template as a concatenation of SQL expressions."""
    parts = re.split(r"(\{[a-z]+\})", template)
    return " || ".join(VALUES.get(p) or "'" + p.replace("'", "''") + "'" for p in parts if p)


PLANNED = "SELECT request_id, query, CAST(min(ord) AS INTEGER) AS ord FROM (" + " UNION ALL ".join(
    f"SELECT request_id, {o} AS ord, {text_sql(t)} AS query FROM q WHERE " + {"all": "true", "native": "lower(native_term) NOT IN ('', 'annual report')"}.get(r, f"region = '{r}'") for r, o, t in sr.SEARCHES) + ") GROUP BY ALL"


@query("p12_search_plan", ("fx_request",), f"q AS (SELECT *, {REGION_SQL} AS region, {NATIVE} AS native_term, {KIND} AS doc_type FROM fx_request) " + PLANNED)
def p12(spark, d):
    requests = fixture(spark, d, "fx_request")
    return searches.plan(requests.withColumns({"native_term": F.expr(NATIVE), "doc_type": F.expr(KIND)}))


def spaced(text: str) -> str:
    """The words of a text between single blanks."""
    return f"' ' || array_to_string(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"


def met_sql(term: str) -> str:
    kind, _, value = term.partition(":")
    if kind == "site":
        return f"(host = lower({text_sql(value)}) OR suffix(host, '.' || lower({text_sql(value)})))"
    if kind == "filetype":
        return f"regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([a-z0-9]+)$', 1) = '{value}'"
    return f"contains(said, {spaced(text_sql(term))})"


def required(term: str) -> bool:
    return ":" in term or term.startswith('"') or any(c in term for c in ("{year}", "{fy}", "{yy}", "{nyy}"))


def search_sql(template: str) -> tuple[str, str]:
    """Whether a hit meets all that is required, and how many of the other words of the template it has."""
    must, may = [], []
    for group in re.findall(r'(?:"[^"]*"|\S+)(?: OR \S+)*', template):
        terms = group.split(" OR ")
        if required(terms[0]):
            must.append("(" + " OR ".join(map(met_sql, terms)) + ")")
        elif "{name}" in group or "{doc}" in group:
            may.append(f"len(list_filter(regexp_extract_all(lower({text_sql(group)}), '[\\p{{L}}\\p{{N}}]+'), lambda w: contains(said, ' ' || w || ' ')))")
        else:
            may.append(f"CAST({met_sql(group)} AS INT)")
    return " AND ".join(must), " + ".join(may) or "0"


def answers_sql(rows) -> str:
    parts = []
    for _, o, t in rows:
        must, may = search_sql(t)
        parts.append(f"SELECT request_id, {o} AS ord, pos, {may} AS n_words FROM h WHERE {must}")
    return (
        f"h AS (SELECT *, {HOST.format('url')} AS host, {HOST.format('ir_url')} AS site, {spaced(chr(40) + 'url || chr(32) || link_text' + chr(41))} AS said FROM fx_candidate), s AS (" + " UNION ALL ".join(parts)
        + ") SELECT request_id, CAST(ord AS INTEGER) AS ord, pos, CAST(n_words AS BIGINT) AS n_words FROM s QUALIFY ord = min(ord) OVER (PARTITION BY request_id)"
    )


def asked(hits):
    return hits.groupBy("request_id", "name", "year", "ir_url", "doc_type").agg(F.count("*").alias("n_hits"))


@query("r23_site_searches", ("fx_candidate",), answers_sql(sr.SITE_SEARCHES))
def r23_site(spark, d):
    """The strictest search within the company's site that some candidate meets."""
    hits = fixture(spark, d, "fx_candidate")
    return searches.answers(searches.site_plan(asked(hits)), hits)


@query("r23_p12_searches", ("fx_candidate",), answers_sql([r for r in sr.SEARCHES if r[0] == "all"]))
def r23_all(spark, d):
    """The first of the six searches for all companies that some candidate meets."""
    hits = fixture(spark, d, "fx_candidate")
    return searches.answers(searches.plan(asked(hits).withColumn("country", F.lit(""))).where("ord <= 6"), hits)
