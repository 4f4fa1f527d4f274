"""Registered queries of the routes to exchanges, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators.entities import ABU_DHABI
from docsieve.plans import routes
from docsieve.queries.core import m, query
from docsieve.queries.fixtures import fixture

CODES = ["", "ZZ", *[c for _, codes, *_ in routes.ROUTES for c in codes]]
COUNTRIES = ["", "ZZ", *[c for _, _, countries, *_ in routes.ROUTES for c in countries]]
SOURCES = list(dict.fromkeys(s for *_, sources in routes.ROUTES for s in sources))
listed = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"

#: Companies with every code and country in turn, and names of the Emirates, India and Turkey among them.
ENTITIES = f"""
ent AS (SELECT request_id, {listed(CODES)}[1 + request_id % {len(CODES)}] AS exchange_mic, CASE WHEN request_id % 3 = 0 THEN '' ELSE {listed(COUNTRIES)}[1 + request_id % {len(COUNTRIES)}] END AS country, name AS company_name,
  CASE request_id % 7 WHEN 0 THEN 'Aldar ' || name || ' PJSC' WHEN 1 THEN 'Dubai ' || name WHEN 2 THEN name || ' A.Ş.' WHEN 3 THEN name || ' Ltd' ELSE '' END AS normalized_name FROM fx_request),
found AS (SELECT request_id, {listed(SOURCES)}[1 + (request_id + 5 * pos) % {len(SOURCES)}] AS source, pos, CASE WHEN http_status = 403 THEN '' ELSE url END AS url FROM fx_candidate)"""
_steps = lambda r: "CASE " + r + " " + " ".join(
    f"WHEN '{k}' THEN " + (f"CASE WHEN {m('lower(n)', ABU_DHABI)} THEN ['ADX', 'DFM', 'UAE Web Search'] ELSE {listed(v)} END" if k == "uae" else listed(v)) for k, v in routes.SOURCES.items()) + " ELSE [] END"
ANSWERED = ENTITIES + ", n AS (SELECT *, CASE WHEN normalized_name <> '' THEN normalized_name ELSE company_name END AS n FROM ent), r AS (SELECT *, CASE " + " ".join(
    f"WHEN exchange_mic IN ('-', {listed(codes or ['-'])[1:-1]}) OR country IN ({listed(countries)[1:-1]})" + (f" OR {m('lower(n)', words)}" if words else "") + f" THEN '{label}'"
    for label, codes, countries, words, _ in routes.ROUTES) + " END AS first, CASE " + " ".join(f"WHEN {m('lower(n)', words)} THEN '{label}'" for label, words in routes.NAME_ROUTES) + f""" END AS second FROM n),
s AS (SELECT request_id, unnest({_steps('first')}) AS source, generate_subscripts({_steps('first')}, 1) AS step, first AS route, false AS by_name FROM r
  UNION ALL SELECT request_id, unnest({_steps('second')}), 100 + generate_subscripts({_steps('second')}, 1), second, true FROM r)
SELECT request_id, route, source, by_name, url FROM s JOIN found USING (request_id, source) WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY step, pos, url) = 1"""


def inputs(spark, d):
    k = F.col("request_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at % len(values)).cast("int"))
    own = F.when(k % 7 == 0, F.concat(F.lit("Aldar "), "name", F.lit(" PJSC"))).when(k % 7 == 1, F.concat(F.lit("Dubai "), "name")).when(k % 7 == 2, F.concat("name", F.lit(" A.Ş."))).when(k % 7 == 3, F.concat("name", F.lit(" Ltd"))).otherwise("")
    entities = fixture(spark, d, "fx_request").select(k, pick(CODES, k).alias("exchange_mic"), F.when(k % 3 == 0, "").otherwise(pick(COUNTRIES, k)).alias("country"), F.col("name").alias("company_name"), own.alias("normalized_name"))
    hits = fixture(spark, d, "fx_candidate")
    return entities, hits.select(k, pick(SOURCES, k + 5 * F.col("pos")).alias("source"), "pos", F.when(F.col("http_status") == 403, "").otherwise(F.col("url")).alias("url"))


@query("r14_routes", ("fx_candidate",), ANSWERED)
def r14(spark, d):
    """All routes; where the first source has nothing the next is taken, and where the route has nothing, the name's."""
    return routes.answered(*inputs(spark, d))
