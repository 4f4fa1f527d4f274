"""Requests, companies and candidate links derived from the star-schema tables.

The same SQL text runs in Spark and DuckDB, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("part", "orders", "lineitem", "customer", "events", "pages", "supplier", "nation")

VIEWS = {
    "fx_company": """
SELECT p_partkey AS company_id,
  p_name || CASE p_partkey % 5 WHEN 0 THEN ' limited' WHEN 1 THEN ' plc' WHEN 2 THEN ' inc' WHEN 3 THEN ' group' ELSE ' bank' END AS name,
  translate(CAST(p_partkey AS STRING), '0123456789', 'ABCDEFGHIJ') AS ticker,
  CASE p_partkey % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' WHEN 2 THEN 'GB' WHEN 3 THEN 'AE' WHEN 4 THEN 'TR' WHEN 5 THEN 'ZA' WHEN 6 THEN 'JP' ELSE '' END AS country,
  replace(p_name, ' ', '') || CAST(p_partkey AS STRING) || '.com' AS host
FROM part""",
    "fx_request": """
SELECT o_orderkey AS request_id, company_id, name, ticker, country, host, CAST(year(o_orderdate) AS INT) AS year, o_custkey AS user_id,
  CASE o_orderkey % 8 WHEN 0 THEN name || ' annual report ' || CAST(year(o_orderdate) AS STRING)
    WHEN 1 THEN name || ' 10-Q ' || CAST(year(o_orderdate) AS STRING) WHEN 2 THEN ticker || ' 10-K ' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN name || ' q3 ' || CAST(year(o_orderdate) AS STRING) || ' earnings' WHEN 4 THEN name || ' investor presentation'
    WHEN 5 THEN name || ' (yearly report), third quarter' WHEN 6 THEN 'Proxy: ' || name || ' Bank of oil & gas' ELSE name END AS raw_query
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS company_key FROM orders) AS placed JOIN fx_company ON company_key = company_id""",
    "fx_candidate": """
SELECT request_id, pos, name, ticker, year, 'annual_report' AS doc_type, source, http_status,
  CASE WHEN kind = 0 THEN 'https://www.' || host WHEN kind = 1 THEN 'https://ir.' || host WHEN kind = 2 THEN 'https://www.bseindia.com'
    WHEN kind = 3 THEN 'https://www.annualreports.com' ELSE 'https://www.careratings.com' END || folder || stem || form || ext AS url,
  'https://www.' || host || '/investors' AS ir_url,
  CASE WHEN pos % 3 = 0 THEN 'Annual Report ' || CAST(year AS STRING) WHEN pos % 3 = 1 THEN name || ' download' ELSE 'Results ' || CAST(year - 1 AS STRING) END AS link_text
FROM (
  SELECT request_id, name, ticker, year, host, l_suppkey % 5 AS kind,
    CAST(row_number() OVER (PARTITION BY request_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount) AS INT) AS pos,
    CASE l_suppkey % 3 WHEN 0 THEN 'exchange' WHEN 1 THEN 'ir_crawl' ELSE 'web' END AS source,
    CASE l_suppkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END AS http_status,
    CASE l_partkey % 9 WHEN 0 THEN '/agm/' WHEN 1 THEN '/uploads/' || CAST(year + 1 AS STRING) || '/' WHEN 2 THEN '/news/' ELSE '/investors/' END AS folder,
    CASE l_partkey % 8 WHEN 0 THEN 'Annual-Report' WHEN 1 THEN 'q1-results' WHEN 2 THEN 'sustainability' WHEN 3 THEN replace(name, ' ', '-') WHEN 4 THEN 'integrated_report_en_'
      WHEN 5 THEN 'report_ar_' WHEN 6 THEN 'press_release' ELSE 'AnnualReport' END AS stem,
    CASE l_linenumber % 6 WHEN 0 THEN '-' || CAST(year AS STRING) WHEN 1 THEN '-' || CAST(year - 1 AS STRING) || '-' || substr(CAST(year AS STRING), 3, 2)
      WHEN 2 THEN '-fy' || substr(CAST(year - 1 AS STRING), 3, 2) WHEN 3 THEN '' WHEN 4 THEN '_' || CAST(year + 1 AS STRING)
      ELSE '-17.11.' || CAST(year - 1 AS STRING) || '-' || substr(CAST(year AS STRING), 3, 2) END AS form,
    CASE WHEN l_returnflag = 'R' THEN '.html' ELSE '.pdf' END AS ext
  FROM lineitem JOIN fx_request ON l_orderkey = request_id
) AS links""",
    "fx_status": """
SELECT url, min(http_status) AS head_status, CASE WHEN length(url) % 4 = 0 THEN 'text/html' ELSE 'application/pdf' END AS content_type,
  CASE WHEN length(url) % 3 = 0 THEN 200 ELSE 404 END AS get_status, CASE WHEN length(url) % 2 = 0 THEN '%PDF-' ELSE '<html' END AS magic
FROM fx_candidate GROUP BY url""",
    "fx_history": """
SELECT user_id, request_id AS search_id, o_orderdate AS fetched_at, raw_query FROM fx_request JOIN orders ON o_orderkey = request_id""",
    "fx_page": """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 11 = 0 THEN 404 ELSE 200 END AS status,
  site || CASE WHEN o_orderkey < 97 THEN '/reports' WHEN o_orderkey < 194 THEN '/investors' WHEN o_orderkey < 291 THEN '/archive' ELSE '/p' || CAST(o_orderkey AS STRING) END AS url,
  '<p><a href="/p' || CAST(o_orderkey + 97 AS STRING) || '">Investor centre</a> <a href=/p0>none</a> <a class="x" href="http://other.example.org/investors">Investors</a> <a href="/p' || CAST(o_orderkey - 291 AS STRING) || '">Quarterly</a>'
    || CASE WHEN o_orderkey % 5 = 0 THEN '<A HREF="files/r' || CAST(o_orderkey % 7 AS STRING) || '.pdf"><b>The</b> file</A>' ELSE '<a href="/news">News</a>' END
    || CASE WHEN o_orderkey % 3 = 0 THEN '<a href="/p' || CAST(o_orderkey + 970 AS STRING) || '">Shareholder letters</a><a href="">Filings</a>' ELSE '' END AS html
FROM (SELECT o_orderkey, 'http://h' || CAST(o_orderkey % 97 AS STRING) || '.example.com' AS site FROM orders) AS sites""",
    "fx_session": """
SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'done' ELSE 'status' END AS kind, ts, value FROM events""",
    "fx_feedback": """
SELECT event_id AS feedback_id, user_id, CASE event_type WHEN 'click' THEN 'wrong_company' WHEN 'view' THEN 'wrong_year' WHEN 'error' THEN 'broken_link' ELSE 'other' END AS issue_type, ts,
  repeat(props, 1 + CAST(event_id % 70 AS INT)) AS user_note FROM events""",
}
#: Which views a view reads.
NEEDS = {"fx_request": ("fx_company",), "fx_candidate": ("fx_request",), "fx_status": ("fx_candidate",), "fx_history": ("fx_request",)}


def chain(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in (*chain(NEEDS.get(name, ())), name) if n not in out]
    return out


def with_views(names: tuple[str, ...]) -> str:
    """Common table expressions for DuckDB, where the base tables are views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in chain(names))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE if any(t in VIEWS[n] for n in chain((name,)))]
    text += [f"{n} AS ({VIEWS[n]})" for n in chain((name,))]
    return spark.sql(f"WITH {', '.join(text)} SELECT * FROM {name}")
