"""Registered queries of gates taken one by one, dimension sources and append sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions import rules, scoring
from docsieve.operators import crawl, ranking
from docsieve.queries.core import PREPARED, YEAR_POINTS, candidates, m, query
from docsieve.queries.fixtures import fixture
from docsieve.queries.more import scratch
from docsieve.sources import tables
from docsieve.sources.store import UserTable


@query("f04_subsidiary_paths", ("fx_candidate",), """
u AS (SELECT request_id, pos, CASE pos % 3 WHEN 0 THEN 'Adani Ports' WHEN 1 THEN 'Eskom Holdings' ELSE name END AS n, url || CASE pos % 4 WHEN 0 THEN '/acc/x' WHEN 1 THEN '/medupi' ELSE '' END AS l FROM fx_candidate)
SELECT request_id, pos, (n = 'Adani Ports' AND regexp_matches(lower(l), '/acc/|/adani-cement/|/adani-green/|/adani-power/')) OR (n = 'Eskom Holdings' AND contains(lower(l), 'medupi')) AS subsidiary FROM u""")
def f04(spark, d):
    p = F.col("pos")
    name = F.when(p % 3 == 0, "Adani Ports").when(p % 3 == 1, "Eskom Holdings").otherwise(F.col("name"))
    url = F.concat("url", F.when(p % 4 == 0, "/acc/x").when(p % 4 == 1, "/medupi").otherwise(""))
    return fixture(spark, d, "fx_candidate").select("request_id", "pos", scoring.subsidiary(F.lower(url), name).alias("subsidiary"))


@query("f06_file_gate", ("fx_candidate", "fx_status"), f"""
SELECT request_id, pos FROM fx_candidate JOIN fx_status USING (url) WHERE (head_status < 400 AND contains(content_type, 'pdf')) OR suffix(lower(url), '.pdf') OR {m('lower(url)', rules.TRUSTED_HOSTS)}""")
def f06(spark, d):
    low = F.lower("url")
    kind = F.contains(F.lower("content_type"), F.lit("pdf")) & (F.col("head_status") < 400)
    return candidates(spark, d).where(kind | low.endswith(".pdf") | scoring.trusted(low)).select("request_id", "pos")


@query("f07_year_gate", ("fx_candidate",), PREPARED.format(source="fx_candidate") + f"SELECT request_id, pos, {YEAR_POINTS} AS points FROM v WHERE ({YEAR_POINTS}) >= 0")
def f07(spark, d):
    df = scoring.prepared(fixture(spark, d, "fx_candidate")).withColumn("points", scoring.year_points(F.col("year")))
    return df.where("points >= 0").select("request_id", "pos", "points")


@query("r12_country_languages", ("fx_company",), """
d AS (SELECT * FROM (VALUES ('GB/ZA', 'XLON,XJSE', 'en'), ('IN', 'XBOM,XNSE', 'en,hi'), ('AE', 'XDFM', 'ar,en')) AS t(key, exchanges, languages))
SELECT company_id, mic, language FROM fx_company JOIN (SELECT unnest(string_split(key, '/')) AS country, exchanges, languages FROM d) USING (country), unnest(string_split(exchanges, ',')) AS u(mic), unnest(string_split(languages, ',')) AS w(language)""")
def r12(spark, d):
    dim = spark.createDataFrame([("GB/ZA", "XLON,XJSE", "en"), ("IN", "XBOM,XNSE", "en,hi"), ("AE", "XDFM", "ar,en")], "key string, exchanges string, languages string")
    single = dim.select(F.explode(F.split("key", "/")).alias("country"), F.split("exchanges", ",").alias("e"), F.split("languages", ",").alias("l"))
    joined = fixture(spark, d, "fx_company").join(F.broadcast(single), "country")
    return joined.select("company_id", F.explode("e").alias("mic"), "l").select("company_id", "mic", F.explode("l").alias("language"))


@query("s02_page_source", (), "SELECT page_id, url, length(html) AS size FROM pages WHERE page_id % 5 <> 2 AND url NOT LIKE '%.pdf'")
def s02(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("status", F.when(F.col("page_id") % 5 == 2, 404).otherwise(200))
    return crawl.fetched(pages).select("page_id", "url", F.length("html").cast("long").alias("size"))


@query("s08_rule_dimensions", (), "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {i}, '{w}', {j})" for i, (s, ws) in enumerate(rules.SECTORS.items()) for j, w in enumerate(ws)) + ") AS t(sector, sector_rank, keyword, ord) WHERE EXISTS (SELECT 1 FROM part WHERE contains(lower(p_name || ' ' || p_type), left(keyword, 2)))")
def s08(spark, d):
    """Keywords whose first two letters occur in some part's name or type."""
    rows = [(s, i, w, j) for i, (s, ws) in enumerate(rules.SECTORS.items()) for j, w in enumerate(ws)]
    dim = spark.createDataFrame(rows, "sector string, sector_rank int, keyword string, ord int")
    names = spark.read.parquet(f"{d}/part.parquet").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("t")).distinct()
    return dim.join(names, F.contains("t", F.left("keyword", F.lit(2))), "left_semi")


@query("s09_history_sink", ("fx_history",), "SELECT user_id, search_id, raw_query, 2 AS copies FROM fx_history")
def s09(spark, d):
    path = scratch(spark, "history")
    rows = fixture(spark, d, "fx_history").select("user_id", "search_id", "raw_query")
    tables.append_history(rows, path)
    tables.append_history(rows, path, key="again")
    tables.append_history(rows, path, key="again")
    return UserTable(spark, path).read().groupBy("user_id", "search_id", "raw_query").agg(F.count("*").cast("int").alias("copies"))


@query("s12_cleared_store", ("fx_history",), """
SELECT user_id, search_id, (SELECT count(*) FROM fx_history WHERE user_id % 3 = 0) AS n_cleared, (SELECT count(*) FROM fx_history WHERE user_id % 3 = 1 AND search_id % 2 = 0) AS n_deleted
FROM fx_history WHERE user_id % 3 = 2 OR (user_id % 3 = 1 AND search_id % 2 = 1)""")
def s12_store(spark, d):
    """Every third user's history is cleared and single rows of others are deleted, in the store; what stays is read back."""
    path = scratch(spark, "history")
    rows = fixture(spark, d, "fx_history").select("user_id", "search_id")
    tables.append_history(rows, path)
    cleared = tables.clear_user(path, rows.where("user_id % 3 = 0"))
    deleted = tables.delete_items(path, rows.where("user_id % 3 = 1 and search_id % 2 = 0"))
    return UserTable(spark, path).read().select("user_id", "search_id", F.lit(cleared).cast("long").alias("n_cleared"), F.lit(deleted).cast("long").alias("n_deleted"))


@query("s10_library_sink", ("fx_request",), "SELECT user_id, request_id, CASE WHEN request_id % 2 = 0 THEN country ELSE '' END AS country, '' AS source, 0.0::DOUBLE AS score FROM fx_request")
def s10(spark, d):
    path = scratch(spark, "library")
    k = F.col("request_id")
    items = fixture(spark, d, "fx_request").select("user_id", k, F.when(k % 2 == 0, F.col("country")).alias("country"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("confidence"),
                                                   F.lit(None).cast("string").alias("sector"), F.lit(None).cast("double").alias("score"))
    tables.append_library(items, path)
    return UserTable(spark, path).read().select("user_id", "request_id", "country", "source", "score")


@query("u04_query_sets", ("fx_candidate",), """
h AS (SELECT request_id, url, CASE source WHEN 'web' THEN 1 ELSE 0 END AS query_ord, pos FROM fx_candidate WHERE pos % 2 = 0 UNION ALL SELECT request_id, url, 2, pos FROM fx_candidate WHERE pos % 2 = 1 OR pos % 3 = 0)
SELECT request_id, url, query_ord, pos FROM h QUALIFY row_number() OVER (PARTITION BY request_id, url ORDER BY query_ord, pos) = 1""")
def u04(spark, d):
    df = fixture(spark, d, "fx_candidate")
    standard = df.where("pos % 2 = 0").select("request_id", "url", F.when(F.col("source") == "web", 1).otherwise(0).alias("query_ord"), "pos")
    other = df.where("pos % 2 = 1 or pos % 3 = 0").select("request_id", "url", F.lit(2).alias("query_ord"), "pos")
    return ranking.first_by(standard.unionByName(other), ["request_id", "url"], [F.asc("query_ord"), F.asc("pos")])
