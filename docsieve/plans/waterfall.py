"""Sources tried one after the other, each only for requests that earlier ones left open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.ranking import best_alive, first_by, top_n


def waterfall(requests: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], *, key: str = "request_id") -> DataFrame:
    """``stage`` and the best passing candidate of the first stage that has one, for each request that has any.

    A stage is a function from open requests to scored candidates. Requests answered by earlier stages are
    anti-joined away before the stage runs, so later, dearer stages see few rows.
    """
    done = None
    for name, stage in stages:
        left = requests if done is None else requests.join(done.select(key), key, "left_anti")
        found = best_alive(stage(left), request=key).withColumn("stage", F.lit(name))
        done = found if done is None else done.unionByName(found)
    return done


def waterfall_of(pool: DataFrame, requests: DataFrame, stages: list[tuple[str, Column]], *, key: str = "request_id") -> DataFrame:
    """The same where all stages draw from one table of scored candidates, which is read once; a candidate belongs to the first stage whose condition it meets."""
    at = F.lit(None).cast("int")
    for i, (_, condition) in reversed(list(enumerate(stages))):
        at = F.when(condition, i).otherwise(at)
    staged = pool.join(requests.select(key), key, "left_semi").withColumn("stage at", at).where("`stage at` is not null")
    best = best_alive(staged, request=key, first=["stage at"])
    return best.withColumn("stage", F.element_at(F.array(*[F.lit(name) for name, _ in stages]), F.col("stage at") + 1)).drop("stage at")


def enriched(results: DataFrame, requests: DataFrame, entities: DataFrame, *, key: str = "request_id") -> DataFrame:
    """All requests with their result, if any, and the company's normalised name, else the request's."""
    both = requests.join(results, key, "left").join(entities.select(key, "normalized_name", "country"), key, "left")
    return both.withColumns({"company_name": F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), F.col("name")), "found": F.col("url").isNotNull()})


def union_of_sources(sources: list[DataFrame], *, key: str = "request_id", most: int = 10) -> DataFrame:
    """Results of several sources in order of precedence, each url once, the first ``most`` by confidence."""
    rows = None
    for i, source in enumerate(sources):
        part = source.withColumn("rank_of_source", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    one = first_by(rows, [key, "url"], [F.asc("rank_of_source"), F.asc("pos")])
    return top_n(one, [key], [F.desc("confidence"), F.asc("rank_of_source"), F.asc("pos"), F.asc("url")], most, "place")


def with_year_fallback(requests: DataFrame, links: DataFrame, *, key: str = "request_id") -> DataFrame:
    """Each request's first link of its year, else of the year before, flagged. ``links (key, year, level, pos, url)``."""
    asked = requests.select(key, F.col("year").alias("asked_year"))
    usable = links.join(asked, key).where((F.col("year") == F.col("asked_year")) | (F.col("year") == F.col("asked_year") - 1))
    late = F.col("year") < F.col("asked_year")
    return top_n(usable.withColumn("year_fallback", late), [key], [F.asc("year_fallback"), F.asc("level"), F.asc("pos")])
