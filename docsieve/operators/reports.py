"""Aggregates over requests, results, feedback and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators.ranking import top_n


def bulk_summary(results: DataFrame, *, by: str = "submission_id") -> DataFrame:
    """``total, found, failed`` of each submission; a result without a url is a failure."""
    found = F.count_if(F.col("url").isNotNull())
    return results.groupBy(by).agg(F.count("*").alias("total"), found.alias("found"), (F.count("*") - found).alias("failed"))


def quality(results: DataFrame, *, by: str = "source") -> DataFrame:
    """Per source: results, official hosts, urls that name the year, low scores, mean score."""
    return results.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("official").alias("n_official"), F.count_if("year_in_url").alias("n_year"),
        F.count_if(F.col("score") < 0.80).alias("n_low"), F.round(F.avg("score"), 6).alias("mean_score"))


def rejects(scored: DataFrame, *, by: str = "request_id") -> DataFrame:
    """How many candidates of each request fell to each rule, and to a score below the threshold."""
    reason = F.coalesce("reject", F.when(F.col("score") < F.when(F.col("source") == "web", 0.65).otherwise(0.80), "below threshold"))
    return scored.withColumn("reason", reason).where("reason is not null").groupBy(by, "reason").agg(F.count("*").alias("n"))


def feedback_counts(feedback: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries and the newest time of each issue type, with its label."""
    counts = feedback.groupBy("issue_type").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    return counts.join(labels, "issue_type", "left").withColumn("label", F.coalesce("label", "issue_type"))


def newest(feedback: DataFrame, n: int = 200) -> DataFrame:
    return feedback.orderBy(F.desc("ts"), F.desc("feedback_id")).limit(n)


def latest_per_user(history: DataFrame, n: int = 50) -> DataFrame:
    return top_n(history, ["user_id"], [F.desc("fetched_at"), F.desc("search_id")], n, "place")


def dimension_checks(master: DataFrame) -> DataFrame:
    """One row of violation counts: missing fields, odd tickers, repeated tickers; all in one pass."""
    return master.agg(
        F.count("*").alias("n"), F.count_if(F.col("name").isNull() | (F.trim("name") == "")).alias("no_name"),
        F.count_if(~F.coalesce(F.col("ticker").rlike("^[A-Z.]+$"), F.lit(False))).alias("odd_ticker"),
        (F.count("ticker") - F.count_distinct("ticker")).alias("repeated_ticker"))
