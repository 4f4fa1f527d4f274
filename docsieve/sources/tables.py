"""Request batches in, user tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.sources.store import UserTable


def checked_requests(batch: DataFrame, *, this_year: int, most: int = 50) -> DataFrame:
    """Adds ``reject``: why a row of a submission is not accepted, or null. Needs ``submission_id, company_name, year``."""
    n = F.count("*").over(Window.partitionBy("submission_id"))
    why = (
        F.when(n > most, "too many rows").when(F.coalesce(F.trim("company_name"), F.lit("")) == "", "no company")
        .when(F.col("year").isNull() | ~F.col("year").between(1990, this_year + 1), "year")
    )
    return batch.withColumn("reject", why)


def append_history(results: DataFrame, path: str, *, key: str | None = None) -> DataFrame:
    """Appends results with the time of writing to the user table in ``path``; a call with the ``key`` of an earlier one adds nothing."""
    return UserTable(results.sparkSession, path).append(results.withColumn("fetched_at", F.current_timestamp()), key=key)


def library_rows(items: DataFrame) -> DataFrame:
    """Saved items with their defaults; ids are made when the rows are written."""
    defaults = {"source": "", "confidence": "", "country": "", "sector": ""}
    return items.na.fill(defaults).na.fill({"score": 0.0})


def append_library(items: DataFrame, path: str, *, key: str | None = None) -> DataFrame:
    """Appends the items to the user table in ``path`` and returns them as written, each with an id of its own.

    A call with the ``key`` of an earlier one adds nothing.
    """
    made = library_rows(items).withColumns({"item_id": F.uuid(), "saved_at": F.current_timestamp()})
    return UserTable(items.sparkSession, path).append(made, key=key)


def clear_user(path: str, users: DataFrame) -> int:
    """Deletes all rows of the users from the table in ``path``; gives their number."""
    return UserTable(users.sparkSession, path).delete(users.select("user_id"))


def delete_items(path: str, keys: DataFrame) -> int:
    """Deletes the rows with these users and ids; gives their number. A row of another user stays, whatever its id."""
    return UserTable(keys.sparkSession, path).delete(keys)


def feedback_rows(items: DataFrame, *, longest: int = 500) -> DataFrame:
    """Accepted feedback: notes of at most 500 characters, pending."""
    return items.where(F.length(F.coalesce("user_note", F.lit(""))) <= longest).withColumn("status", F.lit("pending"))


def append_feedback(items: DataFrame, path: str, *, longest: int = 500) -> None:
    """Appends accepted feedback with the time of writing."""
    feedback_rows(items, longest=longest).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def without_keys(history: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that stay after the keys are deleted."""
    return history.join(keys.select(*on).distinct(), on, "left_anti")


def cleared(history: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays after users clear their history, and how many rows each loses."""
    gone = history.join(users.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("deleted"))
    return without_keys(history, users, ["user_id"]), gone


def responses(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One row per request with its results as a nested list, best first, and a note where there are none."""
    nested = results.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("confidence", "url")), asc=False).alias("results"))
    joined = requests.join(nested, "request_id", "left").withColumn("results", F.coalesce("results", F.expr("cast(array() as array<struct<confidence:double,url:string>>)")))
    n = F.size("results")
    return joined.withColumns({"success": n > 0, "n_results": n, "notes": F.when(n == 0, "No documents found").otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(" documents")))})
