"""Session events as streams. Each streaming query has a batch twin with the same result on finished input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error")
QUIET = "120 seconds"


def timed(events: DataFrame) -> DataFrame:
    """Event times as timestamps, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def until_closed(events: DataFrame) -> DataFrame:
    """Batch: each session's events up to and including its first terminal one."""
    before = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(F.col("kind").isin(*TERMINAL).cast("int")).over(before), F.lit(0))
    return events.withColumn("was closed", closed).where("`was closed` = 0").drop("was closed")


def until_closed_stream(events: DataFrame) -> DataFrame:
    """Stream: the same, with one closed flag of state per session; the rows of one micro-batch may come in any order.

    A micro-batch gives a session's rows in several parts, and its first end may be in the last of them. So rows are held until all
    parts are read, but only those up to the earliest end found by then. What a later micro-batch brings counts as later;
    ``ordered.closing_stream`` takes input in any order and lets quiet sessions go.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists and state.get[0]:
            return
        kept, end = [], None
        early = lambda rows: rows[(rows["ts"] < end[0]) | ((rows["ts"] == end[0]) & (rows["seq"] <= end[1]))]
        for rows in batches:
            ends = rows[rows["kind"].isin(TERMINAL)].sort_values(["ts", "seq"])
            first = None if ends.empty else (ends["ts"].iloc[0], ends["seq"].iloc[0])
            if first is not None and (end is None or first < end):
                end = first
                kept = [early(k) for k in kept]
            kept.append(rows if end is None else early(rows))
        state.update((end is not None,))
        for rows in kept:
            yield rows[["session_id", "seq", "kind", "ts"]]

    picked = timed(events).select("session_id", "seq", "kind", "ts")
    return picked.groupBy("session_id").applyInPandasWithState(step, "session_id long, seq long, kind string, ts timestamp", "closed boolean", "append", "NoTimeout")


def quiet_periods(events: DataFrame, *, gap: str = QUIET, lateness: str = "10 minutes") -> DataFrame:
    """Runs of a session's events without a pause of ``gap``; each ends with a timeout unless a terminal event closed it."""
    run = F.session_window("ts", gap)
    out = timed(events).withWatermark("ts", lateness).groupBy("session_id", run.alias("run")).agg(F.count("*").alias("n"), F.max(F.col("kind").isin(*TERMINAL)).alias("closed"))
    return out.select("session_id", F.col("run.start").alias("started"), F.col("run.end").alias("timeout_at"), "n", (~F.col("closed")).alias("timed_out"))


def counters(events: DataFrame) -> DataFrame:
    """Found and failed results so far of each session."""
    return events.groupBy("session_id").agg(F.count_if(F.col("kind") == "result").alias("found"), F.count_if(F.col("kind") == "error").alias("failed"))


def over_limit(calls: DataFrame, *, most: int = 10, window: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """Calls of each client by minute, and whether they exceed the limit. Needs ``client_id, ts``."""
    w = F.window("ts", window)
    out = timed(calls).withWatermark("ts", lateness).groupBy("client_id", w.alias("w")).agg(F.count("*").alias("calls"))
    return out.select("client_id", F.col("w.start").alias("minute"), "calls", (F.col("calls") > most).alias("limited"))


def newest_snapshot(asked: DataFrame, snapshots: DataFrame, *, hours: int = 24) -> DataFrame:
    """Batch: for each request the newest snapshot at most 24 hours older. ``snapshots (snapshot_id, taken_at)``, a row a day."""
    age = F.col("taken_at").between(F.col("asked_at") - F.expr(f"interval {hours} hours"), F.col("asked_at"))
    day = F.explode(F.array(F.to_date("asked_at"), F.date_sub(F.to_date("asked_at"), 1)))
    both = asked.withColumn("day", day).join(snapshots.withColumn("day", F.to_date("taken_at")), "day").where(age)
    return both.groupBy("request_id").agg(F.max_by("snapshot_id", "taken_at").alias("snapshot_id"))


def exhausted(calls: DataFrame) -> DataFrame:
    """Adds ``skipped``: an earlier call to the provider was refused (402, 403, 429). Needs ``provider, ts, seq, status``.

    The first refusal of each provider is one number, joined back, so no window holds a provider's whole history.
    """
    first = calls.where(F.col("status").isin(402, 403, 429)).groupBy("provider").agg(F.min(F.struct("ts", "seq")).alias("refused"))
    return calls.join(first, "provider", "left").withColumn("skipped", F.coalesce(F.struct("ts", "seq") > F.col("refused"), F.lit(False))).drop("refused")


def best_so_far(results: DataFrame, *, line: float = 0.90) -> DataFrame:
    """Stream or batch: each request's best score yet and whether it is over the line for an early end."""
    return results.groupBy("request_id").agg(F.max(F.struct("score", "url")).alias("b")).select("request_id", F.col("b.score").alias("score"), F.col("b.url").alias("url"), (F.col("b.score") >= line).alias("closed"))


def write_results(events: DataFrame, path: str, checkpoint: str):
    """Stream sink: the result events in the history table, a folder per batch, so a batch that runs again replaces itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return events.where("kind = 'result'").writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
