"""Keyed streams that act in the order of event time, with timers: sessions that close by themselves, and a cache with a lifetime.

Rows wait in the state of their key until the watermark has passed them, so rows that come out of order give the same result as
sorted ones. Timers wake a key when its next row is due, when it has been quiet for too long, and when its state
can be dropped. Each stream has a batch twin that follows the same rules.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsieve.streaming.sessions import TERMINAL, timed

#: Keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: The rows of one value of state, their columns and their order.
BLOCK, COLUMNS = 10_000, ["us", "seq", "kind"]
IN_ORDER = [(c, "ascending") for c in COLUMNS]


def micros(text: str) -> int:
    """A length of time such as ``120 seconds`` in microseconds."""
    n, unit = text.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.removesuffix("s")] * 1_000_000


def packed(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(value).read_next_batch()


def triples(block: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a block; few of them are Python objects at a time."""
    for i in range(0, block.num_rows, 500):
        yield from zip(*(c.to_pylist() for c in block.slice(i, 500).columns), strict=True)


class InOrder(StatefulProcessor):
    """Hands a key's rows on in the order of ``ts, seq`` once the watermark has passed them.

    What waits is kept in sorted blocks, one value of state for many rows, as each value is a message between Python and Spark; the
    blocks are merged when they are due, and rows go out one by one.
    Subclasses keep one row of state, ``memory``, whose first field is the time of the last row seen, and give
    ``taken(key, memory, row) -> (memory, rows out)`` and ``passed(key, memory, now) -> (memory or None, rows out, next time to look)``.
    """

    row_schema = "rows binary"
    memory_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.memory = handle.getValueState("memory", self.memory_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for part in batched(((r["us"], r["seq"], r["kind"]) for r in rows), BLOCK):  # a key's rows are never all in memory here
            block = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], COLUMNS)
            self.waiting.appendValue((packed(block.sort_by(IN_ORDER)),))
            at = min(r[0] for r in part)
            first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [unpacked(v[0]) for v in self.waiting.get()] if self.waiting.exists() else []
        n_due = [int(np.searchsorted(b["us"].to_numpy(), now, "right")) for b in blocks]
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        for row in heapq.merge(*(triples(b.slice(0, n)) for b, n in zip(blocks, n_due, strict=True) if n)):
            memory, told = self.taken(key, memory, row)
            yield from told
        look = None
        if memory is not None:
            memory, told, look = self.passed(key, memory, now)
            yield from told
        later = pa.Table.from_batches([b.slice(n) for b, n in zip(blocks, n_due, strict=True)]).sort_by(IN_ORDER) if blocks else None
        if any(n_due):
            self.waiting.clear()
            for block in later.combine_chunks().to_batches(max_chunksize=BLOCK):
                self.waiting.appendValue((packed(block),))
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update(memory)
        times = [later["us"][0].as_py()] if later else []
        if look is not None:
            times.append(look)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))


class Closing(InOrder):
    """A session's rows until one of them is terminal or the session has been quiet for ``gap``, which makes an error of its own."""

    memory_schema = "seen long, kept long, closed boolean"

    def __init__(self, gap: int, keep: int):
        self.gap, self.keep = gap, keep

    def error(self, key, kept: int) -> Row:
        return Row(session_id=key[0], seq=None, kind="error", us=kept + self.gap, synthetic=True)

    def taken(self, key, memory, row):
        at, seq, kind = row
        out = []
        if memory is not None:
            seen, kept, closed = memory
            if not closed and at - seen >= self.gap:
                out.append(self.error(key, kept))
                closed = True
            if at - seen < self.keep:
                if closed:
                    return (at, kept, True), out
            # quiet for so long that the session is forgotten: the row opens a new one
        out.append(Row(session_id=key[0], seq=seq, kind=kind, us=at, synthetic=False))
        return (at, at, kind in TERMINAL), out

    def passed(self, key, memory, now):
        seen, kept, closed = memory
        out = []
        if not closed and now - seen >= self.gap:
            out.append(self.error(key, kept))
            closed = True
        if now - seen >= self.keep:
            return None, out, None
        return (seen, kept, closed), out, seen + (self.keep if closed else self.gap)


class Cache(InOrder):
    """A key's calls: what is fetched at one serves the later ones until it is ``lifetime`` old."""

    memory_schema = "fetched long, by long"

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def taken(self, key, memory, row):
        at, seq, _ = row
        hit = memory is not None and at - memory[0] < self.lifetime
        memory = memory if hit else (at, seq)
        return memory, [Row(key=key[0], seq=seq, us=at, hit=hit, served_by=memory[1])]

    def passed(self, key, memory, now):
        return (None, [], None) if now - memory[0] >= self.lifetime else (memory, [], memory[0] + self.lifetime)


def keyed(rows: DataFrame, key: str, lateness: str) -> DataFrame:
    return timed(rows).withWatermark("ts", lateness).select(key, F.col("seq").cast("long").alias("seq"), "kind", "ts", F.unix_micros("ts").alias("us"))


def needs_store(spark: SparkSession) -> None:
    if spark.conf.get(STORE[0], None) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}: timers need it")


def closing_stream(events: DataFrame, *, gap: str = "120 seconds", keep: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Stream of ``session_id, seq, kind, ts, synthetic``: rows until a session closes; needs ``session_id, seq, kind, ts``.

    A session closes with its first terminal row, or ``gap`` after its last row with a synthetic error at that time. What comes after
    is dropped, until the session has been quiet for ``keep``; then its state is dropped, and a later row opens it anew.
    Rows later than ``lateness`` are dropped by the watermark.
    """
    needs_store(events.sparkSession)
    out = keyed(events, "session_id", lateness).groupBy("session_id").transformWithState(
        Closing(micros(gap), micros(keep)), f"session_id {dict(events.dtypes)['session_id']}, seq long, kind string, us long, synthetic boolean", "append", "EventTime")
    return out.select("session_id", "seq", "kind", F.timestamp_micros("us").alias("ts"), "synthetic")


def closing(events: DataFrame, *, gap: str = "120 seconds", keep: str = "1 hour") -> DataFrame:
    """Batch twin of ``closing_stream`` on finished input: every session that is still open at the end closes by its silence."""
    order = Window.partitionBy("session_id").orderBy("us", "seq")
    quiet = F.col("us") - F.lag("us").over(order)
    rows = events.select("session_id", F.col("seq").cast("long").alias("seq"), "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    visits = rows.withColumn("quiet", quiet).withColumn("visit", F.sum((F.coalesce("quiet", F.lit(0)) >= micros(keep)).cast("int")).over(order))
    within = Window.partitionBy("session_id", "visit").orderBy("us", "seq")
    inside = F.row_number().over(within) > 1
    silent = F.max(inside & (F.col("quiet") >= micros(gap))).over(within)
    ended = F.max(F.col("kind").isin(*TERMINAL)).over(within.rowsBetween(Window.unboundedPreceding, -1))
    kept = visits.withColumn("dropped", silent | F.coalesce(ended, F.lit(False))).where(~F.col("dropped"))
    last = kept.groupBy("session_id", "visit").agg(F.max("us").alias("us"), F.max(F.col("kind").isin(*TERMINAL)).alias("closed")).where("not closed")
    errors = last.select("session_id", F.lit(None).cast("long").alias("seq"), F.lit("error").alias("kind"), (F.col("us") + micros(gap)).alias("us"), F.lit(True).alias("synthetic"))
    every = kept.select("session_id", "seq", "kind", "us", F.lit(False).alias("synthetic")).unionByName(errors)
    return every.select("session_id", "seq", "kind", F.timestamp_micros("us").alias("ts"), "synthetic")


def cached_stream(calls: DataFrame, *, key: str = "client_id", lifetime: str = "24 hours", lateness: str = "10 minutes") -> DataFrame:
    """Stream of ``key, seq, ts, hit, served_by``: whether what an earlier call fetched was younger than ``lifetime``, and that call's ``seq``.

    A call that finds nothing fetches anew. Needs ``key, seq, ts``. A key's state goes when what it holds has expired.
    """
    needs_store(calls.sparkSession)
    rows = keyed(calls.withColumn("kind", F.lit("")), key, lateness)
    out = rows.groupBy(key).transformWithState(Cache(micros(lifetime)), f"key {dict(calls.dtypes)[key]}, seq long, us long, hit boolean, served_by long", "append", "EventTime")
    return out.select(F.col("key").alias(key), "seq", F.timestamp_micros("us").alias("ts"), "hit", "served_by")


def cached(calls: DataFrame, *, key: str = "client_id", lifetime: str = "24 hours") -> DataFrame:
    """Batch twin of ``cached_stream``: one pass over each key's calls in order, holding a single fetch at a time."""
    kind, life = dict(calls.dtypes)[key], micros(lifetime)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fetched, by = None, None, None
        for batch in batches:
            hits, served = [], []
            for k, at, seq in zip(*(batch[c].to_pylist() for c in ("key", "us", "seq")), strict=True):
                hit = fetched is not None and k == own and at - fetched < life
                if not hit:
                    own, fetched, by = k, at, seq
                hits.append(hit)
                served.append(by)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["seq"], batch["us"], pa.array(hits, pa.bool_()), pa.array(served, pa.int64())], ["key", "seq", "us", "hit", "served_by"])

    rows = calls.select(F.col(key).alias("key"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = rows.repartition("key").sortWithinPartitions("key", "us", "seq").mapInArrow(run, f"key {kind}, seq long, us long, hit boolean, served_by long")
    return out.select(F.col("key").alias(key), "seq", F.timestamp_micros("us").alias("ts"), "hit", "served_by")


def first_in_a_day(calls: DataFrame, *, key: str = "client_id", hours: int = 24, lateness: str = "10 minutes") -> DataFrame:
    """Stream or batch: the calls that find nothing cached."""
    found = cached_stream(calls, key=key, lifetime=f"{hours} hours", lateness=lateness) if calls.isStreaming else cached(calls, key=key, lifetime=f"{hours} hours")
    return found.where("not hit").select(key, "seq", "ts")
