"""Streams in the order of event time against their batch twins, on late, repeated and shuffled input."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from docsieve.streaming import ordered

START = datetime(2024, 5, 1)
SCHEMA = "session_id long, client_id long, seq long, kind string, ts timestamp"


@pytest.fixture(scope="module")
def stored_state(spark):
    before = spark.conf.get(ordered.STORE[0])
    spark.conf.set(*ordered.STORE)
    yield spark
    spark.conf.set(ordered.STORE[0], before)


def event(session, seq, kind, seconds):
    return (session, session, seq, kind, START + timedelta(seconds=seconds))


def run(spark, folder, batches, stream):
    """Feeds the batches one after the other, each by a run of its own that goes on from the last one's state."""
    source, out, state = (f"{folder}/{n}-{uuid.uuid4().hex}" for n in ("in", "out", "state"))
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = stream(spark.readStream.schema(SCHEMA).parquet(source))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "memory").load(state)
    return {tuple(r) for r in spark.read.schema(found.schema).parquet(out).collect()}, left.count()


def shuffled(rows, within, draw):
    """In an order in which no row comes more than so many seconds after a later one."""
    return sorted(rows, key=lambda r: r[4] + timedelta(seconds=draw.uniform(0, within)))


def made(draw, sessions=12, n=40):
    rows, seq = [], 0
    for s in range(sessions):
        at = draw.uniform(0, 500)
        for _ in range(n):
            at += draw.choice((0, 1, 5, 30, 119, 120, 121, 400, 4000))
            seq += 1
            rows.append(event(s, seq, draw.choice(("status", "status", "result", "result", "status", "done", "error")), at))
    return rows


LAST = event(-1, 0, "done", 10_000_000)


def test_sessions_close_by_themselves(stored_state, tmp_path):
    draw = random.Random(8)
    rows = made(draw)
    late = shuffled(rows, 300, draw)
    parts = [late[i : i + 100] for i in range(0, len(late), 100)]
    got, left = run(stored_state, tmp_path, [*parts, [LAST]], lambda e: ordered.closing_stream(e, lateness="10 minutes", keep="1 hour"))
    want = {tuple(r) for r in ordered.closing(stored_state.createDataFrame(rows, SCHEMA)).collect()}
    assert {r for r in got if r[0] >= 0} == want
    assert any(r[4] for r in want) and left <= 1
    # a session opens anew only after an hour of silence
    by_session = [sorted(r[3] for r in want if r[0] == s) for s in range(12)]
    assert all(max(times) > min(times) for times in by_session)


def test_by_hand(stored_state, tmp_path):
    rows = [event(1, 1, "status", 0), event(1, 2, "status", 119), event(1, 3, "status", 239), event(1, 4, "done", 240), event(2, 5, "done", 5), event(2, 6, "status", 6), event(2, 7, "status", 3605), event(2, 8, "result", 7205.5), event(3, 9, "status", 7)]
    at = lambda s: START + timedelta(seconds=s)
    want = {
        (1, 1, "status", at(0), False), (1, 2, "status", at(119), False), (1, None, "error", at(239), True),
        (2, 5, "done", at(5), False), (2, 8, "result", at(7205.5), False), (2, None, "error", at(7325.5), True), (3, 9, "status", at(7), False), (3, None, "error", at(127), True),
    }
    assert {tuple(r) for r in ordered.closing(stored_state.createDataFrame(rows, SCHEMA)).collect()} == want
    got, _ = run(stored_state, tmp_path, [rows[::-1], [LAST]], ordered.closing_stream)
    assert {r for r in got if r[0] >= 0} == want


def test_cache_with_a_lifetime(stored_state, tmp_path):
    draw = random.Random(9)
    rows = [event(s, 1000 * s + i, "", int(draw.uniform(0, 10 * 86_400))) for s in range(8) for i in range(60)] + [event(9, 1, "", 0), event(9, 2, "", 86_399), event(9, 3, "", 86_400), event(9, 4, "", 86_400 + 86_399)]
    expected = set()
    for s in {r[0] for r in rows}:
        fetched = None
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[2])):
            hit = fetched is not None and r[4] - fetched[4] < timedelta(days=1)
            fetched = fetched if hit else r
            expected.add((s, r[2], r[4], hit, fetched[2]))
    batch = stored_state.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in ordered.cached(batch).collect()} == expected
    late = shuffled(rows, 7200, draw)
    got, left = run(stored_state, tmp_path, [late[:200], late[200:], [LAST]], lambda c: ordered.cached_stream(c, lateness="3 hours"))
    assert {r for r in got if r[0] >= 0} == expected and left <= 1
    assert {r["seq"] for r in ordered.first_in_a_day(batch).collect()} == {r[1] for r in expected if not r[3]}


def test_the_store_is_asked_for(spark):
    rows = spark.readStream.format("rate").load().selectExpr("value as session_id", "value as seq", "'x' as kind", "timestamp as ts")
    before = spark.conf.get(ordered.STORE[0])
    spark.conf.unset(ordered.STORE[0])
    with pytest.raises(ValueError, match="timers"):
        ordered.closing_stream(rows)
    spark.conf.set(ordered.STORE[0], before)


def test_rows_wait_in_few_values_of_state(stored_state, tmp_path):
    rows = [event(1, i, "", 5 * i) for i in range(2000)]
    random.Random(4).shuffle(rows)
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for batch in (rows, [LAST]):
        stored_state.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = ordered.cached_stream(stored_state.readStream.schema(SCHEMA).parquet(source), lifetime="1 hour", lateness="3 hours")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        if batch is rows:
            assert 0 < stored_state.read.format("statestore").option("stateVarName", "waiting").load(state).count() < 20
    got = {(r["seq"], r["hit"], r["served_by"]) for r in stored_state.read.schema(found.schema).parquet(out).where("client_id = 1").collect()}
    assert got == {(i, i % 720 != 0, i - i % 720) for i in range(2000)}
