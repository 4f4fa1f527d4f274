"""Sharding and line dedup against plain Python, with nulls, repeats, hot keys and clashing names."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docsieve.llm import line_dedup, sharding

rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(60)]


def line(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(text):
    w = text.split()
    for _ in range(rng.randint(0, 3)):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


POOL = [line(rng.randint(1, 25)) for _ in range(40)] + ["", "  ", "A b", "a B"]
TEXTS = [(i, "\n".join(near(x) if x.split() and rng.random() < 0.7 else x for x in rng.choices(POOL, k=rng.randint(1, 6)))) for i in range(90)]
TEXTS += [(90, None), (91, ""), (92, "\n\n"), (93, line(3000)), (5, TEXTS[5][1]), (5, "other text"), (None, POOL[0]), (None, None)]


def words(text):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", text.lower()))


def test_line_dedup_against_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in TEXTS], "doc_id long, text string, line string, n int, words string").repartition(3)
    ties = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    places = sorted({((i is not None, i or 0), ties[t], n, x) for i, t in TEXTS if t is not None for n, x in enumerate(t.split("\n"))})
    gone, earlier = set(), []
    for key, tie, n, x in places:
        s = words(x)
        if not s:
            continue
        if any(10 * len(s & e) >= 8 * len(s | e) for e in earlier):
            gone.add((key, tie, n))
        earlier.append(s)
    got = line_dedup.dedup_lines(docs, buckets=64)
    assert got.columns == [*docs.columns, "removed lines"]
    want = []
    for i, t in TEXTS:
        cut = [n for n in range(len(t.split("\n"))) if ((i is not None, i or 0), ties[t], n) in gone] if t is not None else []
        want.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut), cut))
    assert sorted(((r["doc_id"], r["text"], r["removed lines"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(gone) > 60


def test_line_dedup_without_broadcast_and_without_rows(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = sorted(map(str, line_dedup.removed_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "small", lambda df: df)
    assert sorted(map(str, line_dedup.removed_lines(docs, buckets=1024).collect())) == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_bitmaps_tell_unrelated_long_lines_apart(spark):
    """Maps never differ in more bits than the sets do in words, and unrelated sets' maps in more than similar ones may."""
    sets = [sorted(rng.sample(range(1 << 40), n)) for n in (5, 40, 64, 64, 70, 100, 128, 128, 130, 150, 160, 160, 170, 190)]
    sets += [[w for w in s if rng.random() < 0.95] + rng.sample(range(1 << 40), 3) for s in sets]
    rows = spark.createDataFrame(list(enumerate(sets)), "i int, w array<long>").select("i", F.size("w").alias("n"), *line_dedup.bitmap(F.col("w")))
    left, right = rows.toDF("a", "n", *line_dedup.BITS), rows.toDF("b", "n2", *[f"other {c}" for c in line_dedup.BITS])
    bits = line_dedup.differing(F.col("n"), F.col("n2"), [F.col(c) for c in line_dedup.BITS], [F.col(f"other {c}") for c in line_dedup.BITS])
    far = 0
    for r in left.crossJoin(right).where("a < b and 10 * least(n, n2) >= 8 * greatest(n, n2)").select("a", "b", bits.alias("bits")).collect():
        x, y = set(sets[r["a"]]), set(sets[r["b"]])
        assert r["bits"] <= len(x ^ y)
        if len(x) >= 40 and not x & y:
            far += 1
            assert r["bits"] > len(x) + len(y) - 2 * 4 * (len(x) + len(y)) / 9
    assert far > 40


@pytest.mark.parametrize("mixed", [False, True])
def test_any_order_of_words_gives_the_same_lines(spark, monkeypatch, mixed):
    docs = spark.createDataFrame(TEXTS + [(200 + i, line(150) + " " + " ".join(f"x{j}" for j in range(100, 100 + 12 * i))) for i in range(9)], "doc_id long, text string")
    want = sorted(map(str, line_dedup.removed_lines(docs).collect()))
    order = bytearray(rng.randrange(1, 127) for _ in range(64)) if mixed else bytearray(b"\x01" * 64)
    monkeypatch.setattr(line_dedup, "rarity_table", lambda *a: order)
    assert sorted(map(str, line_dedup.removed_lines(docs, buckets=64).collect())) == want


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_are_even_and_slots_gapless(spark, law):
    rows = [(rng.randrange(10**6), "é" * rng.randint(0, 80)) for _ in range(3000)] + [(77, f"hot {i}") for i in range(1500)]
    rows += [(None, None), (None, "x"), (5, "same"), (5, "same"), (6, "z" * 9000)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(5)
    got = sharding.shards(docs, law=law, ranges=32, per_range=8).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(16))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    weights = [sum(r["size"] if law == "bytes" else 1 for r in s) for s in by.values()]
    assert max(weights) - min(weights) <= (2 * 9001 if law == "bytes" else 1)


def test_shards_of_small_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["slot"]) for r in sharding.shards(docs).collect()) == [(1, 0), (2, 0)]
    assert sharding.shards(docs.limit(0)).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, None)]
