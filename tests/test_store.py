"""User tables: appends, deletes, versions, writers that fail or meet."""

import pytest
from pyspark.sql import functions as F

from docsieve.sources import store
from docsieve.sources.store import Conflict, UserTable


@pytest.fixture
def table(spark, tmp_path):
    return UserTable(spark, f"{tmp_path}/t")


def some(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item string")


def content(df):
    return sorted((r["user_id"], r["item"]) for r in df.collect())


ROWS = [(u, f"i{u}{k}") for u in range(50) for k in "abc"]


def test_clear_counts_and_rows_are_gone(spark, table):
    table.append(some(spark, ROWS))
    table.append(some(spark, [(1, "twice"), (1, "twice"), (None, "nobody")]))
    assert table.delete(some(spark, [(1, ""), (1, ""), (7, ""), (999, "")]).select("user_id")) == 3 + 2 + 3
    assert content(table.read().where("user_id is not null")) == sorted(r for r in ROWS if r[0] not in (1, 7))
    assert table.read().where("user_id is null").count() == 1
    assert table.delete(some(spark, [(2, "i2a"), (3, "i2b")])) == 1
    assert table.delete(some(spark, []).select("user_id")) == 0 == table.delete(some(spark, [(1, "")]).select("user_id"))
    # the files of cleared users are in no folder of the last version
    listed = {f for fs in table.manifest()["folders"].values() for f in fs}
    again = spark.read.schema("user_id long, item string").parquet(*[f"{table.path}/{f}" for f in listed])
    assert again.where("user_id in (1, 7)").count() == 0


def test_readers_see_whole_versions(spark, table):
    with pytest.raises(ValueError, match="no version"):
        table.read()
    table.append(some(spark, ROWS))
    old = table.read()
    table.delete(old.select("user_id").distinct())
    assert table.read().count() == 0 and content(old) == sorted(ROWS) == content(table.read(1))
    assert table.versions() == [1, 2]


def test_a_commit_key_counts_once(spark, table):
    assert table.append(some(spark, ROWS), key="a").count() == len(ROWS)
    assert table.append(some(spark, ROWS), key="a").count() == 0
    assert table.read().count() == len(ROWS)
    assert table.delete(some(spark, [(1, "")]).select("user_id"), key="d") == 3
    assert table.delete(some(spark, [(2, "")]).select("user_id"), key="d") == 0


def test_a_writer_that_dies_leaves_the_last_version(spark, table):
    table.append(some(spark, ROWS))
    broken = some(spark, [(1, "x"), (2, "y")]).withColumn("item", F.when(F.col("user_id") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("item")))
    with pytest.raises(Exception, match="killed"):
        table.append(broken)
    table.written(table.bucket(some(spark, [(3, "never committed")])))
    assert content(table.read()) == sorted(ROWS) and table.versions() == [1]


def test_two_writers(spark, table):
    table.append(some(spark, ROWS))
    before = table.manifest()
    other = UserTable(spark, table.path)
    other.append(some(spark, [(1, "first")]))
    with pytest.raises(Conflict):
        table.commit(before, some(spark, []).schema, {}, "second")
    original, calls = table.manifest, []
    table.manifest = lambda *a: calls.append(1) or (before if len(calls) == 1 else original(*a))  # it has looked before the other one wrote
    table.append(some(spark, [(1, "second")]))
    calls.clear()
    before = original()
    other.append(some(spark, [(1, "third")]))
    assert table.delete(some(spark, [(1, "")]).select("user_id")) == 3 + 3
    assert content(other.read()) == sorted(r for r in ROWS if r[0] != 1)


def test_compaction(spark, table):
    for k in range(store.MANY):
        table.append(some(spark, [(5, f"k{k}"), (6 + k, "x")]))
    many = max(map(len, table.manifest()["folders"].values()))
    rows = content(table.read())
    table.compact()
    assert many >= store.MANY > max(map(len, table.manifest()["folders"].values())) and content(table.read()) == rows
