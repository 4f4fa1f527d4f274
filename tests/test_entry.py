"""The registered queries agree with their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from docsieve.queries import core

FOLDER = "/root/testdata/sf0.001"


def shown(frame, columns):
    cell = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, tables, name):
    got = core.QUERIES[name](spark, FOLDER).toPandas()
    want = tables.execute(core.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
