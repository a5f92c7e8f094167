"""Every query with SQL gives the rows that DuckDB gives; the others run and have a schema."""

import os

import duckdb
import pytest

from recurra.plans.oracle import ORACLE
from recurra.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    cell = lambda v: None if v is None else float(v) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = _plain(df.select(*columns).collect())
    sql = duck.sql(ORACLE[name])
    assert sorted(sql.columns) == columns
    theirs = _plain(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE[name]})").fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert [x if isinstance(x, (str, type(None))) else pytest.approx(x, rel=1e-9, abs=2e-5) for x in b] == list(a)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_registers_them(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 50
