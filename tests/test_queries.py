"""Every query with SQL gives the rows of that SQL in DuckDB, without regard to order."""

import datetime
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [k for r in e.REPORTS for k in r.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = e.queries()[name](spark, SF)
    want = duck.execute(e.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_without_llm():
    """The rest of the library imports nothing of the llm subpackage."""
    from pathlib import Path

    for path in (Path(e.__file__).parent / "sparkloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("fulfillment", ""), path
