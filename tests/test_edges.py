"""Rows at the edges of reports, against their SQL in DuckDB."""

import datetime as dt

import duckdb
import pandas as pd

from sparkloom.plans import activity, relational


def both(spark, registry, name, folder, **tables):
    """Rows of a report and of its SQL over tables given as frames."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame = frame.astype({c: "datetime64[us]" for c in frame.select_dtypes("datetime")})
        con.register("given", frame)
        con.execute(f"COPY given TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = registry.queries[name](spark, str(folder))
    want = con.execute(registry.sql[name])
    columns = [d[0] for d in want.description]
    return sorted(tuple(r[c] for c in columns) for r in got.collect()), sorted(want.fetchall())


def test_latest_link_near_keys(spark, tmp_path):
    day = dt.datetime(1998, 8, 1)
    rows = [(100, 1, "F", day), (2100, 1, "F", day), (90000, 2, "F", day), (100, 2, "F", day), (5, 3, "O", day), (4, 3, "P", day - dt.timedelta(days=9))]
    orders = pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    got, want = both(spark, relational.R, "latest_link", tmp_path, orders=orders)
    assert got == want == [(1, 100, 3), (2, 90000, 3), (3, 4, 2)]


def test_presence_within_a_second(spark, tmp_path):
    now = dt.datetime(2024, 1, 30)
    seen = [dt.timedelta(seconds=21600), dt.timedelta(seconds=21600, microseconds=400_000), dt.timedelta(seconds=21599, microseconds=999_999)]
    events = pd.DataFrame({"user_id": [1, 2, 3], "ts": [now - s for s in seen]})
    got, want = both(spark, activity.R, "presence_alive", tmp_path, events=events)
    assert got == want and [r[2] for r in got] == [True, False, True]
