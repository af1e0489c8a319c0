"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from corpusloom.runtime import CORE

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def same(a, b):
    if isinstance(a, (float, int)) and isinstance(b, (float, int)) and (isinstance(a, float) or isinstance(b, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def check(spark, name, query, sql):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, str(DATA))
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: [str(round(x, 6)) if isinstance(x, float) else str(x) for x in r]
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=key)
    rows = sorted((plain(list(r)) for r in want.fetchall()), key=key)
    assert len(got) == len(rows)
    for g, w in zip(got, rows):
        assert all(map(same, g, w)), (g, w)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", CORE.sql)
def test_as_sql(spark, name):
    check(spark, name, CORE.queries[name], CORE.sql[name])
