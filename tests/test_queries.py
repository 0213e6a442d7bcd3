"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from fidelis import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.6g}"
    try:
        return f"{float(v) + 0.0:.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert rows
    if name in catalogue.ORACLE_SQL:
        cur = con.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(df.columns)]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert {r["contrast"] for r in __spark_entry__.entry(spark).collect()} == {"dpop", "dgroup", "ddistract", "dindiv", "total"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
