"""Every query with SQL against DuckDB, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    r = duck.sql(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, row))) for row in r.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6000 and df.columns == ["l_orderkey", "l_linenumber", "quantity", "discount", "score"]


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
