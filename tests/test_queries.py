"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

import os

import pytest

import __spark_entry__
from quillflow.plans import library_queries, shelf_queries, stream_queries, table_queries, text_queries

SF = "/root/testdata/sf0.001"
MODULES = (shelf_queries, text_queries, library_queries, stream_queries, table_queries)
QUERIES, ORACLES = ({k: v for m in MODULES for k, v in getattr(m, part).items()} for part in ("QUERIES", "ORACLES"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()) == got


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
