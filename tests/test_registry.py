"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from strandline.plans import models, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(found):
    return sorted(tuple("null" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(models.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows(df.select(*names).collect())
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == names
        assert got == rows(want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
