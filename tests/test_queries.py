"""Every registered query with SQL against DuckDB, on the tables that correctness is judged by; the smallest ones lack cases (there, every entity merges something)."""

import os

import pytest

from heliograph.plans import registry

SIZES = ("sf0.01",)
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no sample tables")

    def at(size):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{size}/{t}.parquet'")
        return con

    return {size: at(size) for size in SIZES}


def rows(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name, size):
    got, want = registry.QUERIES[name](spark, f"{DATA}/{size}").toPandas(), duck[size].sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
