"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ticketloom.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    def one(v):
        if v is None or pd.isna(v):
            return "null"
        return str(v)[:10] if hasattr(v, "year") else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)

    c = sorted(df.columns)
    return sorted(tuple(one(v) for v in r) for r in df[c].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(queries.SQL)))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, DIR).toPandas()) == plain(con.sql(queries.SQL[name]).df())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
