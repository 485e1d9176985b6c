"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from skylattice import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, data, oracle):
    found = catalogue.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    got = sorted([plain(v) for v in row] for row in found.select(*columns).collect())
    if name not in catalogue.ORACLES:
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted([plain(v) for v in row] for row in oracle.sql(f"SELECT {quoted} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_entry_is_registered():
    import __spark_entry__

    assert catalogue.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
