"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lexloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else v
    return sorted(columns), Counter(tuple(clean(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    want = rows([d[0] for d in got.description], got.fetchall())
    df = QUERIES[name](spark, SF)
    assert rows(df.columns, df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
