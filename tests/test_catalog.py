"""Every query of the engine against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from spantail.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fine = lambda v: ("null",) if v is None else round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(names), sorted((tuple(fine(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.execute(ORACLE_SQL[name])
    expected = table([d[0] for d in rel.description], rel.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
