"""Every query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from cadence.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(frame):
    cols = sorted(frame.columns)
    cell = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else x
    return cols, frame[cols].map(cell).astype(str).sort_values(cols).values.tolist()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    assert plain(plans.QUERIES[name](spark, sf).toPandas()) == plain(duck.sql(plans.ORACLE_SQL[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2 and set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())
