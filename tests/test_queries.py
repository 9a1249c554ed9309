"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from recallgrid.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float | int):
        return abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    assert all(alike(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), (got[:3], want[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
