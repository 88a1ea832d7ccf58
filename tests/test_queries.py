"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from scriptorium.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    made = registry.queries()[name](spark, SF)
    names = sorted(made.columns)
    told = duck.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == names
    at = [told.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in made.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
