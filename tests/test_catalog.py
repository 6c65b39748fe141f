"""Every registered query against its SQL statement in DuckDB on the small tables."""

import duckdb
import pytest
from tests.conftest import SMALL

import __spark_entry__ as contract
from boutline.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
QUERIES, SQL = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def ordered(rows):
    flat = [tuple(0.0 if x == 0 and isinstance(x, float) else x for x in r) for r in rows]
    return sorted(flat, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    res = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in res.description}
    assert sorted(types) == cols
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == types
    at = [[d[0] for d in res.description].index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in res.fetchall()]
    assert ordered(tuple(r[c] for c in cols) for r in df.collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert len(QUERIES[name](spark, SMALL).head(1)) == 1


def test_contract_lists_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
