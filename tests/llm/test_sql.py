"""Queries with SQL against DuckDB on the small tables, and on rows that repeat, tie and lack values."""

import duckdb
import pytest

import __spark_entry__ as contract
from boutline.llm.queries import ORACLES, QUERIES

PAGES = [(1, "u", "<a>"), (2, None, "<a>"), (3, "x", None), (4, "y", ""), (5, "z", "<a>"), (6, "é\n", "é 漢字")]


def test_contract_lists_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert [n for n in QUERIES if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


def same(spark, folder, name, tables=("embeddings", "pages", "documents", "benchmark")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if 'testdata' not in folder else ''}'")
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in df.select(*names).collect()) == key(tuple(r) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_small_tables(spark, sf, name):
    same(spark, sf, name)


def test_awkward_tables(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    vecs = [(i, [float(i % 7), 0.5, -0.25 * (i % 3)], 0) for i in range(250)] + [(300, None, 0), (301, [1.0, None, 2.0], 0), (400, [float("nan")] * 3, 0), (7, [0.0, 0.5, -0.25], 0)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op2_topk", "op6_warc"):
        same(spark, str(tmp_path), name, ("embeddings", "pages"))
