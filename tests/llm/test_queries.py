"""Queries of the numbered operators with SQL, against DuckDB on the small tables; all are registered and importable."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from spendlens.llm import queries

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    rel = con.execute(queries.ORACLE[name])
    names = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(norm, r)) for r in got.select(*names).collect()) == sorted(tuple(map(norm, r)) for r in rel.fetchall())


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())
