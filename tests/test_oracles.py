"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import pytest

from kerbline.oracles import ORACLE_SQL
from kerbline.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    answer = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    left = sorted(tuple(norm(r[c]) for c in order) for r in found.collect())
    right = sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in answer.fetchall())
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
