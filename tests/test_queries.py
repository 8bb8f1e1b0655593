"""Every registered query of the driver tables against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import graph_queries, operator_queries, stage_queries, text_queries, trace_queries

DATA = "/root/testdata/sf0.001"
SQL = {n: q for p in (graph_queries, text_queries, trace_queries, operator_queries, stage_queries) for n, q in p.ORACLE_SQL.items()}


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(norm(r[n]) for n in sorted(names)) for r in got.collect()]
    wanted = [tuple(norm(r[names.index(n)]) for n in sorted(names)) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))


def test_every_query_has_its_sql():
    for p in (graph_queries, text_queries, trace_queries, operator_queries, stage_queries):
        assert set(p.QUERIES) == set(p.ORACLE_SQL)


def test_triage_reports_every_topic(spark, tmp_path):
    spark.range(1100).selectExpr("id AS doc_id", "'en' AS lang", "concat('s', id) AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1100).selectExpr("id AS doc_id", "0 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert trace_queries.triage_topics(spark, str(tmp_path)).count() == 1100
