"""Registered queries against their SQL on DuckDB.

By default one query per module area runs at the smallest scale; BITLOOM_ALL=1 runs them all.
"""

import os

import duckdb
import pytest

from catalog import load
from catalog.base import TABLES
from tools.check import _table

FOLDER = "/root/testdata/sf0.001"
SOME = ["flagship", "t5_square_terms", "e6_knapsack", "v14_knapsack_energy", "d18_clause_stats", "g12_plant",
        "p1_plan_tasks", "r6_incumbent_asof", "a6_leaderboard", "w1_stream_results", "w2_stream_incumbent"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_reads_and_every_oracle_has_a_query():
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) > 140


@pytest.mark.parametrize("name", sorted(load()[1]) if os.environ.get("BITLOOM_ALL") else SOME)
def test_query_equals_its_sql(spark, duck, name):
    queries, oracles = load()
    df = queries[name](spark, FOLDER)
    left = _table(df.columns, df.collect())
    cursor = duck.execute(oracles[name])
    assert left == _table([d[0] for d in cursor.description], cursor.fetchall())
