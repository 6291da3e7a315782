"""Every registered query against its SQL, and the shape of every plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name, request):
    if name.startswith("stream_"):
        request.getfixturevalue("two_partitions")
    df = QUERIES[name](spark, DIRECTORY)
    columns = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    left = sorted(str([canon(v) for v in r]) for r in df.select(*columns).collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    right = sorted(str([canon(r[i]) for i in order]) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIRECTORY).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
